import json

import pytest
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.sources import io, manifest
from gradeloom.streaming import running

SCHEMA = T.StructType([T.StructField("idx", T.LongType()), T.StructField("text", T.StringType())])


def test_jsonl(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"idx":1,"text":"é"}\n\n{"idx":2,"text":null}\n', encoding="utf-8")
    assert [tuple(r) for r in io.read_jsonl(spark, str(f), SCHEMA).collect()] == [(1, "é"), (2, None)]
    f.write_text('{"idx":1}\n{bad\n')
    (tmp_path / "b.jsonl").write_text("\n".join(['{"idx":1}', "", "bad", "[1"]) + "\n")
    bad = [(r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in io.bad_lines(spark, str(tmp_path / "*.jsonl")).collect()]
    assert sorted(bad) == [("a.jsonl", 2, "{bad"), ("b.jsonl", 3, "bad"), ("b.jsonl", 4, "[1")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    (tmp_path / "c.jsonl").write_text("".join(f'{{"idx":{i}}}\n' if i % 7 else "bad\n" for i in range(1, 41)))
    assert sorted(r.line_no for r in io.bad_lines(spark, str(tmp_path / "c.jsonl")).collect()) == [7, 14, 21, 28, 35]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises((PySparkException, Py4JError)):
        io.read_jsonl(spark, str(f), SCHEMA).collect()


def test_records_and_seeds(spark, tmp_path):
    a, b, c, d = (tmp_path / n for n in "abcd")
    a.write_text('\n [{"idx":1,"text":"x"},\n {"idx":2,"text":"y"}]')
    b.write_text('{"idx":3,"text":"z"}\n')
    c.write_text(" \n")
    d.write_text("17\n")
    assert io.read_records(spark, str(a), SCHEMA).count() == 2 and io.read_records(spark, str(b), SCHEMA).count() == 1
    for bad in (c, d):
        with pytest.raises(io.BadRecord):
            io.read_records(spark, str(bad), SCHEMA)
    assert {(r.seed, r.idx) for r in io.read_seeds(spark, [f"1={a}", f"2={b}"], SCHEMA).collect()} == {(1, 1), (1, 2), (2, 3)}
    for bad in (["1=x", "1=y"], ["x"], ["a=b"]):
        with pytest.raises(io.BadRecord):
            io.read_seeds(spark, bad, SCHEMA)


def test_write_jsonl_round_trip(spark, frame, tmp_path):
    rows = frame([(2, "b\"é", 1.0), (1, None, 2.5)], "idx long, text string, v double")
    out = str(tmp_path / "out")
    assert io.write_jsonl(rows, out, ["idx"]) == 2
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text(encoding="utf-8").splitlines()]
    assert lines == ['{"idx":1,"text":null,"v":2.5}', '{"idx":2,"text":"b\\"é","v":1.0}']
    schedule = rows.withColumn("question", F.col("text")).withColumn("answer", F.lit("a")).withColumn("schedule_idx", F.col("idx"))
    assert io.write_training(schedule, str(tmp_path), "small") == (2, 2)


def test_manifests(spark, tmp_path):
    (tmp_path / "data").write_text("content")
    m = manifest.write_manifest(tmp_path / "manifest.json", "prepared", {"n": 5, "t": 0.75}, {"data": tmp_path / "data"}, rows=3)
    assert manifest.verify_manifest(tmp_path / "manifest.json", "prepared", {"n": 5}) == m
    digests = {r.path.rsplit("/", 1)[1]: r.sha256 for r in io.file_digests(spark, str(tmp_path)).collect()}
    assert digests == {"data": m["artifacts"]["data"]["sha256"]}
    (tmp_path / "inner").mkdir()
    (tmp_path / "inner" / "manifest.json").write_text("{}")
    assert sorted(r.path.rsplit("/", 2)[1] for r in io.file_digests(spark, str(tmp_path)).collect())[0] == "inner" and io.file_digests(spark, str(tmp_path)).count() == 2
    assert manifest.require_settings(m, {"stage": "complete", "config": {"n": 5}}, {"artifacts.data.sha256": tmp_path / "data"}) == m
    for expected, files in (({"config": {"n": 6}}, {}), ({"claims": {"better": True}}, {}), ({}, {"artifacts.other.sha256": tmp_path / "data"})):
        with pytest.raises(manifest.ManifestError):
            manifest.require_settings(m, expected, files)
    assert manifest.nested_differences({"a": 1}, {"a": True}) == {"a": (1, True)}
    for kind, expected in (("other", {}), ("prepared", {"n": 6})):
        with pytest.raises(manifest.ManifestError):
            manifest.verify_manifest(tmp_path / "manifest.json", kind, expected)
    (tmp_path / "data").write_text("changed")
    with pytest.raises(manifest.ManifestError):
        manifest.verify_manifest(tmp_path / "manifest.json", "prepared")
    with pytest.raises(manifest.ManifestError):
        manifest.write_manifest(tmp_path / "m2.json", "x", {}, {}, stage="no")
    child = {"parent_sha256": manifest.digest(m), "config": {"n": 5, "t": 0.9}}
    assert manifest.resolve_parent(child, [m, {}], inherit_except=["t"]) == m
    with pytest.raises(manifest.ManifestError):
        manifest.resolve_parent(child, [m])
    assert io.sidecar(tmp_path / "data") is None
    (tmp_path / "list.json").write_text("[]")
    with pytest.raises(io.BadRecord):
        io.read_object(tmp_path / "list.json")


def test_resume(spark, frame, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"stage": "complete", "ruler": "v1"}))
    assert io.finished(str(tmp_path / "s.json"), {"ruler": "v1"}) and not io.finished(str(tmp_path / "s.json"), {"ruler": "v2"}) and not io.finished(str(tmp_path / "none"), {})
    io.write_json(f"file://{tmp_path}/far.json", {"stage": "complete", "x": "é"}, spark)
    io.write_json(f"file://{tmp_path}/far.json", {"stage": "complete", "x": "é"}, spark)
    assert io.read_object(f"file://{tmp_path}/far.json", spark) == io.read_object(tmp_path / "far.json") and io.finished(f"file://{tmp_path}/f*.json", {"x": "é"}, spark)
    assert not io.finished(f"file://{tmp_path}/none*", {}, spark)
    work = frame([(1,), (2,)], "k long")
    assert io.whole_batches(work, ["k"], 2).count() == 2 and io.whole_batches(work, ["k"], 3).count() == 0
    assert [r.k for r in io.remaining(work, work.where("k = 1"), "k").collect()] == [2]
    states = [{"step": 1, "complete": True, "contract": {"a": 1}}, {"step": 3, "complete": False, "contract": {"a": 1}}, {"step": 2, "complete": True, "contract": {"a": 2}}]
    assert manifest.newest_complete(states, {"a": 1})["step"] == 1 and manifest.newest_complete([], {}) is None


def test_levels():
    assert io.level_numbers("Level 1,2-4") == (1, 2, 3, 4) and io.level_tag((4, 5)) == "l45" and io.level_tag((1, 3)) == "l13" and io.level_tag((2,)) == "l2"
    for bad in ("", "0", "6"):
        with pytest.raises(io.BadRecord):
            io.level_numbers(bad)


def test_streams(spark, frame, tmp_path):
    rows = frame([("a", "h1", 5, "2024-01-01 00:10:00"), ("a", "h1", 5, "2024-01-01 00:20:00"), ("b", "h2", 7, "2024-01-01 01:10:00")], "source string, source_row_hash string, train_tokens int, ts string")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("value", F.lit(1.5)).withColumn("event_type", F.col("source"))
    rows.write.parquet(str(tmp_path / "t"))
    totals = running.run_available(spark, str(tmp_path / "t"), running.running_totals)
    assert {tuple(r) for r in totals.collect()} == {("a", 2, 10), ("b", 1, 7)}
    assert running.run_available(spark, str(tmp_path / "t"), running.first_seen, "append").count() == 2
    assert running.tumbling(rows, lateness="10 minutes").count() == 2
    late = running.run_available(spark, str(tmp_path / "t"), lambda s: running.first_seen_within(s.withColumn("e", F.col("ts").cast("timestamp")), "source_row_hash", "e", "1 hour"), "append")
    assert late.count() == 2
    rows.limit(0).write.parquet(str(tmp_path / "none"))
    assert running.run_available(spark, str(tmp_path / "none"), running.running_totals).count() == 0
    kept = running.run_available(spark, str(tmp_path / "t"), lambda s: running.single_valued(s, "source_row_hash", ("source", "ts")))
    assert {tuple(r) for r in kept.collect()} == {("h1", 2, False), ("h2", 1, True)}
