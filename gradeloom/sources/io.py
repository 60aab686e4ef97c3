"""JSONL and JSON tables, canonical output, file digests and resumable work."""

from __future__ import annotations

import glob
import hashlib
import json
import os
from collections.abc import Iterator, Sequence
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.canonical import canonical_object
from gradeloom.operators.ordering import global_rank


class BadRecord(ValueError):
    """A line or file that isn't what it should be."""


def read_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """A JSONL table under a declared schema; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of the lines that are no JSON; blank ones are skipped but count as lines.

    A file is read in blocks, each in the order of its lines; a line's number is its place in its block and the
    lines of the blocks before it, one row each.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), "value", F.monotonically_increasing_id().alias("_id"))
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block")) - F.col("_n")
    blocks = blocks.withColumn("_before", before).drop("_n")
    bad = lines.where((F.trim("value") != "") & F.try_parse_json("value").isNull())
    return bad.join(blocks, ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line_no"), F.col("value").alias("line"))


def first_character(spark: SparkSession, path: str) -> str:
    """The first character of a file that isn't blank; an empty file is an error."""
    row = spark.read.text(path).where(F.trim("value") != "").select(F.substring(F.ltrim("value"), 1, 1)).first()
    if row is None:
        raise BadRecord(f"empty records file: {path}")
    return row[0]


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Evaluation records as JSONL or as one JSON array; anything else is an error."""
    start = first_character(spark, path)
    if start not in "[{":
        raise BadRecord(f"neither a list nor lines of objects: {path}")
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", str(start == "[").lower()).json(path)


def read_seeds(spark: SparkSession, values: Sequence[str], schema: T.StructType) -> DataFrame:
    """Records of several runs given as ``seed=path``, each row with its ``seed``; a seed given twice is an error."""
    paths: dict[int, str] = {}
    for v in values:
        seed, sign, path = v.partition("=")
        if not sign or not seed.strip().lstrip("-").isdigit():
            raise BadRecord(f"expected seed=path, got {v!r}")
        if int(seed) in paths:
            raise BadRecord(f"seed {int(seed)} given twice")
        paths[int(seed)] = path
    out = None
    for seed, path in paths.items():
        part = read_records(spark, path, schema).withColumn("seed", F.lit(seed))
        out = part if out is None else out.unionByName(part)
    return out


def write_jsonl(rows: DataFrame, path: str, order: Sequence[str] | None = None) -> int:
    """Canonical JSON lines; the number written. The commit protocol of the writer makes it all or nothing.

    With ``order``, the parts hold the rows in that order (part names sort like the rows).
    """
    from pyspark.sql import Observation

    seen = Observation()
    if order:
        rows = rows.orderBy(*order)
    rows.select(canonical_object(rows.columns).alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.text(path)
    return seen.get["n"]


def write_training(rows: DataFrame, path: str, name: str, order: str = "schedule_idx") -> tuple[int, int]:
    """Two sinks of one schedule in the same order: question and answer alone, and all columns."""
    return write_jsonl(rows.orderBy(order).select("question", "answer"), f"{path}/{name}_train.jsonl"), write_jsonl(rows, f"{path}/{name}_schedule.jsonl", [order])


def _file(spark: SparkSession, path: str):
    """(file system, path) of a path of any scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_json(path: str | os.PathLike, value: Any, spark: SparkSession | None = None) -> None:
    """Pretty JSON with sorted keys, put in place at once; with ``spark`` on any file system that it knows."""
    body = json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    if spark:
        fs, to = _file(spark, str(path))
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
        out = fs.create(part, True)
        out.write(bytearray(body.encode()))
        out.close()
        fs.delete(to, False)
        if not fs.rename(part, to):
            raise OSError(f"cannot put {path} in place")
        return
    to = Path(path)
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(to.name + ".part")
    part.write_text(body, encoding="utf-8")
    os.replace(part, to)


def read_object(path: str | os.PathLike, spark: SparkSession | None = None) -> dict[str, Any]:
    """A JSON file that must hold an object; with ``spark`` on any file system that it knows."""
    if spark:
        found = spark.read.text(str(path), wholetext=True).collect()
        body = found[0][0] if found else ""
    else:
        body = Path(path).read_text(encoding="utf-8")
    value = json.loads(body)
    if not isinstance(value, dict):
        raise BadRecord(f"not an object: {path}")
    return value


def sidecar(path: str | os.PathLike) -> dict[str, Any] | None:
    """The manifest beside a file (``<file>.manifest.json``), None if there is none."""
    beside = Path(f"{path}.manifest.json")
    return read_object(beside) if beside.exists() else None


def file_digests(spark: SparkSession, path: str, exclude: str = "manifest.json", chunk: int = 1 << 20) -> DataFrame:
    """(path, length, sha256) of every file below a folder, but the manifest that lies in the folder itself.

    Spark lists the files; each is read in chunks where its digest is made, so files of any size are taken.
    """
    fs, at = _file(spark, path)
    top = fs.makeQualified(at).toUri().getPath().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.where(~F.col("path").endswith(f"{top}/{exclude}"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                known, local = FileSystem.from_uri(name)
                h = hashlib.sha256()
                with known.open_input_stream(local) as f:
                    while block := f.read(chunk):
                        h.update(block)
                sums.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.string())], names=["path", "length", "sha256"])

    return files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(digest, "path string, length long, sha256 string")


def union_configs(parts: dict[str, DataFrame], column: str = "config") -> DataFrame:
    """UNION ALL of the tables of several configurations, each row with the name of its own."""
    out = None
    for name, part in parts.items():
        part = part.withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def level_numbers(spec: str) -> tuple[int, ...]:
    """Levels of a list such as ``1,2-4``: sorted, without repeats, within 1 to 5."""
    found: set[int] = set()
    for piece in spec.lower().replace("level", "").replace(";", ",").split(","):
        if piece.strip():
            ends = [int(x) for x in piece.split("-", 1)]
            found.update(range(min(ends), max(ends) + 1))
    if not found or min(found) < 1 or max(found) > 5:
        raise BadRecord(f"levels must be 1 to 5: {spec!r}")
    return tuple(sorted(found))


def level_tag(levels: Sequence[int]) -> str:
    run = len(levels) > 1 and list(levels) == list(range(levels[0], levels[-1] + 1))
    return f"l{levels[0]}{levels[-1]}" if run else "l" + "".join(map(str, levels))


def load_levels(rows: DataFrame, spec: str, seed: int, key: str = "idx") -> DataFrame:
    """Rows of the given levels with their ``position`` in a seeded order of digests."""
    from gradeloom.operators.ordering import stable_key

    chosen = rows.where(F.col("level").isin([f"Level {n}" for n in level_numbers(spec)]))
    return global_rank(chosen.withColumn("_k", stable_key(str(seed), F.col(key).cast("string"))), ["_k", key], "position").drop("_k")


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(key), key, "left_anti")


def whole_batches(saved: DataFrame, order: Sequence[str], batch: int) -> DataFrame:
    """The saved records of a run that was broken off, cut to a whole number of batches in their order."""
    n = saved.count()
    return saved.orderBy(*order).limit(n - n % batch)


def finished(summary_path: str, expected: dict[str, Any], spark: SparkSession | None = None) -> bool:
    """Whether a summary says ``complete`` under the same settings, so the work can be skipped.

    The path may be a pattern, on any file system that ``spark`` knows if it is given.
    """
    if spark:
        fs, at = _file(spark, summary_path)
        found = [str(s.getPath().toString()) for s in fs.globStatus(at) or []]
    else:
        found = glob.glob(summary_path)
    if not found:
        return False
    summary = read_object(sorted(found)[0], spark)
    return summary.get("stage") == "complete" and all(summary.get(k) == v for k, v in expected.items())
