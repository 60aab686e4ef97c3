import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.canonical import canonical_json
from gradeloom.operators import audit, ordering, pairs, sampling, similarity, stats
from gradeloom.operators import schedule as S
from gradeloom.operators.graph import connected_components
from gradeloom.operators.pairs import pairs_within
from gradeloom.session import materialize


def corpus(rng, n):
    return [(f"h{i:04d}", rng.choice(["algebra", "calculus", None]), rng.choice(["4.0", "4.5", "5.0", "5.5"]), rng.randrange(3), rng.randrange(3), rng.randrange(1, 60)) for i in range(n)]


CORPUS = "row_hash string, topic string, difficulty_bucket string, solution_token_decile int, prompt_token_decile int, tokens int"
FIELDS = ["topic", "difficulty_bucket"]


def take_model(rows, n, fields, salt):
    """A sequential model of the proportional take, on (row_hash, stratum) rows."""
    groups = {}
    for r in rows:
        groups.setdefault(canonical_json([r[1], r[2]][: len(fields)] if fields == FIELDS else [r[2]]), []).append(r[0])
    quota = {k: int(n * len(g) / len(rows)) for k, g in groups.items()}
    by_rest = sorted(groups, key=lambda k: (n * len(groups[k]) / len(rows) - quota[k], k), reverse=True)
    for k in by_rest[: n - sum(quota.values())]:
        quota[k] += 1
    chosen = [h for k, g in groups.items() for h in sorted(g, key=lambda h: sampling._order(f"{salt}:{k}", h))[: quota[k]]]
    return sorted(chosen, key=lambda h: sampling._order(salt + ":final", h))


@pytest.mark.parametrize(("size", "n"), [(97, 31), (60, 60), (60, 0), (40, 7)])
def test_proportional_take(frame, size, n):
    rows = corpus(random.Random(size + n), size)
    got = sampling.proportional_take(frame(rows, CORPUS), n, FIELDS, "s").orderBy("position").collect()
    assert [r.row_hash for r in got] == take_model(rows, n, FIELDS, "s") and [r.position for r in got] == list(range(n))


def test_take_more_than_there_is(frame):
    with pytest.raises(ValueError):
        sampling.hamilton_quota(frame(corpus(random.Random(1), 5), CORPUS), 6, FIELDS)


def test_round_robin(frame):
    rows = corpus(random.Random(7), 50)
    got = [r.row_hash for r in sampling.stratified_take(frame(rows, CORPUS), 20, FIELDS, "s").orderBy("position").collect()]
    queues = {}
    for h, *rest in sorted(rows, key=lambda r: sampling._order("s", r[0])):
        queues.setdefault(canonical_json(rest[:2]), []).append(h)
    want = []
    while len(want) < 20:
        for k in sorted(queues):
            if queues[k] and len(want) < 20:
                want.append(queues[k].pop(0))
    assert got == want


def test_deciles_are_not_ntile(frame):
    rows = [(f"r{i:02d}", i // 2) for i in range(13)]
    got = {r.row_hash: r.d for r in ordering.token_deciles(frame(rows, "row_hash string, t int"), "t", "row_hash", "d").collect()}
    assert got == {f"r{i:02d}": min(9, 10 * i // 13) for i in range(13)}


def test_stable_key_skips_empty_ids(frame):
    rows = frame([("", "q", None), (None, None, ""), ("a", "b", "c")], "a string, b string, c string")
    got = [r[0] for r in rows.select(ordering.stable_key("s", F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [sampling._order("s", x) for x in ("q", "None", "a")]


def test_seeded_shuffle_is_the_list_shuffle(frame):
    places = list(range(40))
    random.Random(42).shuffle(places)
    got = ordering.seeded_shuffle(frame([(i,) for i in range(40)], "pos long"), "pos", 42).orderBy("schedule_idx").collect()
    assert [r.pos for r in got] == places
    assert ordering.seeded_shuffle(frame([], "pos long"), "pos", 42).count() == 0


def test_bin_quotas():
    assert sampling.bin_quotas({"hard": 50, "frontier": 90, "anchor": 90}, 100) == {"hard": 20, "frontier": 60, "anchor": 20}
    assert sampling.bin_quotas({"hard": 5, "frontier": 90, "anchor": 90}, 100) == {"hard": 5, "frontier": 75, "anchor": 20}
    assert sampling.bin_quotas({"hard": 50, "frontier": 30, "anchor": 90}, 100) == {"hard": 20, "frontier": 30, "anchor": 50}
    with pytest.raises(ValueError):
        sampling.bin_quotas({"hard": 100, "frontier": 10, "anchor": 10}, 100)


def test_repair_meets_quotas_with_few_swaps(frame):
    rng = random.Random(3)
    rows = corpus(rng, 200)
    master = frame(rows, CORPUS)
    base = frame(sorted(rows, key=lambda r: r[2])[:60], CORPUS)  # all from the low buckets
    fixed = sampling.repair_quota(master, base, 60)
    want = {r["difficulty_bucket"]: r["quota"] for r in sampling.hamilton_quota(master, 60, ["difficulty_bucket"]).collect()}
    got = Counter(r.difficulty_bucket for r in fixed.collect())
    assert dict(got) == {k: v for k, v in want.items() if v}
    assert fixed.select("row_hash").distinct().count() == 60
    nested = sampling.nested_take(master, 60, ["topic", "difficulty_bucket", "solution_token_decile"])
    assert dict(Counter(r.difficulty_bucket for r in nested.collect())) == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("seed", [3, 4])
def test_repair_as_tables_is_the_one_on_the_driver(frame, monkeypatch, seed):
    rows = corpus(random.Random(seed), 60)
    master, base = frame(rows, CORPUS), frame(sorted(rows, key=lambda r: r[2])[:24], CORPUS)
    here = {r.row_hash for r in sampling.repair_quota(master, base, 24).collect()}
    monkeypatch.setattr(sampling, "REPAIR_ROWS", 0)
    assert {r.row_hash for r in sampling.repair_quota(master, base, 24).collect()} == here


def test_takes_with_groups_too_large_for_a_window(frame, monkeypatch):
    rows = frame(corpus(random.Random(6), 150), CORPUS)
    takes = lambda: ([tuple(r) for r in sampling.proportional_take(rows, 40, FIELDS, "s").orderBy("position").collect()], [tuple(r) for r in sampling.stratified_take(rows, 40, FIELDS, "s").orderBy("position").collect()])
    windows = takes()
    for module in (ordering, sampling):
        monkeypatch.setattr(module, "WINDOW_ROWS", 1)
    assert takes() == windows


def test_joins_on_hot_keys(frame, monkeypatch):
    rows = frame([(1, i) for i in range(50)] + [(2, 60), (3, 70), (None, 80)], "k long, v long")
    keys = frame([(1, "a"), (2, "b"), (9, "c")], "k long, w string")
    got = lambda how, **kw: sorted(map(str, pairs.join_hot(rows, keys, ["k"], how, **kw).collect()))
    monkeypatch.setattr(pairs, "HOT_ROWS", 10)
    for how in ("inner", "left", "left_semi"):
        assert got(how) == got(how, most=0)
    assert len(got("inner")) == 51 and len(got("left", most=0)) == 53


def test_conditions_on_pairs(frame):
    rows = frame([("g", i, i % 3, i) for i in range(9)], "g string, k long, c int, n int")
    out = {tuple(r)[1:] for r in pairs.pairs_within(rows, "g", "k", "c", block=2, carry=["n"], keep="n_b - n_a <= 2").collect()}
    assert out == {(i, j) for i in range(9) for j in range(i + 1, min(9, i + 3)) if i % 3 != j % 3}


def test_counts_flags_and_overlaps(frame):
    a, b = frame([(1, "x"), (1, "x"), (2, "y"), (None, None)], "k long, v string"), frame([(2, "y"), (3, None)], "k long, v string")
    assert audit.require_rows(a, exactly=4) == 4 and audit.require_rows(a, at_least=2) == 4
    for bad in ({"exactly": 3}, {"at_least": 5}):
        with pytest.raises(audit.Violation):
            audit.require_rows(a, **bad)
    assert [r.k for r in audit.first_rows(a.where("k is not null"), ["k", "v"], 2).collect()] == [1, 1]
    assert sorted((r.k or 0, r.known) for r in audit.flag_members(a, b, "k", "known").collect()) == [(0, False), (1, False), (1, False), (2, True)]
    assert tuple(audit.overlap(a, b, "v", "v").first()) == (2, 1, 1) and tuple(audit.overlap(a.limit(0), b, "v", "v").first()) == (0, 1, 0)
    assert {tuple(r) for r in audit.single_across({"a": a, "b": b}, "v").collect()} == {("a", 3, False), ("b", 2, False)}
    assert {tuple(r) for r in audit.single_across({"a": a.where("k = 1"), "b": a.where("k = 1")}, "v").collect()} == {("a", 1, True), ("b", 1, True)}
    assert {tuple(r) for r in audit.conditional_counts(a, ["v"], "k", [1, 2]).collect()} == {("x", 2, 2, 0), ("y", 1, 0, 1), (None, 1, 0, 0)}
    assert tuple(audit.closed_set(a, b, 2, "v").first()) == (2, 2, 1, False) and audit.closed_set(a.where("k = 1"), b, 2, "v").first().valid


def test_provenance(frame):
    rows = frame([("v2", "e", "m"), ("v1", "e", "None"), ("v2", "f", " ")], "ruler string, eval string, manifest string")
    got = {tuple(r) for r in audit.provenance(rows, {"ruler": "v2", "prompt": "p"}, ["eval"], ["manifest"]).collect()}
    assert got == {("ruler", "drifted", 1), ("prompt", "missing", 3), ("eval", "not single", 3), ("manifest", "null", 2)}
    assert audit.provenance(rows.limit(0), {"ruler": "v2"}, ["eval"]).count() == 0


def test_profiles_close(frame):
    items, single = frame([("a",), ("b",), ("c",)], "h string"), frame([("a", 1), ("b", 0)], "h string, g int")
    sampled = frame([(h, i, 0) for h in "ab" for i in range(3)], "h string, s int, x int")
    assert audit.profile_join(items, single, sampled, "h", "s", 3).count() == 6
    for broken in (sampled.where("s < 2"), sampled.where("h = 'a'"), sampled.unionByName(sampled.limit(1))):
        with pytest.raises(audit.Violation):
            audit.profile_join(items, single, broken, "h", "s", 3)
    with pytest.raises(audit.Violation):
        audit.profile_join(items.where("h <> 'a'"), single, sampled, "h", "s", 3)
    assert {tuple(r) for r in audit.profile_closure(items, single, sampled.where("h = 'a' or s = 1"), "h", "s", 3).collect()} == {("closed", 1), ("incomplete samples", 1), ("no result", 1)}
    modes = audit.group_modes(frame([("a", 0, "m"), ("a", 1, "m"), ("b", 0, "m"), ("b", 1, None), ("c", 0, "m"), ("c", 1, "n")], "h string, s int, mode string"), ["h"], "s", ["mode"])
    assert {r.h: r.complete for r in modes.collect()} == {"a": True, "b": False, "c": False}


def test_schedule_report(frame):
    schema = "schedule_idx long, source string, source_row_hash string, source_question_hash string, source_family_hash string, assistant_tokens int, prompt_tokens int, train_tokens int"
    rows = [(0, "a", None, None, None, 1, 2, 3), (1, "math_replay", "r", "q", "f", 1, 2, 3), (1, "math_replay", "r", "q", "f", 1, 2, 3), (3, "math_replay", "r", "q2", "f", 1, 2, 3), (4, "math_replay", "s", None, "f", 1, 2, None)]
    report = S.schedule_report(frame(rows, schema), frame([(0,), (1,), (3,), (7,)], "train_idx long"))
    got = {r.check: r.value for r in report.collect()}
    assert got == {
        "rows": 4, "replay_rows": 3, "replay_sources": 1, "replay_questions": 2, "replay_families": 1, "assistant_tokens": 4, "prompt_tokens": 8, "train_tokens": 9, "bad_repeated_positions": 0, "bad_gaps": 1,
        "bad_without_training_row": 1, "bad_without_schedule_row": 1, "bad_replay_identity": 1, "bad_replay_drift": 1,
    }
    assert {tuple(r) for r in S.recorded_differences(report, {"rows": 4, "train_tokens": 10, "kept": 2}).collect()} == {("train_tokens", 9, 10), ("kept", None, 2)}


def test_runs_pair_only_if_they_close(frame):
    schema = "idx long, seed int, right int, q string"
    base, runs = frame([(1, None, 0, "a"), (2, None, 1, "b")], schema).drop("seed"), frame([(1, 7, 1, "a"), (2, 7, 1, "b"), (1, 8, 0, "a"), (2, 8, 0, "b")], schema)
    assert {tuple(r) for r in stats.paired_runs(base, runs, "idx", "right", "q").collect()} == {(1, 7, 0, 1), (2, 7, 1, 1), (1, 8, 0, 0), (2, 8, 1, 0)}
    for broken in (runs.where("not (idx = 2 and seed = 8)"), runs.unionByName(frame([(3, 7, 1, "c")], schema)), runs.unionByName(runs.limit(1)), runs.withColumn("q", F.lit("a"))):
        with pytest.raises(audit.Violation):
            stats.paired_runs(base, broken, "idx", "right", "q")


def test_strata_of_a_checked_corpus(frame):
    from gradeloom.plans.schedule import checked_strata

    schema = "row_hash string, question_hash string, family_hash string, topic string, difficulty double, prompt_tokens int, assistant_tokens int, train_tokens int"
    rows = [(f"r{i}", f"q{i}", f"f{i}", "t", 4.0 + i % 5, 5, 5 + i, 10 + i) for i in range(20)]
    dev = frame([("q99", "f99")], "question_hash string, family_hash string")
    assert checked_strata(frame(rows, schema), dev).count() == 16
    for bad in (rows + [("x", "q1", "fx", "t", 5.0, 5, 5, 5)], rows + [("x", "qx", "fx", "t", 5.0, 0, 5, 5)], rows + [("x", "qx", "fx", "t", 5.0, 5, 5, 5000)], rows + [("x", "q99", "fx", "t", 5.0, 5, 5, 5)], rows + [("x", "qx", "f99", "t", 5.0, 5, 5, 5)]):
        with pytest.raises(audit.Violation):
            checked_strata(frame(bad, schema), dev)
    assert checked_strata(frame(rows + [("x", "q99", "fx", "t", 9.0, 5, 5, 5)], schema), dev).count() == 16  # outside the range


def test_corpus_sizes():
    from gradeloom.plans.schedule import corpus_sizes

    assert [corpus_sizes(n, *r)[1:] for n, r in ((25_000, (4, 8)), (15_000, (4, 8)), (15_000, (5, 7)), (25_000, (5, 7)), (9_000, (4, 8)))] == [(4000, 20_000), (2000, 10_000), (0, 0), (4000, 20_000), (0, 0)]


def test_flags_near_vectors(frame):
    vectors = frame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.05])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.nearest) for r in similarity.near_any(vectors, vectors.where("vec_id in (0, 1)"), 0.99).collect()}
    assert got == {(0, 1), (1, 0), (5, 1)} and similarity.near_any(vectors, vectors.limit(0), 0.5).count() == 0


def test_repair_prefers_equal_strata_then_topics():
    inside = [("a", "4.0", "t", 1, 1), ("b", "4.0", "u", 1, 1)]
    outside = [("c", "5.0", "t", 1, 1), ("d", "5.0", "u", 2, 2)]
    assert sampling.plan_repair(inside, outside, {"4.0": 1, "5.0": 1}) == ({"c"}, {"a"})
    assert sampling.plan_repair(inside, outside[1:], {"4.0": 1, "5.0": 1}) == ({"d"}, {"b"})
    with pytest.raises(ValueError):
        sampling.plan_repair(inside[:1], outside[1:], {"4.0": 0, "5.0": 1})


def test_replay_deduplication_is_the_sequential_one(frame):
    rng = random.Random(8)
    for _ in range(5):
        question_of = {f"q{i}": f"f{rng.randrange(4)}" for i in range(8)}
        rows = [(f"r{i}", q := rng.choice(list(question_of)), question_of[q], i) for i in range(30)]
        seen_q, seen_f, want = set(), set(), {}
        for h, q, f, _ in rows:
            want[h] = "dropped_exact" if q in seen_q else "dropped_family" if f in seen_f else "kept"
            if want[h] == "kept":
                seen_q.add(q)
                seen_f.add(f)
        df = S.deduplicate_replay(frame(rows, "row_hash string, question_hash string, family_hash string, input_pos long"))
        assert {r.row_hash: r.outcome for r in df.collect()} == want
        assert S.replay_audit(df).first().closed


def test_exposures(frame):
    pool = frame([(f"r{i}", i) for i in range(7)], "row_hash string, x int")
    order = sorted((f"r{i}" for i in range(7)), key=lambda h: sampling._order("replay-v1", h))
    got = S.replay_exposures(pool, 17).orderBy("exposure").collect()
    assert [(r.exposure, r.repeat_id, r.row_hash) for r in got] == [(i, i // 7, order[i % 7]) for i in range(17)]
    assert S.expand_exposures(pool, 21, "s").groupBy("row_hash").count().where("count <> 3").count() == 0
    with pytest.raises(ValueError):
        S.expand_exposures(pool, 20, "s")
    with pytest.raises(ValueError):
        S.replay_exposures(pool.limit(0), 3)


def test_mcnemar(frame):
    cases = [(a, b) for a in range(12) for b in range(12)] + [(400, 350), (0, 900), (2000, 1900)]

    def p(a, b):
        d = a + b
        return 1.0 if not d else min(1.0, 2 * sum(math.comb(d, k) for k in range(min(a, b) + 1)) / 2**d)

    got = frame(cases, "a long, b long").select("a", "b", stats.mcnemar_p(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(p(r.a, r.b), rel=1e-9)


def test_gate_in_doubles_and_whole_numbers(frame):
    rows = frame([(500, 0.5, 0.51, 5, 0), (500, 0.5, 0.508, 4, 0)], "n long, base_acc double, treat_acc double, improved long, regressed long")
    assert [r.passed_exactly for r in stats.gate(rows).collect()] == [True, False]


def test_distribution_and_gap(frame):
    a, b = frame([("x",), ("x",), (None,), ("y",)], "t string"), frame([("x",), ("z",)], "t string")
    assert {r.value: r.fraction for r in stats.distribution(a, ["t"]).collect()} == {"x": 0.5, "None": 0.25, "y": 0.25}
    assert stats.distribution_gap(a, b, ["t"]).first().gap == 0.5
    assert stats.distribution(a.limit(0), ["t"]).count() == 0


def test_record_metrics(frame):
    rows = frame([(1, 1, 10, 1, "x"), (0, 1, 20, None, "y"), (1, 0, 40, 0, None)], "strict_correct int, fallback_correct int, generated_tokens int, hit_max int, text string")
    m = stats.record_metrics(rows, text="text").first()
    assert (m.n, m.median_tokens, m.contract_violations, m.repetition_loop_rate) == (3, 20.0, 1, 0.0) and m.hit_max_rate == pytest.approx(1 / 3)
    assert stats.record_metrics(rows.limit(0)).count() == 0


def test_bootstrap(frame):
    rng = random.Random(1)
    values = [(i, rng.choice([-1.0, 0.0, 1.0, 1.0])) for i in range(60)]
    r = stats.hash_bootstrap(frame(values, "place long, value double"), 200, 7).first()
    assert r.estimate == pytest.approx(sum(v for _, v in values) / 60) and r.ci95_low < r.estimate < r.ci95_high
    with pytest.raises(ValueError):
        stats.hash_bootstrap(frame([], "place long, value double"), 10, 7)


def test_bootstrap_is_that_of_all_draws(frame):
    import hashlib
    import numpy as np

    values = [0.0, 1.0, -1.0, 0.5, 1.0, 0.0, -0.5]
    draw = lambda r, i: values[int(hashlib.md5(f"{r},{i},3".encode()).hexdigest()[:8], 16) % 7]
    means = [sum(draw(r, i) for i in range(7)) / 7 for r in range(10_000)]
    got = stats.hash_bootstrap(frame(list(enumerate(values)), "place long, value double"), 10_000, 3).first()
    assert got.reps == 10_000 and [got.ci95_low, got.ci95_high] == pytest.approx(np.percentile(means, [2.5, 97.5]).tolist())


def test_audits(frame):
    rows = frame([("a", 0, "q1"), ("a", 1, "q2"), ("b", 1, None), ("b", 1, None), (None, 5, "x")], "k string, n int, q string")
    assert {r.k for r in audit.duplicate_keys(rows, ["k"]).collect()} == {"a", "b"}
    assert {r.k: r.complete for r in audit.group_completeness(rows, ["k"], "n").collect()} == {"a": True, "b": False, None: False}
    assert [r.k for r in audit.not_determined(rows, "k", ["q"]).collect()] == ["a"]
    assert audit.not_binary(rows, "n").count() == 1 and audit.out_of_range(rows, ["n"], 1, 4).count() == 2
    assert {(r.k, r.side) for r in audit.key_difference(rows, frame([("a",), ("z",)], "k string"), "k").collect()} == {("b", "missing"), ("z", "extra"), (None, "missing")}
    assert {r.column: r.wrong_rows for r in audit.constant_drift(rows, {"n": 1, "k": "a"}).collect()} == {"n": 2, "k": 3}
    assert {r.column for r in audit.not_single_valued(rows, ["k", "n"]).collect()} == {"k", "n"}
    assert {r.column: r.nulls for r in audit.null_counts(rows, ["q", "absent"]).collect()} == {"q": 2, "absent": 5}
    with pytest.raises(audit.Violation):
        audit.require_empty(rows, "rows")
    with pytest.raises(audit.Violation):
        audit.closure_join(rows, rows, "k")
    with pytest.raises(audit.Violation):
        audit.require_columns(rows, ["k", "gone"])
    a, b = frame([(0, "x"), (1, "y"), (2, None)], "i long, v string"), frame([(0, "x"), (1, "z"), (2, None), (3, "n")], "i long, v string")
    assert {(r.i, r.status) for r in audit.positional_difference(a, b, "i", ["v"]).collect()} == {(1, "differs"), (3, "only_b")}


def test_components(frame):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.component for r in connected_components(frame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert connected_components(frame([], "a long, b long")).count() == 0


def test_pairs_of_a_hot_group(frame):
    rows = [("g", i, i % 3) for i in range(60)] + [("h", i, 1) for i in range(50)] + [(None, 1, 1), (None, 2, 2), ("g", 0, 0)]
    got = {(r.id_a, r.id_b) for r in pairs_within(frame(rows, "g string, k long, c int"), "g", "k", "c", block=7).collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 3 != b % 3}


@pytest.mark.parametrize("measure", ["jaccard", "containment"])
def test_similar_pairs_lose_none(frame, measure):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdef ", k=80)) for _ in range(12)]
    rows = [(i, b) for i, b in enumerate(base)] + [(100 + i, b[:40] + "zz" + b[41:]) for i, b in enumerate(base)] + [(200, None), (201, ""), (202, "abc")]
    df = frame(rows, "k long, t string")
    grams = {k: {t[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set() for k, t in ((k, " ".join((t or "").split())) for k, t in rows)}
    want = set()
    for a, x in grams.items():
        for b, y in grams.items():
            if x and y and len(x & y) / (len(x | y) if measure == "jaccard" else len(y)) >= 0.7:
                want.add((a, b))
    assert {(r.probe, r.ref) for r in similarity.similar_pairs(df, df, "k", "k", "t", "t", 0.7, measure).collect()} == want
    best = {r.probe: r for r in similarity.nearest_match(df, df, "k", "k", "t", "t", other=True).collect()}
    assert best[0].ref == 100 and best[201].score == 0.0 and best[201].ref is None


@pytest.mark.parametrize("same", [True, False])
def test_jaccard_pairs_of_texts_with_common_pieces(frame, same, monkeypatch):
    """Texts of few sentences, so that every piece is in very many; none is lost and no rejected pair is written."""
    rng = random.Random(9)
    sentences = ["".join(rng.choices("abcdefghé ", k=50)) for _ in range(10)]
    texts = [" ".join(rng.sample(sentences, 5)) + f" {rng.randrange(100)}" for _ in range(150)]
    texts += [t[: (at := rng.randrange(len(t)))] + "zzz" + t[at + rng.choice([0, 3, 40]) :] for t in texts[:60]]
    texts += ["abc", "abd", "wort für wort " * 20, "".join(rng.choices("abcdefgh", k=2000)), "".join(rng.choices("abcdefgh", k=700))]
    texts += [texts[-2][:1700] + "y" * 30, texts[-1][20:], ""]
    rows = [(i, " ".join(t.split())) for i, t in enumerate(texts)]
    grams = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} if t else set() for _, t in rows]
    want = {(a, b): len(x & y) / len(x | y) for a, x in enumerate(grams) for b, y in enumerate(grams) if x and y and 4 * len(x & y) >= 3 * len(x | y)}
    sent = []
    monkeypatch.setattr(similarity, "SKETCH_BLOCK", 60, raising=False)
    monkeypatch.setattr(similarity, "SCANS_AT_ONCE", 2, raising=False)
    monkeypatch.setattr(similarity, "materialize", lambda df, name="step": sent.append((name, out := materialize(df, name))) or out)
    df = frame(rows, "k long, t string")
    got = {(r.probe, r.ref): r.score for r in similarity.similar_pairs(df, df if same else df.select("k", "t"), "k", "k", "t", "t", 0.75).collect()}
    assert got == want
    assert sum(out.count() for name, out in sent if name not in ("texts", "sketches")) < 4 * len(want) + 4 * len(rows)


def test_nearest_vectors(frame):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(20)] + [(50, [0.0, 0.0]), (51, None)]
    got = similarity.nearest_vectors(frame(rows, "vec_id long, embedding array<double>").where("vec_id < 3"), frame(rows, "vec_id long, embedding array<double>"), 2)
    for r in got.collect():
        order = sorted((j for j in range(20) if j != r["query"]), key=lambda j: (-math.cos(r["query"] - j), j))
        assert order[r["rank"] - 1] == r.neighbour


def test_three_way_and_diversity(frame):
    base = frame([(1, 0), (2, 1)], "idx long, ok int")
    large, small = frame([(1, 42, 1), (2, 42, 1)], "idx long, seed int, ok int"), frame([(1, 42, 0), (3, 42, 1)], "idx long, seed int, ok int")
    assert [tuple(r) for r in stats.three_way(base, large, small, "idx", "ok").select("idx", "seed", "base", "large", "small").collect()] == [(1, 42, 0, 1, 0)]
    interval = frame([(0.03, 0.01, 0.05), (0.03, -0.01, 0.05), (0.01, 0.005, 0.02)], "estimate double, ci95_low double, ci95_high double")
    assert [r.success for r in stats.diversity_decision(True, interval).collect()] == [True, False, False]
    assert not any(r.success for r in stats.diversity_decision(False, interval).collect())
