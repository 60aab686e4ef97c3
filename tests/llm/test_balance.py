import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import calibration, mixing
from gradeloom.llm.pivotal import pivotal, pivotal_sample

MIX = "arm string, source string, target_share double, max_repeats int"
ROWS = "arm string, schedule_idx long, source string, topic string, repeat_id int, train_tokens int, s string, cap string"


def manifest(frame, n=600):
    rows = [("a", i, [" Big ", "big", "small"][0 if i % 7 == 0 else (2 if i % 10 == 0 else 1)], "t%d" % (i % 3) if i % 5 else None, 0, 50 + i % 30, "x", "y") for i in range(n)]
    rows += rows[:20] + [("a", 5000, "big", "t1", 1, 999, "x", "y"), ("a", 5001, "other", "t1", 0, 999, "x", "y"), ("a", 5002, None, None, 0, 5, "x", "y"), (None, 1, "big", "t1", 0, 5, "x", "y"), ("a", 5003, "big", "t1", 0, None, "x", "y")]
    return frame(rows, ROWS)


def test_mix_reaches_shares_within_caps(frame):
    targets = frame([("a", "BIG", 0.8, 1), ("a", "small ", 0.2, 4), ("a", "absent", 0.0, 1)], MIX)
    plan = mixing.mix(manifest(frame), targets)
    rows = plan.rows()
    out = {r.source.strip().lower(): r for r in plan.shares(rows).collect()}
    assert abs(out["big"].share_of_pool - 0.8) < 0.01 and abs(out["small"].share_of_pool - 0.2) < 0.01
    assert out["small"].most_repeats <= 4 and out["big"].most_repeats == 1 and out["absent"].mixed_tokens == 0
    assert rows.groupBy("arm", "schedule_idx", "repeat").count().where("count > 1").count() == 0


def test_mix_tells_what_cannot_be_reached(frame):
    targets = frame([("a", "big", 0.3, 1), ("a", "small", 0.6, 2), ("a", "absent", 0.1, 9), ("b", "big", 1.0, 1)], MIX)
    report = {(r.arm, r.source): r for r in mixing.mix(manifest(frame), targets).report.collect()}
    for r in report.values():
        assert r.reachable == (not r.max_repeats * r.pool_tokens < r.target_share * r.total_tokens)
    assert not report["a", "small"].reachable and not report["a", "absent"].reachable and report["a", "big"].reachable
    assert report["b", "big"].pool_tokens == 0 and report["b", "big"].reachable


def skewed(frame):
    sources = {"small": (1, 30), "mid": (3, 120), "big": (40, 9)}
    rows = [("a", 1000 * k + i, s, "t1" if i % 40 < n1 else "t%d" % (2 + i % n2 % 3), 0, 50 + i % 30, "x", "y") for k, (s, (n1, n2)) in enumerate(sources.items()) for i in range(300)]
    return frame(rows, ROWS), frame([("a", "small", 0.9, 2), ("a", "mid", 0.25, 3), ("a", "big", 0.08, 1)], MIX)


def test_mix_gives_all_copies_that_the_cap_allows(frame):
    rows, targets = skewed(frame)
    plan = mixing.mix(rows, targets)
    assert plan.pool.where("source = 'small' and factor < 2").count() == 0
    got = plan.shares(plan.rows()).where("source = 'small'").first()
    assert not got.reachable and got.mixed_tokens == 2 * got.pool_tokens


def test_mix_is_raked_until_margins_are_close_or_says_so(frame, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [("a", i, "abc"[int(rng.integers(3))], "t%d" % min(3, int(rng.exponential())), 0, 50 + i % 30, "x", "y") for i in range(900)]
    targets = frame([("a", "a", 0.5, 4), ("a", "b", 0.2, 4), ("a", "c", 0.3, 4)], MIX)
    plan = mixing.mix(frame(rows, ROWS), targets)
    tokens = lambda by, w: {r[0]: r[1] for r in plan.pool.groupBy(by).agg(F.sum(F.expr(w))).collect()}
    topics, natural, sources, total = tokens("topic", "factor * train_tokens"), tokens("topic", "train_tokens"), tokens("source", "factor * train_tokens"), sum(r[5] for r in rows)
    assert all(abs(topics[t] / natural[t] - 1) <= 2 * mixing.CLOSE for t in natural) and plan.furthest <= mixing.CLOSE
    assert all(abs(sources[s] / (share * total) - 1) <= mixing.CLOSE for s, share in [("a", 0.5), ("b", 0.2), ("c", 0.3)])
    monkeypatch.setattr(mixing, "SWEEPS", 0)
    with pytest.warns(UserWarning, match="did not converge"):
        assert mixing.mix(*skewed(frame)).furthest > mixing.CLOSE


def test_raked_as_tables_like_on_the_driver(frame, monkeypatch):
    rows = [("a", i, "xyz"[i % 3], "t%d" % (i // 3 % 2), 0, 50, "x", "y") for i in range(120)]
    rows = frame(rows + [("b", 1, "big", None, 0, 10, "x", "y"), ("b", 2, "big", "t9", 0, 10, "x", "y")], ROWS)
    targets = frame([("a", "x", 0.5, 4), ("a", "y", 0.1, 1), ("a", "z", 0.4, 1), ("a", "absent", 0.1, 3), ("b", "big", 1.0, 1)], MIX)
    monkeypatch.setattr(mixing, "CLUSTER_SWEEPS", 2)
    shares = lambda plan: {(r.arm, r.source): (r.reachable, round(r.raked_tokens / max(1, r.pool_tokens), 2)) for r in plan.report.collect()}
    here = shares(mixing.mix(rows, targets))
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
    assert shares(mixing.mix(rows, targets)) == here and here == {("a", "x"): (True, 1.5), ("a", "y"): (True, 0.3), ("a", "z"): (False, 1.0), ("a", "absent"): (False, 0.0), ("b", "big"): (True, 1.0)}


def test_arms_do_not_trade_rows(frame):
    rows = frame([(arm, i, s + arm, "t", 0, 40 + i * 7 % 60, "x", "y") for arm in "ab" for s, low, n in (("one", 0, 400), ("two", 400, 300)) for i in range(low, low + n)], ROWS)
    plan = mixing.mix(rows, frame([(arm, s + arm, share, 3) for arm in "ab" for s, share in (("one", 0.3), ("two", 0.7))], MIX))
    for r in plan.shares(plan.rows()).collect():
        assert abs(r.share_of_pool - r.target_share) < 0.008
    assert {r.dimension for r in plan.margins.collect()} == {"source", "topic"}


def test_mix_of_nothing(frame):
    targets = frame([("a", "big", 1.0, 1)], MIX)
    empty = mixing.mix(manifest(frame).limit(0), targets)
    assert empty.rows().count() == 0 and empty.report.count() == 1
    assert mixing.mix(manifest(frame), targets.limit(0)).report.count() == 0


TARGETS = "dimension string, category string, target_share double, min_rows int"
FRAME = "id long, topic string, decile int, n string, chance string"


def population(frame, n=2000):
    rows = [(i, ["A", "b ", "b", "c", None][i % 5] if i % 400 else "rare", i % 4, "x", "y") for i in range(n)]
    return frame(rows + rows[:30] + [(None, "a", 1, "x", "y")], FRAME)


def test_sample_follows_targets_and_floors(frame):
    goals = [("topic", "a", 0.3, 1), ("topic", "B", 0.5, 1), ("topic", "c", 0.2, 1), ("topic", "RARE", 0.0, 4), ("topic", "none", 0.0, 2), ("decile", "0", 0.4, 1), ("decile", "1", 0.2, 1), ("decile", "2", 0.2, 1), ("decile", "3", 0.2, 1), ("decile", None, 0.1, 1)]
    plan = calibration.calibrate(population(frame), frame(goals, TARGETS), "id", ["topic", "decile"])
    sample = plan.sample()
    report = {(r.dimension, r.category): r for r in plan.sampled_report(sample).collect()}
    assert len(report) == 9
    for c, share in (("a", 0.3), ("B", 0.5), ("c", 0.2)):
        assert abs(report["topic", c].sampled_share - share) < 0.03
    assert abs(report["decile", "0"].sampled_share - 0.4) < 0.03
    assert report["topic", "RARE"].sampled >= 4
    assert report["topic", "none"].unmet and not report["topic", "a"].unmet
    assert sample.count() == sample.select("id").distinct().count()
    again = plan.sample()
    assert sorted(r.id for r in sample.collect()) == sorted(r.id for r in again.collect())


def test_unmet_targets_like_the_rule(frame):
    goals = [("topic", "a", 0.9, 1), ("topic", "b", 0.1, 1), ("topic", "c", 0.0, 5000)]
    report = calibration.calibrate(population(frame), frame(goals, TARGETS), "id", ["topic", "decile"]).report.collect()
    for r in report:
        n = int(0.25 * r.eligible_in_dimension)
        assert r.unmet == (r.eligible < r.min_rows or r.eligible < r.target_share * n)


def test_conflicts_are_told(frame):
    goals = [("topic", "a", 0.2, 1), ("topic", "b", 0.8, 1), ("decile", "0", 0.999, 2000), ("decile", "1", 0.001, 1)]
    report = {(r.dimension, r.category): r for r in calibration.calibrate(population(frame), frame(goals, TARGETS), "id", ["topic", "decile"]).report.collect()}
    assert report["decile", "0"].unmet and report["decile", "0"].expected_rows == report["decile", "0"].eligible
    clash = report["topic", "a"]
    assert clash.conflict and not clash.unmet and clash.conflicts_with == "decile=0" and clash.forced_rows > 0


def test_ways_to_solve_agree(frame, monkeypatch):
    goals = frame([("topic", "a", 0.3, 1), ("topic", "B", 0.5, 1), ("topic", "c", 0.2, 1), ("decile", "0", 0.4, 1), ("decile", "1", 0.2, 1), ("decile", "2", 0.2, 1), ("decile", "3", 0.2, 1)], TARGETS)
    chances = lambda: calibration.calibrate(population(frame), goals, "id", ["topic", "decile"]).chances.groupBy("topic", "decile").agg(F.max("chance")).collect()
    close = lambda got: max(abs(x - known[t, d]) for t, d, x in got) < 0.01
    known = {(t, d): x for t, d, x in chances()}
    monkeypatch.setattr(calibration, "DENSE", 0)
    assert close(chances())
    monkeypatch.setattr(calibration, "DENSE", 2000)
    monkeypatch.setattr(calibration, "LOCAL_CELLS", 0)
    assert close(chances())


def test_sample_of_nothing(frame):
    goals = frame([("topic", "a", 1.0, 1)], TARGETS)
    plan = calibration.calibrate(population(frame).limit(0), goals, "id", ["topic", "decile"])
    assert plan.sample().count() == 0 and plan.report.first().unmet
    assert calibration.calibrate(population(frame), goals.limit(0), "id", ["topic"]).sample().count() == 0


def test_pivotal_keeps_sums_and_chances():
    rng = np.random.default_rng(1)
    chances = rng.uniform(0, 1, 40)
    chances[:3] = (0.0, 1.0, 0.5)
    hits = np.zeros(40)
    for _ in range(4000):
        chosen, held, a = pivotal(chances, rng.uniform(size=40))
        total = chosen.sum() + (a if held >= 0 else 0)
        assert abs(total - chances.sum()) < 1e-6
        hits += chosen
        if held >= 0 and rng.uniform() < a:
            hits[held] += 1
    assert np.abs(hits / 4000 - chances).max() < 0.04


def test_pivotal_sample_in_blocks(spark, frame):
    df = spark.range(5000).selectExpr("id as k", "0.2 as p")
    n = pivotal_sample(df, ["k"], "p", ["k"], "seed", block_rows=100).count()
    assert abs(n - 1000) <= 1
