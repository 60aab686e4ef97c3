"""Sources mixed to target shares of the total size, small ones repeated at most a capped number of times.

Token weights are raked: in turn the cells (arm, source, topic, language) are scaled to the topic shares and the
language shares that the pool has by nature, and to the source targets, which come last. A cell's factor is the
expected number of copies of its documents and never exceeds the source's cap; what a capped cell cannot carry goes
to the other cells of its source. A source that is below its target when all its cells are at the cap cannot reach
it. Documents get the whole copies of their factor, and one more by the pivotal method with the rest as chance.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.calibration import as_category
from gradeloom.llm.pivotal import pivotal_sample
from gradeloom.operators.pairs import join_hot
from gradeloom.session import discard, materialize

#: Margins are raked until each is within this share of its goal.
CLOSE = 1e-4
#: Most rounds of raking, on the driver and on the cluster; those that end without being close are reported.
SWEEPS, CLUSTER_SWEEPS = 20_000, 1_000
#: Most cells that are raked on the driver; more are raked as tables.
LOCAL_CELLS = 100_000
#: Range of a topic's or language's factor, so that one all of whose cells are at their caps stays a number.
LEAST, MOST = 1e-12, 1e12

MARGINS = {"source": "fs", "topic": "ft", "language": "fl"}
WEIGHT = "least(cap, fs * coalesce(ft, 1d) * coalesce(fl, 1d))"


@dataclass
class Mix:
    """``pool``: the distinct rows with their factor; ``report``: one row per arm and listed source; ``margins``: one
    row per arm, dimension (source, topic or language) and value, with its goal, what it was raked to and the distance.

    ``furthest`` is the largest distance of a margin from its goal as a share of that, over ``CLOSE`` if raking did not converge.
    """

    pool: DataFrame
    report: DataFrame
    margins: DataFrame
    seed: str
    furthest: float = 0.0

    def rows(self) -> DataFrame:
        """(arm, schedule_idx, source, train_tokens, repeat): one row per copy, ``repeat`` from 1."""
        split = self.pool.withColumn("whole", F.floor("factor").cast("int")).withColumn("chance", F.col("factor") - F.floor("factor"))
        more = pivotal_sample(split, ["arm", "schedule_idx"], "chance", ["arm", "source", "train_tokens"], self.seed)
        copies = split.join(more.withColumn("extra", F.lit(1)), ["arm", "schedule_idx"], "left").withColumn("copies", F.col("whole") + F.coalesce("extra", F.lit(0)))
        return copies.where("copies > 0").select("arm", "schedule_idx", "source", "train_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("repeat"))

    def shares(self, rows: DataFrame) -> DataFrame:
        """``report`` with the rows, tokens and share that came out."""
        out = rows.groupBy("arm", "source").agg(F.count("*").alias("mixed_rows"), F.sum("train_tokens").alias("mixed_tokens"), F.max("repeat").alias("most_repeats"))
        totals = out.groupBy("arm").agg(F.sum("mixed_tokens").alias("mixed_total"))
        joined = self.report.join(out.withColumnRenamed("source", "_s"), (F.col("_s") == as_category(self.report.source)) & (out.arm == self.report.arm), "left").drop(out.arm).drop("_s")
        joined = joined.join(totals, "arm", "left")
        zero = ["mixed_rows", "mixed_tokens", "most_repeats", "mixed_total"]
        actual = F.col("mixed_tokens") / F.greatest(F.col("mixed_total"), F.lit(1))
        return joined.na.fill(0, zero).withColumn("actual_share", actual).withColumn("share_of_pool", F.col("mixed_tokens") / F.greatest(F.col("total_tokens"), F.lit(1)))


def mix(manifest: DataFrame, targets: DataFrame, languages: DataFrame | None = None, seed: str = "mix-v1") -> Mix:
    """Factors of the distinct (arm, schedule_idx) with repeat_id 0 and the report over all ``targets``.

    ``targets`` has (arm, source, target_share, max_repeats), ``languages`` (arm, schedule_idx, language). Sources are
    compared without outer blanks and letter case; rows of sources that no target lists stay out, a listed source
    without rows has pool 0, one listed twice counts once. A row delivered again counts once, with its smallest
    values; null or negative sizes are 0. The total of an arm is the pool of its listed sources; ``reachable`` tells
    whether the raked cells of a source reach its share of it, or are all at max_repeats and don't. Null topics and
    languages are left free. A null cap is no repetition.
    """
    rows = manifest.where("arm is not null and schedule_idx is not null and repeat_id = 0").groupBy("arm", "schedule_idx").agg(
        F.min(as_category("source")).alias("source"), F.min(as_category("topic")).alias("topic"), F.greatest(F.coalesce(F.min("train_tokens"), F.lit(0)), F.lit(0)).cast("long").alias("train_tokens")
    )
    cap = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("cap")
    listed = targets.where("arm is not null and source is not null and target_share is not null")
    listed = listed.groupBy("arm", as_category("source").alias("s")).agg(F.min(F.struct("source", "target_share", cap)).alias("t"))
    listed = materialize(listed.select("arm", F.col("s").alias("source"), F.col("t.source").alias("listed"), F.col("t.target_share").cast("double").alias("share"), F.col("t.cap").cast("double").alias("cap")), "targets")
    pool = join_hot(rows.where("source is not null"), listed.select("arm", "source", "cap"), ["arm", "source"])
    pool = pool.join(languages, ["arm", "schedule_idx"], "left") if languages is not None else pool.withColumn("language", F.lit(None).cast("string"))
    pool = materialize(pool, "pool")
    cells = materialize(pool.groupBy("arm", "source", "cap", "topic", "language").agg(F.sum("train_tokens").cast("double").alias("tokens")), "cells")

    few = cells.limit(LOCAL_CELLS + 1).toPandas()
    margins, furthest = _rake_here(few, listed.toPandas()) if len(few) <= LOCAL_CELLS else _rake_there(cells, listed)
    margins = materialize(margins, "margins")
    if furthest > CLOSE:
        warnings.warn(f"raking did not converge: a margin is {furthest:.2%} from its goal", stacklevel=2)

    # as integers the tokens of a source at its cap are exact
    reachable = ~(F.col("all_at_cap") & (F.col("raked_tokens") < F.col("goal_tokens")))
    report = margins.where("dimension = 'source'").withColumnRenamed("value", "source").join(listed, ["arm", "source"]).select(
        "arm", F.col("listed").alias("source"), F.col("share").alias("target_share"), F.col("cap").cast("int").alias("max_repeats"), F.col("pool_tokens").cast("long").alias("pool_tokens"),
        F.col("total_tokens").cast("long").alias("total_tokens"), F.col("goal_tokens").alias("target_tokens"), "raked_tokens", reachable.alias("reachable"),
    )
    shown = margins.select("arm", "dimension", "value", "pool_tokens", "goal_tokens", "raked_tokens", "distance")
    return Mix(with_factors(pool, margins).withColumn("factor", F.expr(WEIGHT)).drop(*MARGINS.values()), report, shown, seed, furthest)


def with_factors(rows: DataFrame, margins: DataFrame) -> DataFrame:
    """``rows`` with the factors of their source, topic and language; null topics and languages have none."""
    for c, f in MARGINS.items():
        mine = margins.where(F.col("dimension") == c).select("arm", F.col("value").alias(c), F.col("factor").alias(f))
        rows = join_hot(rows, mine, ["arm", c], "left")
    return rows


COLUMNS = "arm string, dimension string, value string, pool_tokens double, total_tokens double, goal_tokens double, raked_tokens double, distance double, all_at_cap boolean, factor double"


def _level(goal: float, cap: float, base: np.ndarray, tokens: np.ndarray) -> float:
    """The factor f at which the cells min(f base, cap) tokens add up to the goal, infinite where caps leave them short."""
    if goal >= cap * tokens.sum():
        return np.inf
    order = np.argsort(-base, kind="stable")  # those with the largest base reach the cap first
    b, t = base[order], tokens[order]
    full = np.concatenate(([0.0], np.cumsum(cap * t)))[:-1]  # carried by those at the cap before each
    rest = np.cumsum((b * t)[::-1])[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (goal - full) / rest
    fit = np.flatnonzero(f * b <= cap)
    return float(max(0.0, f[fit[0]])) if len(fit) else np.inf


def _rake_here(cells: pd.DataFrame, listed: pd.DataFrame) -> tuple[DataFrame, float]:
    """(margins, largest distance of one as a share of its goal), raked on the driver."""
    from pyspark.sql import SparkSession

    cells = cells.sort_values(["arm", "source", "topic", "language"], kind="stable").reset_index(drop=True)
    listed = listed.sort_values(["arm", "source"], kind="stable").reset_index(drop=True)
    tokens, caps = cells["tokens"].to_numpy(float), cells["cap"].to_numpy(float)
    names = [list(zip(listed["arm"], listed["source"]))]
    names += [sorted({(a, v) for a, v in zip(cells["arm"], cells[c]) if isinstance(v, str)}) for c in ("topic", "language")]
    at = []
    for c, known in zip(MARGINS, names):
        number = {k: i for i, k in enumerate(known)}
        at.append(np.array([number.get(k, -1) for k in zip(cells["arm"], cells[c])], np.int64))
    sizes = [len(n) for n in names]
    add = lambda k, w: np.bincount(np.where(at[k] < 0, sizes[k], at[k]), w, minlength=sizes[k] + 1)[: sizes[k]]
    natural = [add(k, tokens) for k in range(3)]
    arm_of = [np.array([a for a, _ in n], object) for n in names]
    total = {a: natural[0][arm_of[0] == a].sum() for a in set(arm_of[0])}
    goal = np.array([s * total[a] for a, s in zip(listed["arm"], listed["share"].astype(float))])
    cap = listed["cap"].to_numpy(float)
    mine = [np.flatnonzero(at[0] == i) for i in range(sizes[0])]
    f = [np.ones(n) for n in sizes]
    base = lambda: np.append(f[1], 1.0)[at[1]] * np.append(f[2], 1.0)[at[2]]
    weights = lambda: np.minimum(caps, f[0][at[0]] * base()) * tokens

    def wanted(k: int, now: np.ndarray) -> np.ndarray:
        """Goals of a margin: the targets as far as caps allow, or the natural shares at the size the known values have now."""
        if k == 0:
            return np.minimum(goal, cap * natural[0])
        want = np.zeros(sizes[k])
        for a in total:
            own = arm_of[k] == a
            known = natural[k][own].sum()
            want[own] = natural[k][own] / known * now[own].sum() if known > 0 else 0.0
        return want

    def distances() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        w = weights()
        out = []
        for k in range(3):
            now = add(k, w)
            want = wanted(k, now)
            out.append((now, want, np.divide(np.abs(now - want), want, out=np.zeros(sizes[k]), where=want > 0)))
        return out

    def sources() -> None:
        b = base()
        f[0] = np.array([_level(g, c, b[m], tokens[m]) for g, c, m in zip(goal, cap, mine)])

    furthest = 0.0
    sources()
    for turn in range(SWEEPS + 1):
        furthest = max((float(d.max(initial=0.0)) for _, _, d in distances()), default=0.0)
        if furthest <= CLOSE or turn == SWEEPS:
            break
        for k in (1, 2):
            now = add(k, weights())
            f[k] = np.clip(f[k] * np.divide(wanted(k, now), now, out=np.ones(sizes[k]), where=now > 0), LEAST, MOST)
        sources()
    capped = f[0][at[0]] * base() >= caps
    lines = []
    for k, (c, (now, want, far)) in enumerate(zip(MARGINS, distances())):
        for i, (a, v) in enumerate(names[k]):
            full = bool(capped[mine[i]].all()) if k == 0 else None
            aim = float(goal[i]) if k == 0 else float(want[i])
            lines.append((a, c, v, float(natural[k][i]), float(total[a]), aim, float(now[i]), float(far[i]), full, float(f[k][i])))
    return SparkSession.active().createDataFrame(lines, COLUMNS), furthest


def _rake_there(cells: DataFrame, listed: DataFrame) -> tuple[DataFrame, float]:
    """Like ``_rake_here`` for any number of cells and categories: each step is an aggregate of the cells joined with their factors."""
    arms = cells.groupBy("arm").agg(F.sum("tokens").alias("total_tokens"))
    natural = None
    for c in MARGINS:
        one = cells.where(F.col(c).isNotNull()).groupBy("arm", F.col(c).alias("value")).agg(F.sum("tokens").alias("pool_tokens")).withColumn("dimension", F.lit(c))
        natural = one if natural is None else natural.unionByName(one)
    goals = listed.select("arm", F.lit("source").alias("dimension"), F.col("source").alias("value"), "share", "cap")
    start = natural.join(goals, ["arm", "dimension", "value"], "full_outer").join(arms, "arm", "left").na.fill(0.0, ["pool_tokens", "total_tokens"])
    aim, most = F.col("share") * F.col("total_tokens"), F.col("cap") * F.col("pool_tokens")
    first = F.when(F.col("dimension") != "source", 1.0).when(aim >= most, float("inf")).otherwise(aim / F.col("pool_tokens"))
    margins = materialize(start.withColumn("goal_tokens", aim).withColumn("most", most).withColumn("factor", first), "margins")

    def seen(margins: DataFrame) -> DataFrame:
        """``margins`` with what each is now, what it should be and how far it is."""
        held = with_factors(cells, margins).select("arm", *MARGINS, (F.expr(WEIGHT) * F.col("tokens")).alias("w"), F.expr(WEIGHT + " >= cap").alias("full"))
        long = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in MARGINS]))
        now = held.select("arm", long.alias("m"), "w", "full").where("m.value is not null").groupBy("arm", "m.dimension", "m.value").agg(F.sum("w").alias("raked_tokens"), F.min("full").alias("all_at_cap"))
        base = margins.select("arm", "dimension", "value", "pool_tokens", "total_tokens", "goal_tokens", "most", "factor")
        both = base.join(now, ["arm", "dimension", "value"], "left").na.fill(0.0, ["raked_tokens"]).withColumn("all_at_cap", F.coalesce("all_at_cap", F.col("dimension") == "source"))
        sizes = both.groupBy("arm", "dimension").agg(F.sum("pool_tokens").alias("_pool"), F.sum("raked_tokens").alias("_now"))
        natural_goal = F.when(F.col("_pool") > 0, F.col("pool_tokens") / F.col("_pool") * F.col("_now")).otherwise(0.0)
        both = both.join(F.broadcast(sizes), ["arm", "dimension"]).withColumn("want", F.when(F.col("dimension") == "source", F.least("goal_tokens", "most")).otherwise(natural_goal)).drop("_pool", "_now")
        return both.withColumn("distance", F.when(F.col("want") > 0, F.abs(F.col("raked_tokens") - F.col("want")) / F.col("want")).otherwise(0.0))

    now = materialize(seen(margins), "margins")
    for _ in range(CLUSTER_SWEEPS):
        if now.agg(F.coalesce(F.max("distance"), F.lit(0.0))).first()[0] <= CLOSE:
            break
        for c in ("topic", "language", "source"):
            ratio = F.when((F.col("raked_tokens") > 0) & (F.col("want") > 0), F.col("want") / F.col("raked_tokens")).otherwise(1.0)
            moved = F.col("factor") * ratio
            moved = moved if c == "source" else F.greatest(F.lit(LEAST), F.least(F.lit(MOST), moved))
            last, now = now, materialize(seen(now.withColumn("factor", F.when(F.col("dimension") == c, moved).otherwise(F.col("factor")))), "margins")
            discard(last)
    furthest = now.agg(F.coalesce(F.max("distance"), F.lit(0.0))).first()[0]
    aim = F.when(F.col("dimension") == "source", F.col("goal_tokens")).otherwise(F.col("want"))
    return now.withColumn("goal_tokens", aim).select(*[c.split()[0] for c in COLUMNS.split(", ")]), float(furthest)
