"""Samples whose shares by category follow given targets, with a minimum from each category.

The chance of a row is the exponential tilt of a coin by its categories, with one multiplier per target. The dual is
solved by Newton steps; its gradient and Hessian are the category moments of the chances, summed over the cells
(combinations of categories with their counts): on the driver where they are few, else where they lie. Categories
that need all their rows are fixed at chance 1, the limit of their multiplier. The sample is drawn by the pivotal
method along the cells and floors that chance left unmet are filled up. A target all of whose rows have chance 1 and
that still expects too few is unmet; one that other targets keep away from its rows is reported as a conflict.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.moments import add_up
from gradeloom.llm.pivotal import pivotal_sample, uniform
from gradeloom.session import materialize

#: Share of the eligible rows that is drawn.
RATE = 0.25
#: Slack of a target for each unit of its multiplier, in rows: targets that contradict each other meet in between.
SLACK = 0.5
#: Most Newton steps, and rows that a target may be off for them to end.
STEPS, CLOSE = 200, 0.01
#: Most cells whose moments are summed on the driver.
LOCAL_CELLS = 100_000
#: Most targets with a whole Hessian. Beyond it the steps are of one dimension at a time, whose Hessian is diagonal.
DENSE = 2000
#: Share of a target's rows, one row at least, by which others may shift it before it counts as a conflict.
CONFLICT = 0.01


def as_category(c: Column | str) -> Column:
    """A value as it is compared: a string without outer blanks and letter case."""
    return F.lower(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))


@dataclass
class Target:
    dimension: str
    category: str
    listed: str
    share: float
    floor: int
    eligible: int = 0
    least: float = 0.0
    rows: float = 0.0
    whole: bool = False


@dataclass
class Calibration:
    """``report`` and ``sample`` are lazy; ``chances`` has (key, categories, chance).

    ``residual`` is how many rows the free targets were off, slack aside, when the Newton steps ended.
    """

    chances: DataFrame
    report: DataFrame
    key: str
    dimensions: list[str]
    targets: list[Target]
    seed: str
    residual: float = 0.0

    def sample(self) -> DataFrame:
        """The sampled keys with their categories and how they were chosen (``calibrated`` or ``floor``)."""
        drawn = pivotal_sample(self.chances, [self.key], "chance", self.dimensions, self.seed)
        drawn = materialize(self.chances.join(drawn, self.key).select(self.key, *self.dimensions), "drawn")
        out = drawn.withColumn("chosen", F.lit("calibrated"))
        rest = self.chances.join(drawn.select(self.key), self.key, "left_anti")
        for d in self.dimensions:
            floors = [(t.category, min(t.floor, t.eligible)) for t in self.targets if t.dimension == d and t.floor > 0]
            if not floors:
                continue
            need = self.chances.sparkSession.createDataFrame(floors, "c string, floor long")
            have = drawn.groupBy(F.col(d).alias("c")).agg(F.count("*").alias("have"))
            short = need.join(have, "c", "left").select("c", (F.col("floor") - F.coalesce("have", F.lit(0))).alias("short")).where("short > 0")
            # a floor is a small number; a category's rows are cut to it by partial ranks before they meet
            place = F.row_number().over(Window.partitionBy(d).orderBy(uniform(self.seed + ":floor", self.key), self.key))
            extra = rest.join(F.broadcast(short), rest[d] == short.c).withColumn("_place", place).where("_place <= short")
            out = out.unionByName(extra.select(self.key, *self.dimensions, F.lit("floor").alias("chosen")))
        return out.groupBy(self.key, *self.dimensions).agg(F.min("chosen").alias("chosen"))

    def sampled_report(self, sample: DataFrame) -> DataFrame:
        """``report`` with the sampled rows, their share of the dimension's sampled rows and the gap to the target."""
        counts = None
        for d in self.dimensions:
            one = sample.where(F.col(d).isNotNull()).groupBy(F.col(d).alias("_c")).agg(F.count("*").alias("sampled")).select(F.lit(d).alias("dimension"), "_c", "sampled")
            counts = one if counts is None else counts.unionByName(one)
        counts = counts.withColumn("_all", F.sum("sampled").over(Window.partitionBy("dimension")))
        joined = self.report.withColumn("_c", as_category("category")).join(counts, ["dimension", "_c"], "left").drop("_c")
        share = F.coalesce(F.col("sampled") / F.col("_all"), F.lit(0.0))
        return joined.withColumn("sampled", F.coalesce("sampled", F.lit(0))).withColumn("sampled_share", share).withColumn("gap", share - F.col("target_share")).drop("_all")


def calibrate(rows: DataFrame, targets: DataFrame, key: str, dimensions: list[str], rate: float = RATE, seed: str = "sample-v1") -> Calibration:
    """Chances of the distinct keys of ``rows`` and the report over all ``targets``.

    ``targets`` has (dimension, category, target_share, min_rows). Values are compared as strings without outer
    blanks and letter case; a key delivered again counts once, with its smallest values; a null value is eligible for
    nothing in its dimension. A dimension's n is ``rate`` of its eligible rows, rounded down. A target is ``unmet`` if
    all eligible rows of the category have chance 1 and these are fewer than its floor or than its share of n.
    ``conflict`` tells that it is met or could be, but is expected to get other than its rows, because of the rows
    that ``conflicts_with`` needs (``forced_rows`` of its own are among them) or of values that no target lists:
    these have share 0. A dimension without targets does not bind. Targets with a null dimension, category or share
    are left out, one listed twice counts once; an empty table makes every target with a floor or share unmet.
    """
    frame = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(as_category(d)).alias(d) for d in dimensions])
    frame = materialize(frame, "frame")
    listed = targets.where("dimension is not null and category is not null and target_share is not null").where(F.col("dimension").isin(dimensions))
    found = listed.collect()  # the list of targets is a parameter
    known: dict[tuple[str, str], Target] = {}
    for r in sorted(found, key=lambda r: (r["dimension"], r["category"])):
        c = r["category"].strip().lower()
        known.setdefault((r["dimension"], c), Target(r["dimension"], c, r["category"], float(r["target_share"]), int(r["min_rows"] or 0)))
    order = list(known.values())
    used = [d for d in dimensions if any(t.dimension == d for t in order)]

    cells = materialize(frame.groupBy(*dimensions).agg(F.count("*").alias("n")), "cells")
    few = cells.limit(LOCAL_CELLS + 1).toPandas()
    few = few.sort_values(dimensions, kind="stable") if len(few) <= LOCAL_CELLS else None
    index = {(t.dimension, t.category): i for i, t in enumerate(order)}

    def summed(of) -> tuple[np.ndarray, ...]:
        """The sums of ``of`` over all cells."""
        if few is None:
            return add_up(cells, of)
        return of(few) if len(few) else None

    counts = summed(lambda batch: _sizes(batch, used, index, len(order))) if used else None
    eligible = dict.fromkeys(used, 0)
    if counts is not None:
        eligible = {d: int(n) for d, n in zip(used, counts[0])}
        for t, n in zip(order, counts[1]):
            t.eligible = int(n)
    for t in order:
        n = int(rate * eligible[t.dimension])
        t.least = max(t.share * n, t.floor)
        t.rows = float(min(t.eligible, t.least))
        t.whole = t.rows >= t.eligible
    multipliers, residual = _solve(summed, order, used, rate) if used else (np.zeros(0), 0.0)
    if residual > CLOSE:
        warnings.warn(f"the dual was not solved: a target is {residual:.2f} rows off", stacklevel=2)

    @F.pandas_udf("double")
    def chance(*columns):
        import pandas as pd

        return pd.Series(_chances([c.tolist() for c in columns], used, index, order, multipliers))

    chances = frame.withColumn("chance", chance(*[F.col(d) for d in used]) if used else F.lit(0.0))
    sums = summed(lambda batch: _moments(batch, used, index, order, multipliers, "none")[:2]) if used else None
    sure, other = (np.zeros(len(order)), np.zeros(len(order))) if sums is None else sums
    whole = [i for i, t in enumerate(order) if t.whole and t.rows > 0]
    shared = summed(lambda batch: (_shared(batch, used, index, order, whole),)) if whole else None
    lines = []
    for i, (t, s, o) in enumerate(zip(order, sure, other)):
        expected = float(s + o)
        saturated = expected >= t.eligible  # every eligible row has chance 1
        unmet = saturated and expected < t.least
        conflict = not unmet and abs(expected - t.rows) > max(1.0, CONFLICT * t.rows)
        names = ", ".join(f"{order[j].dimension}={order[j].listed}" for k, j in enumerate(whole) if shared[0][i, k] and j != i) if conflict and shared is not None else ""
        plain = t.eligible < t.floor or t.eligible < t.share * int(rate * eligible[t.dimension])
        if unmet != plain:
            raise AssertionError(f"the fit of {t.dimension}={t.listed} disagrees with its rows")
        lines.append((t.dimension, t.listed, t.share, t.floor, t.eligible, eligible[t.dimension], t.rows, expected, unmet, conflict, int(s), names))
    schema = "dimension string, category string, target_share double, min_rows long, eligible long, eligible_in_dimension long, target_rows double, expected_rows double, unmet boolean, conflict boolean, forced_rows long, conflicts_with string"
    return Calibration(chances, rows.sparkSession.createDataFrame(lines, schema), key, dimensions, order, seed, residual)


def _sizes(batch, used: list[str], index: dict, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a value in each dimension, rows of each target)."""
    at = _indices([batch[d].tolist() for d in used], used, index)
    n = batch["n"].to_numpy().astype(float)
    counts = np.zeros(m)
    for a in range(len(used)):
        counts += np.bincount(np.where(at[:, a] >= 0, at[:, a], m), n, minlength=m + 1)[:m]
    return np.where(at != -1, n[:, None], 0.0).sum(axis=0), counts


def _shared(batch, used: list[str], index: dict, order: list[Target], whole: list[int]) -> np.ndarray:
    """(targets, whole targets): rows that both have."""
    at = _indices([batch[d].tolist() for d in used], used, index)
    n = batch["n"].to_numpy().astype(float)
    m = len(order)
    out = np.zeros((m, len(whole)))
    for k, j in enumerate(whole):
        mine = (at == j).any(axis=1)
        for a in range(len(used)):
            out[:, k] += np.bincount(np.where(at[mine, a] >= 0, at[mine, a], m), n[mine], minlength=m + 1)[:m]
    return out


def _indices(columns: list[list], used: list[str], index: dict) -> np.ndarray:
    """(rows, dimensions): number of the target of each value, -1 for null, -2 for a value without target."""
    out = np.full((len(columns[0]), len(used)), -1, np.int64)
    for j, (d, values) in enumerate(zip(used, columns)):
        out[:, j] = [-1 if v is None or v != v else index.get((d, v), -2) for v in values]
    return out


def _fixed(at: np.ndarray, order: list[Target]) -> np.ndarray:
    """Whether a row belongs to a category that needs all its rows."""
    whole = np.array([t.whole and t.rows > 0 for t in order] + [False])
    return np.where(at >= 0, whole[np.maximum(at, -1)], False).any(axis=1)


def _chances(columns: list[list], used: list[str], index: dict, order: list[Target], multipliers: np.ndarray) -> np.ndarray:
    at = _indices(columns, used, index)
    z = np.where(at >= 0, np.append(multipliers, 0.0)[np.maximum(at, -1)], 0.0).sum(axis=1)
    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    p[(at == -2).any(axis=1) | (at == -1).all(axis=1)] = 0.0
    p[_fixed(at, order)] = 1.0
    return p


def _moments(batch, used, index, order, multipliers, bends: str) -> tuple[np.ndarray, ...]:
    """(category sums of the chances that are 1, of the others, their derivatives, the dual's first part).

    ``bends``: the derivatives as a whole matrix, as its diagonal or none.
    """
    at = _indices([batch[d].tolist() for d in used], used, index)
    n = batch["n"].to_numpy().astype(float)
    p = _chances([batch[d].tolist() for d in used], used, index, order, multipliers)
    m = len(order)
    safe = np.where(at >= 0, at, m)
    fixed = _fixed(at, order)
    free = (p > 0) & ~fixed
    first, sure = np.zeros(m + 1), np.zeros(m + 1)
    second = np.zeros((m + 1) * (m + 1) if bends == "whole" else m + 1)
    mean, bent = np.where(free, n * p, 0.0), np.where(free, n * p * (1 - p), 0.0)
    for a in range(len(used)):
        first += np.bincount(safe[:, a], mean, minlength=m + 1)
        sure += np.bincount(safe[:, a], np.where(fixed, n, 0.0), minlength=m + 1)
        if bends == "diagonal":
            second += np.bincount(safe[:, a], bent, minlength=m + 1)
        for b in range(len(used) if bends == "whole" else 0):
            second += np.bincount(safe[:, a] * (m + 1) + safe[:, b], bent, minlength=len(second))
    z = np.append(multipliers, 0.0)[safe].sum(axis=1)
    dual = (n * np.logaddexp(0.0, np.clip(z, -40, 40)))[free].sum()
    second = second.reshape(m + 1, m + 1)[:m, :m] if bends == "whole" else second[:m]
    return sure[:m], first[:m], second, np.array([dual])


def _solve(summed, order: list[Target], used: list[str], rate: float) -> tuple[np.ndarray, float]:
    """(multipliers at which the expected rows of the free targets equal their target rows, rows they are off at most)."""
    m = len(order)
    index = {(t.dimension, t.category): i for i, t in enumerate(order)}
    multipliers = np.full(m, np.log(rate / (1 - rate)) / max(1, len(used)))
    free = np.array([not t.whole and t.rows > 0 for t in order], bool)
    multipliers[[not t.whole and t.rows <= 0 for t in order]] = -40.0
    start = multipliers.copy()
    dense = m <= DENSE
    sums = summed(lambda batch: _moments(batch, used, index, order, multipliers, "none"))
    if sums is None or not free.any():
        return multipliers, 0.0
    want = np.maximum(0.0, np.array([t.rows for t in order]) - sums[0])  # what the fixed rows leave open

    def at(x: np.ndarray):
        _, first, second, dual = summed(lambda batch: _moments(batch, used, index, order, x, "whole" if dense else "diagonal"))
        off = np.where(free, x - start, 0.0)
        gradient = np.where(free, first - want + SLACK * off, 0.0)
        return dual[0] - x[free] @ want[free] + SLACK / 2 * (off @ off), gradient, second

    value, gradient, hessian = at(multipliers)
    parts = [free] if dense else [p for d in used if (p := free & np.array([t.dimension == d for t in order])).any()]
    still = 0
    for turn in range(STEPS * len(parts)):
        if np.abs(gradient).max() < CLOSE or still >= len(parts):
            break
        part = parts[turn % len(parts)]
        step = np.zeros(m)
        if dense:
            step[part] = np.linalg.solve(hessian[np.ix_(part, part)] + SLACK * np.eye(part.sum()), gradient[part])
        else:
            step[part] = gradient[part] / (hessian[part] + SLACK)
        scale = min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        for _ in range(12):
            trial = multipliers - scale * step
            new = at(trial)
            if new[0] <= value - 1e-4 * scale * (gradient @ step) or np.abs(scale * step).max() < 1e-6:
                break
            scale /= 2
        still = still + 1 if np.abs(trial - multipliers).max() < 1e-6 else 0
        multipliers, (value, gradient, hessian) = trial, new
    return multipliers, float(np.abs(gradient).max())
