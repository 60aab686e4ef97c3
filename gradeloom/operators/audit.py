"""Audits that return what violates them, so an empty result passes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.pairs import join_hot
from gradeloom.session import materialize


class Violation(ValueError):
    """An audit that found something."""


def require_empty(violations: DataFrame, what: str, sample: int = 10) -> None:
    """Fail with a few examples unless the table is empty."""
    rows = violations.limit(sample).collect()
    if rows:
        raise Violation(f"{what}: {[r.asDict() for r in rows]}")


def require_columns(rows: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(rows.columns))
    if missing:
        raise Violation(f"missing columns {missing}")


def null_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, nulls) of each column, in one pass; a column the table lacks is null in every row."""
    has = lambda c: F.count_if(F.col(c).isNull()) if c in rows.columns else F.count("*")
    one = rows.agg(F.count("*").alias("_n"), *[has(c).alias(f"c_{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("rows"), F.col(f"c_{i}").alias("nulls")) for i, c in enumerate(columns)])
    return one.select(F.explode(cells).alias("r")).select("r.*")


def duplicate_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, copies) of keys that come more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def uniqueness(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, rows, distinct_values, is_unique), in one pass."""
    one = rows.agg(F.count("*").alias("_n"), *[F.countDistinct(c).alias(f"c_{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("rows"), F.col(f"c_{i}").alias("distinct_values")) for i, c in enumerate(columns)])
    return one.select(F.explode(cells).alias("r")).select("r.*").withColumn("is_unique", F.col("rows") == F.col("distinct_values"))


def out_of_range(rows: DataFrame, columns: Sequence[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows with a value of ``columns`` that is null, below ``low`` or above ``high``."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
        if low is not None:
            bad = bad | (F.col(c) < low)
        if high is not None:
            bad = bad | (F.col(c) > high)
    return rows.where(bad)


def not_binary(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(0, 1))


def constant_drift(rows: DataFrame, expected: dict[str, Any]) -> DataFrame:
    """(column, expected, wrong_rows, wrong_values): columns with values other than the one expected; nulls differ."""
    differs = lambda c, v: ~F.col(c).eqNullSafe(F.lit(v))
    aggs = []
    for i, (c, v) in enumerate(expected.items()):
        aggs += [F.count_if(differs(c, v)).alias(f"n_{i}"), F.array_sort(F.collect_set(F.when(differs(c, v), F.coalesce(F.col(c).cast("string"), F.lit("None"))))).alias(f"v_{i}")]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(str(v)).alias("expected"), F.col(f"n_{i}").alias("wrong_rows"), F.col(f"v_{i}").alias("wrong_values")) for i, (c, v) in enumerate(expected.items())])
    return rows.agg(*aggs).select(F.explode(cells).alias("r")).select("r.*").where("wrong_rows > 0")


def not_single_valued(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct_values, nulls) of columns that don't hold one non-null value throughout."""
    one = rows.agg(*[x for i, c in enumerate(columns) for x in (F.countDistinct(c).alias(f"d_{i}"), F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "None")).alias(f"n_{i}"))])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{i}").alias("distinct_values"), F.col(f"n_{i}").alias("nulls")) for i, c in enumerate(columns)])
    return one.select(F.explode(cells).alias("r")).select("r.*").where("distinct_values <> 1 or nulls > 0")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys of one table that the other lacks, ``missing`` from b or ``extra`` in b."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.join(right, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(right.join(left, key, "left_anti").withColumn("side", F.lit("extra")))


def shared_keys(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Distinct keys both tables have (a leak where there should be none)."""
    return a.select(F.col(key_a).alias(key_b)).where(F.col(key_b).isNotNull()).intersect(b.select(key_b))


def group_completeness(rows: DataFrame, group: Sequence[str], sample: str) -> DataFrame:
    """(group, rows, samples, first, last, complete): whether the samples are 0 .. n-1, each once."""
    out = rows.groupBy(*group).agg(F.count("*").alias("rows"), F.countDistinct(sample).alias("samples"), F.min(sample).alias("first"), F.max(sample).alias("last"))
    return out.withColumn("complete", (F.col("rows") == F.col("samples")) & (F.col("first") == 0) & (F.col("last") == F.col("rows") - 1))


def not_determined(rows: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """(key, variants): keys whose values differ between rows; nulls count as a value."""
    as_one = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(as_one).alias("variants")).where("variants > 1")


def positional_difference(a: DataFrame, b: DataFrame, position: str, columns: Sequence[str]) -> DataFrame:
    """(position, status): positions that only one table has, or at which a column differs (nulls equal)."""
    left = a.select(position, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_a"))
    right = b.select(position, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(~same, "differs")
    return left.join(right, position, "full_outer").withColumn("status", status).where("status is not null").select(position, "status")


def mismatches(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of both tables at which a column differs (nulls equal)."""
    pairs = a.select(key, F.col(column).alias("_x")).join(b.select(key, F.col(column).alias("_y")), key)
    return pairs.where(~F.col("_x").eqNullSafe(F.col("_y"))).select(key)


def closure_join(items: DataFrame, results: DataFrame, key: str, what: str = "items and results") -> DataFrame:
    """The inner join of two tables that must have equal, unique keys."""
    require_empty(duplicate_keys(items, [key]), f"repeated keys in {what}")
    require_empty(duplicate_keys(results, [key]), f"repeated keys in {what}")
    require_empty(key_difference(items, results, key), f"keys of {what} differ")
    return items.join(results, key)


def require_rows(rows: DataFrame, exactly: int | None = None, at_least: int | None = None, what: str = "table") -> int:
    """The number of rows; fails if it isn't the one expected or is too small."""
    n = rows.count()
    if (exactly is not None and n != exactly) or (at_least is not None and n < at_least):
        raise Violation(f"{what} has {n} rows, expected {exactly if exactly is not None else f'{at_least} or more'}")
    return n


def first_rows(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of a stated order, which should end in a unique column."""
    return rows.orderBy(*order).limit(n)


def flag_members(rows: DataFrame, members: DataFrame, key: str, to: str) -> DataFrame:
    """Add whether the key of a row is among the keys of another table; a null key is no member."""
    keys = materialize(members.select(key).where(F.col(key).isNotNull()).distinct().withColumn(to, F.lit(True)), "members")
    return join_hot(rows.drop(to), keys, [key], "left").withColumn(to, F.coalesce(to, F.lit(False)))


def overlap(a: DataFrame, b: DataFrame, column_a: str, column_b: str) -> DataFrame:
    """One row (distinct_a, distinct_b, shared): how many distinct values both columns have, without nulls."""
    side = lambda df, c, flag: df.select(F.col(c).alias("v"), F.lit(flag).alias("side")).where("v is not null")
    values = side(a, column_a, 1).unionByName(side(b, column_b, 2)).groupBy("v").agg(F.bit_or("side").alias("sides"))
    return values.agg(F.count_if(F.col("sides") != 2).alias("distinct_a"), F.count_if(F.col("sides") != 1).alias("distinct_b"), F.count_if(F.col("sides") == 3).alias("shared"))


def single_across(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """(table, values, same): distinct values of a column in each of several tables, and whether all hold one and the same."""
    both = None
    for name, t in tables.items():
        part = t.select(F.lit(name).alias("table"), F.col(column).cast("string").alias("v"))
        both = part if both is None else both.unionByName(part)
    counts = both.groupBy("table").agg(F.countDistinct(F.coalesce("v", F.lit("None"))).alias("values"), F.count_if(F.col("v").isNull()).alias("nulls"))
    total = both.agg((F.countDistinct(F.coalesce("v", F.lit("None"))) == 1).alias("_one"), F.count_if(F.col("v").isNull()).alias("_nulls"))
    return counts.crossJoin(F.broadcast(total)).select("table", "values", (F.col("_one") & (F.col("_nulls") == 0)).alias("same"))


def conditional_counts(rows: DataFrame, by: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """(by, n, one count for each value of ``column``), in one pass."""
    counts = [F.count_if(F.col(column) == v).alias(str(v)) for v in values]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *counts)


def provenance(rows: DataFrame, pinned: dict[str, Any], single: Sequence[str] = (), filled: Sequence[str] = ()) -> DataFrame:
    """(column, problem, rows): what breaks the provenance of evaluation records; an empty result passes.

    ``missing``: a column the table lacks; ``drifted``: rows whose value isn't the pinned one; ``not single``: columns
    with several values; ``null``: rows without a value. One pass over the rows.
    """
    wanted = [*pinned, *[c for c in [*single, *filled] if c not in pinned]]
    missing = [c for c in wanted if c not in rows.columns]
    empty = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin("", "None")
    checks = [(c, "drifted", F.count_if(~F.col(c).eqNullSafe(F.lit(v)))) for c, v in pinned.items() if c not in missing]
    checks += [(c, "not single", F.when(F.countDistinct(c) > 1, F.count("*")).otherwise(0)) for c in single if c not in missing]
    checks += [(c, "null", F.count_if(empty(c))) for c in {*single, *filled} if c not in missing]
    checks += [(c, "missing", F.count("*")) for c in missing]
    one = rows.agg(*[agg.cast("long").alias(f"c_{i}") for i, (_, _, agg) in enumerate(checks)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"), F.col(f"c_{i}").alias("rows")) for i, (c, p, _) in enumerate(checks)])
    return one.select(F.explode(cells).alias("r")).select("r.*").where("rows > 0")


def group_modes(rows: DataFrame, group: Sequence[str], sample: str, constants: Sequence[str]) -> DataFrame:
    """``group_completeness`` that also asks each group for one non-null value of every column in ``constants``."""
    each = [F.countDistinct(c).alias(f"_d{i}") for i, c in enumerate(constants)] + [F.count(c).alias(f"_n{i}") for i, c in enumerate(constants)]
    out = rows.groupBy(*group).agg(F.count("*").alias("rows"), F.countDistinct(sample).alias("samples"), F.min(sample).alias("first"), F.max(sample).alias("last"), *each)
    uniform = F.lit(True)
    for i, _ in enumerate(constants):
        uniform = uniform & (F.col(f"_d{i}") == 1) & (F.col(f"_n{i}") == F.col("rows"))
    complete = (F.col("rows") == F.col("samples")) & (F.col("first") == 0) & (F.col("last") == F.col("rows") - 1)
    return out.withColumn("uniform", uniform).withColumn("complete", complete & F.col("uniform")).drop(*[f"_d{i}" for i in range(len(constants))], *[f"_n{i}" for i in range(len(constants))])


def profile_join(items: DataFrame, single: DataFrame, sampled: DataFrame, key: str, sample: str, k: int) -> DataFrame:
    """Items with their one ``single`` result and their k ``sampled`` results, after the keys are proved closed.

    Both tables of results must have the same keys, each known to ``items``; ``single`` one row and ``sampled`` the
    samples 0 .. k-1 for each. Columns other than the key that several tables have must be named apart before.
    """
    require_empty(duplicate_keys(items, [key]), "repeated items")
    require_empty(duplicate_keys(single, [key]), "repeated single results")
    complete = group_completeness(sampled, [key], sample)
    require_empty(complete.where(~F.col("complete") | (F.col("rows") != k)), f"keys without the samples 0 to {k - 1}")
    require_empty(key_difference(single, sampled, key), "keys of the results differ")
    require_empty(key_difference(single, items, key).where("side = 'missing'"), "results of unknown items")
    return items.join(single, key).join(sampled, key)


def profile_closure(items: DataFrame, single: DataFrame, sampled: DataFrame, key: str, sample: str, k: int) -> DataFrame:
    """(status, n): how the keys of a profile close, over the keys of all three tables."""
    one = lambda df, c: df.groupBy(key).agg(F.count("*").alias(c))
    complete = group_completeness(sampled, [key], sample).select(key, F.col("rows").alias("_s"), (F.col("complete") & (F.col("rows") == k)).alias("_c"))
    both = one(items, "_i").join(one(single, "_g"), key, "full_outer").join(complete, key, "full_outer")
    status = (
        F.when(F.col("_i").isNull(), "unknown item").when(F.col("_i") > 1, "repeated item").when(F.col("_g").isNull() & F.col("_s").isNull(), "no result").when(F.col("_g").isNull(), "no single result")
        .when(F.col("_g") > 1, "repeated single result").when(F.col("_s").isNull(), "no samples").when(~F.col("_c"), "incomplete samples").otherwise("closed")
    )
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def closed_set(probes: DataFrame, held_out: DataFrame, expected: int, key: str) -> DataFrame:
    """One row (held_out_rows, expected, shared, valid): a held-out set has its registered size and no key of ``probes``."""
    one = overlap(probes, held_out, key, key).select("shared")
    n = held_out.agg(F.count("*").alias("held_out_rows"))
    return n.crossJoin(F.broadcast(one)).select("held_out_rows", F.lit(expected).cast("long").alias("expected"), "shared", ((F.col("held_out_rows") == expected) & (F.col("shared") == 0)).alias("valid"))
