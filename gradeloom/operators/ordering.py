"""Deterministic orders: salted digests, global ranks without a single-partition window, token deciles."""

from __future__ import annotations

import random
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.text import first_truthy
from gradeloom.operators.pairs import join_hot
from gradeloom.session import materialize

#: Most rows of a group that a window orders in one task.
WINDOW_ROWS = 2_000_000


def stable_key(salt: str | Column, *ids: Column) -> Column:
    """sha256 of the salt, a zero character and the first id that is neither null nor empty (``None`` if all are)."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return F.sha2(F.concat(salt, F.char(F.lit(0)), F.coalesce(first_truthy(*ids), F.lit("None"))), 256)


def global_rank(rows: DataFrame, order: Sequence[str | Column], to: str = "rank", start: int = 0) -> DataFrame:
    """Add the position of each row in a total order, without bringing all rows to one task.

    Rows are range-partitioned by the order and numbered in their partition; the offsets of the partitions, one row
    each, are added. Ties get different ranks, so the order should end in a unique column. Nulls come first.
    """
    sorted_rows = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    sorted_rows = materialize(sorted_rows, "ranked").withColumn("_p", F.shiftright("_at", 33)).withColumn("_i", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = sorted_rows.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_off"))  # one row per partition
    return sorted_rows.join(F.broadcast(offsets), "_p").withColumn(to, F.col("_off") + F.col("_i") + start).drop("_at", "_p", "_i", "_off")


def rank_within(rows: DataFrame, group: str, order: Sequence[str], largest: int, to: str = "rank") -> DataFrame:
    """Add the position of each row, from 1, within its group, of which none has more than ``largest`` rows.

    Small groups are windows. Where a group may be too large for a task all rows are range-partitioned by group and
    order, so a group is spread over tasks, and the place at which each group begins is taken off.
    """
    if largest <= WINDOW_ROWS:
        return rows.withColumn(to, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    ranked = global_rank(rows, [group, *order], "_place")
    begins = materialize(ranked.groupBy(group).agg(F.min("_place").alias("_begin")), "begins")
    return join_hot(ranked, begins, [group]).withColumn(to, F.col("_place") - F.col("_begin") + 1).drop("_place", "_begin")


def digest_share(digest: str) -> Column:
    """Where a hexadecimal digest lies among all digests, from 0 to 1."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def stable_order(rows: DataFrame, salt: str, ids: Sequence[str], tie: Sequence[str] = (), to: str = "position") -> DataFrame:
    """Add each row's position in the order of its salted digest; equal ids are ordered by ``tie``."""
    keyed = rows.withColumn("_k", stable_key(salt, *[F.col(c) for c in ids]))
    return global_rank(keyed, ["_k", *ids, *tie], to).drop("_k")


def token_deciles(rows: DataFrame, field: str, key: str, to: str) -> DataFrame:
    """Add min(9, floor(10 rank / n)) of the rank by (field, key) from 0; not the same as ntile(10). Nulls come first.

    Only field and key are ordered; the nine rows at which a decile begins are then compared with every row where it
    lies. Rows that are equal in both have one decile.
    """
    value, name = F.col(field).cast("long"), F.col(key).cast("string")
    ranked = global_rank(rows.select(value.alias("_v"), name.alias("_key")), ["_v", "_key"], "_rank")
    n = ranked.count()
    begins = [r for i in range(1, 10) if (r := -(-i * n // 10)) < n]
    edge = {r["_rank"]: r for r in ranked.where(F.col("_rank").isin(begins)).collect()}
    reached = [F.when(F.struct(value.alias("v"), name.alias("k")) >= F.struct(F.lit(edge[r]["_v"]).cast("long").alias("v"), F.lit(edge[r]["_key"]).cast("string").alias("k")), 1).otherwise(0) for r in begins]
    return rows.withColumn(to, sum(reached, F.lit(0)))


def seeded_permutation(n: int, seed: int) -> array:
    """Where a seeded Mersenne Twister shuffle of n items takes each position from, 8 bytes each."""
    places = array("q", range(n))
    random.Random(seed).shuffle(places)
    return places


def seeded_shuffle(rows: DataFrame, position: str, seed: int, to: str = "schedule_idx") -> DataFrame:
    """Number the rows as a seeded shuffle of the list in the order of ``position`` (0 .. n-1) would.

    The permutation depends on the number of rows and the seed alone, so tables of one length keep equal slots. Its
    steps depend on one another, so one task makes it, in 8 bytes a row, and hands it out in batches; the rows are
    joined with it where they lie or by a shuffle. ``hash_shuffle`` is the order without such a task.
    """
    n = rows.count()

    def permutation(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places = np.frombuffer(seeded_permutation(n, seed), np.int64)
                for low in range(0, n, 1 << 20):
                    part = places[low : low + (1 << 20)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(low, low + len(part)))], names=[position, to])

    table = rows.sparkSession.range(1, numPartitions=1).mapInArrow(permutation, f"{position} long, {to} long")
    return rows.drop(to).join(materialize(table, "permutation"), position)


def hash_shuffle(rows: DataFrame, seed: int, ids: Sequence[str], to: str = "schedule_idx") -> DataFrame:
    """The scalable shuffle: positions in a salted digest order, for any number of rows."""
    return stable_order(rows, f"shuffle-{seed}", ids, to=to)
