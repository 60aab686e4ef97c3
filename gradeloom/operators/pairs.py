"""Pairs inside groups and joins on keys that many rows share, spread so that a hot key is no single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.session import materialize

#: Most rows of keys that are sent to all workers at once.
BROADCAST_KEYS = 1_000_000
#: A key with more rows than this is hot where the keys are too many to be sent.
HOT_ROWS = 200_000


def join_hot(rows: DataFrame, keys: DataFrame, on: Sequence[str], how: str = "inner", most: int = BROADCAST_KEYS, known: int | None = None) -> DataFrame:
    """Join with ``keys``, a written table of short rows that has each key once; a key may have any number of ``rows``.

    Up to ``most`` keys are sent to the workers, so the rows stay where they lie. Beyond that only the hot keys are
    sent, of which there are at most as many as ``HOT_ROWS`` goes into the number of rows; all others are joined by a
    shuffle. ``how``: inner, left or left_semi; null keys match nothing. ``known``: the number of keys, if known.
    """
    on = list(on)
    if (keys.count() if known is None else known) <= most:
        return rows.join(F.broadcast(keys), on, how)
    hot = materialize(rows.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS).select(*on), "hot")
    if hot.isEmpty():
        return rows.join(keys, on, how)
    hot = F.broadcast(hot)
    sent = F.broadcast(keys.join(hot, on, "left_semi"))
    return rows.join(hot, on, "left_semi").join(sent, on, how).unionByName(rows.join(hot, on, "left_anti").join(keys, on, how))


def pairs_within(rows: DataFrame, group: str, key: str, kind: str, block: int = 2000, carry: Sequence[str] = (), keep: str | None = None) -> DataFrame:
    """(group, id_a, id_b) with id_a < id_b: rows of one group whose ``kind`` differs; null groups have no pairs.

    Groups with one ``kind`` are dropped by a partial aggregate before any row meets its partners. A group of n rows
    is cut into ceil(n / block) parts: one side of the join lies in one part, the other is sent to all of them, so no
    task holds more than ``block`` rows of the first side of a group. ``keep`` is a condition on the columns in
    ``carry``, which end in ``_a`` and ``_b`` there; pairs that fail it are dropped where they are made.
    """
    rows = rows.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.col(kind).alias("_c"), *carry).where("_g is not null")
    groups = (
        rows.groupBy("_g")
        .agg(F.count("*").alias("_n"), F.min("_c").alias("_lo"), F.max("_c").alias("_hi"))
        .where("_lo < _hi")
        .select("_g", F.ceil(F.col("_n") / block).cast("int").alias("_parts"))
    )
    members = join_hot(rows, materialize(groups, "groups"), ["_g"]).distinct()
    side = lambda s: [F.col("_k").alias(f"id_{s}"), F.col("_c").alias(f"_c{s}"), *[F.col(c).alias(f"{c}_{s}") for c in carry]]
    left = members.select("_g", *side("a"), F.pmod(F.xxhash64("_k"), F.col("_parts")).cast("int").alias("_part"))
    right = members.select("_g", *side("b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    pairs = left.join(right, ["_g", "_part"]).where("id_a < id_b and _ca <> _cb")
    return (pairs.where(keep) if keep else pairs).select(F.col("_g").alias(group), "id_a", "id_b").distinct()
