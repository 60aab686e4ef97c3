"""A bounded sample of rows that does not depend on their order or partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def few_rows(rows: DataFrame, n: int, by: list[str], columns: list[str]) -> list[Row]:
    """At most ``n`` rows, those with the smallest hashes of ``by``; some rows of ``rows`` must be fit for the sample.

    A bound on the hash, from the number of rows, keeps what the partitions send to the driver near 4 n rows in all.
    If so strict a bound leaves fewer than n rows, all rows are looked at.
    """
    total = rows.count()
    hashed = rows.select(F.xxhash64(*by).alias("_h"), *columns)
    for bound in (min(1.0, 4.0 * n / max(1, total)), 1.0):
        least = min((1 << 63) - 1, int((2 * bound - 1) * 2.0**63))
        got = hashed.where(F.col("_h") <= least).orderBy("_h", *columns).limit(n).collect()
        if len(got) >= n or bound == 1.0:
            return got
    return got
