"""Canonical JSON (sorted keys, no blanks, non-ASCII kept) and digests of it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(value: Any) -> str:
    """sha256 of a text, or of the canonical JSON of anything else."""
    return hashlib.sha256((value if isinstance(value, str) else canonical_json(value)).encode()).hexdigest()


def canonical_struct(*columns: str) -> Column:
    """Canonical JSON of an object of columns without floating point numbers, in the JVM; nulls are kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def canonical_tuple(*columns: Column) -> Column:
    """Canonical JSON of an array of strings and integers, null as ``null``, in the JVM."""
    parts = []
    for c in columns:
        as_list = F.to_json(F.array(c))  # a one-element list, printed as its element needs it
        parts.append(F.coalesce(F.substring(as_list, F.lit(2), F.length(as_list) - 2), F.lit("null")))
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def canonical_object(columns: Sequence[str]) -> Column:
    """Canonical JSON of an object with floating point numbers, printed the shortest way that reads back equal."""
    names = list(columns)

    @F.arrow_udf("string")
    def encode(*values: pa.Array) -> pa.Array:
        return pa.array([canonical_json(dict(zip(names, row))) for row in zip(*[v.to_pylist() for v in values])], pa.string())

    return encode(*[F.col(n) for n in names])


def payload(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that identify a source row, in order; one the table lacks is null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def row_digest(columns: Sequence[str]) -> Column:
    """sha256 of ``canonical_object``: the identity of a source row."""
    return F.sha2(canonical_object(columns), 256)
