"""Sampling with given probabilities by the pivotal method, in blocks that decide all rows but one."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.session import materialize

EPS = 1e-9


def uniform(seed: str, *columns: str | Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def pivotal(chances: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int, float]:
    """(chosen as 0 or 1, place of the row left undecided or -1, its chance), in the order given.

    Two rows meet at a time; one of them is decided and the other takes on the rest of both chances, so the number
    chosen is the sum of the chances up to the one row that is left, and neighbours rarely are chosen together.
    """
    chosen = np.zeros(len(chances), np.int8)
    held, a = -1, 0.0
    for i, (b, u) in enumerate(zip(chances.tolist(), draws.tolist())):
        if b <= EPS:
            continue
        if b >= 1 - EPS:
            chosen[i] = 1
            continue
        if held < 0:
            held, a = i, b
            continue
        s = a + b
        if s < 1:
            if u * s < b:
                held = i
            a = s
        else:
            if u * (2 - s) < 1 - b:
                chosen[held] = 1
                held = i
            else:
                chosen[i] = 1
            a = s - 1
        if a <= EPS:
            held, a = -1, 0.0
        elif a >= 1 - EPS:
            chosen[held] = 1
            held, a = -1, 0.0
    return chosen, held, a


def pivotal_sample(rows: DataFrame, key: Sequence[str], chance: str, order: Sequence[str], seed: str, block_rows: int = 50_000) -> DataFrame:
    """The keys that are chosen; ``key`` must be unique and not null, a null chance is none.

    Rows are dealt to blocks by a hash of the key, so no block outgrows a task; inside a block rows lie in the
    order given (ties by a hash), which spreads the sample over it. Each block leaves at most one row undecided;
    these meet again in the next round, each round having ``block_rows`` times fewer, until one block is left.
    """
    key, order = list(key), list(order)
    asked = rows.select(*key, *[c for c in order if c not in key], F.coalesce(F.col(chance), F.lit(0.0)).cast("double").alias("_p"), uniform(seed + ":draw", *key).alias("_u"), uniform(seed + ":order", *key).alias("_o"))
    asked = asked.where(F.col("_p") > EPS)
    schema = T.StructType([*asked.schema.fields, T.StructField("_state", T.IntegerType())])

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop(columns="_block").sort_values([*order, "_o"], kind="stable", na_position="first").reset_index(drop=True)
        chosen, held, a = pivotal(part["_p"].to_numpy(), part["_u"].to_numpy())
        state = chosen.astype(np.int32)
        if held >= 0:
            state[held] = 2
            part.loc[held, "_p"] = a
        return part.assign(_state=state)[state > 0]

    out = None
    for turn in range(20):
        blocks = max(1, -(-asked.count() // block_rows))
        dealt = asked.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), *key), F.lit(blocks)))
        decided = materialize(dealt.groupBy("_block").applyInPandas(decide, schema), "pivotal")
        last = blocks == 1
        taken = decided.where("_state = 1" if not last else "_state = 1 or (_state = 2 and _u < _p)").select(*key)
        out = taken if out is None else out.unionByName(taken)
        if last:
            return out
        asked = decided.where("_state = 2").drop("_state")
    raise RuntimeError("the undecided rows did not become fewer")
