"""Sums over a table of cells, made where the cells lie and added up on the driver.

The driver only sees vectors and matrices whose sides are numbers of categories, which callers bound.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Most categories whose moments are kept on the driver.
MAX_CATEGORIES = 2000
#: Most partitions that send a partial sum.
PARTIALS = 64


def add_up(cells: DataFrame, of: Callable[[pd.DataFrame], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...] | None:
    """The element-wise sum of ``of`` over all batches of cells; None for a table without rows."""

    def part(batches):
        total = None
        for batch in batches:
            if len(batch):
                sums = of(batch)
                total = sums if total is None else tuple(a + b for a, b in zip(total, sums))
        if total is not None:
            yield pd.DataFrame({"sums": [pickle.dumps(total)]})

    total = None
    for row in cells.coalesce(PARTIALS).mapInPandas(part, "sums binary").toLocalIterator():
        sums = pickle.loads(row[0])
        total = sums if total is None else tuple(a + b for a, b in zip(total, sums))
    return total
