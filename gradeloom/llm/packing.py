"""Texts put together into sequences of a fixed capacity in tokens, with little unused room.

Only sizes are shuffled. They are dealt to blocks by a hash; inside a block a best-fit start is improved by local
search over the underfull bins: the emptiest bin gives documents away by moves, by exchanges of one for one, of two
for one and of one for two, each of which raises the sum of squared fills, until it is empty or nothing helps. The
bins that stay underfull go on to the next round, where those of many blocks meet, until one block holds them all.
Where texts do not fit together, as many of one size above half the capacity, a round changes little: then bins over
half full stay as they are and only the others, of which a block has one at most, go on.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_ITEMS = 4096
#: A bin at least this full is left as it is.
FULL = 0.995
#: A round that lowers neither the underfull bins nor their texts by this share is the last for bins over half full.
GAIN = 0.01
#: Most tasks that blocks are dealt to.
MAX_TASKS = 20_000
#: A block has texts for at least so many sequences, however short they are.
BLOCK_SEQUENCES = 8

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a file of byte-level ranks, read once in each worker."""
    if path not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_sizes(docs: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """(key, n_tokens) of whole texts; null and empty texts have no row, a key delivered again counts its longest."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in batches:
            sizes = [len(tokens.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    rows = docs.select(key, text).where(F.col(key).isNotNull() & (F.length(text) > 0))
    return rows.mapInArrow(count, schema).groupBy(key).agg(F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: the largest first, each into the fullest bin with room for it."""
    gaps: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(gaps, (sizes[i], -1))
        if at == len(gaps):
            bins.append([i])
            insort(gaps, (capacity - sizes[i], len(bins) - 1))
        else:
            gap, b = gaps.pop(at)
            bins[b].append(i)
            insort(gaps, (gap - sizes[i], b))
    return bins


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Empty the emptiest bins by moves and exchanges that raise the sum of squared fills, until none helps any bin."""
    least = -(-sum(sizes) // capacity)
    bins = [list(b) for b in bins]
    stuck: set[int] = set()
    shapes: set[tuple[int, ...]] = set()  # sizes in bins that no step helps as all bins are now; equal bins share it
    stepped = False  # since no bin was stuck
    fill = [sum(sizes[i] for i in b) for b in bins]
    while sum(1 for b in bins if b) > least:
        open_bins = [k for k in range(len(bins)) if bins[k] and fill[k] < capacity]
        givers = [k for k in open_bins if k not in stuck]
        if len(open_bins) < 2 or not (givers or stepped):
            break
        if not givers:  # the others have changed: once more through all of them
            stuck.clear()
            stepped = False
            continue
        e = min(givers, key=lambda k: (fill[k], k))
        shape = tuple(sorted(sizes[i] for i in bins[e]))
        if shape not in shapes and _improve(e, open_bins, bins, fill, sizes, capacity):
            stepped = True
            shapes.clear()
            stuck.discard(min((k for k in range(len(bins)) if bins[k]), key=lambda k: (fill[k], k)))  # the one to be emptied
        else:
            stuck.add(e)
            shapes.add(shape)
    return [b for b in bins if b]


def _improve(e: int, open_bins: list[int], bins, fill, sizes, capacity) -> bool:
    """One step that makes bin e emptier and another bin, at least as full before, fuller."""
    others = [k for k in open_bins if k != e and fill[k] >= fill[e]]
    if not others:
        return False

    def shift(k: int, give: tuple[int, ...], take: tuple[int, ...]) -> bool:
        for i in give:
            bins[e].remove(i)
            bins[k].append(i)
        for i in take:
            bins[k].remove(i)
            bins[e].append(i)
        more = sum(sizes[i] for i in give) - sum(sizes[i] for i in take)
        fill[e] -= more
        fill[k] += more
        return True

    mine = np.array(sorted(bins[e], key=lambda i: (-sizes[i], i)), np.int64)
    own = np.array([sizes[i] for i in mine.tolist()], np.int64)
    gap = {k: capacity - fill[k] for k in others}
    by_gap = sorted(others, key=lambda k: (gap[k], k))
    gaps = np.array([gap[k] for k in by_gap], np.int64)
    fits = np.flatnonzero(own <= gaps[-1])
    if len(fits):  # a move of the largest that fits anywhere into the fullest bin with room
        i = int(fits[0])
        return shift(by_gap[int(np.searchsorted(gaps, own[i]))], (int(mine[i]),), ())
    item = np.array([i for k in others for i in bins[k]], np.int64)
    home = np.repeat(np.array(others, np.int64), [len(bins[k]) for k in others])
    size = np.array([sizes[i] for i in item.tolist()], np.int64)
    room = np.array([gap[k] for k in home.tolist()], np.int64)
    # what may come for some item: more than its size, at most so much more as its bin has room
    bounds = np.zeros(capacity + 2, np.int64)
    np.add.at(bounds, size + 1, 1)
    np.add.at(bounds, size + room + 1, -1)
    comes = np.cumsum(bounds) > 0

    def swap(give: tuple[int, ...], total: int) -> bool:
        gain = np.where((total > size) & (total - size <= room), total - size, 0)
        at = int(gain.argmax())
        return shift(int(home[at]), give, (int(item[at]),))

    one = np.flatnonzero(comes[own])
    if len(one):  # one for one
        return swap((int(mine[one[0]]),), int(own[one[0]]))
    x, y = np.triu_indices(len(mine), 1)
    both = own[x] + own[y]
    two = np.flatnonzero(comes[np.minimum(both, capacity + 1)])
    if len(two):  # two for one
        return swap((int(mine[x[two[0]]]), int(mine[y[two[0]]])), int(both[two[0]]))
    largest, smallest = int(own[0]), int(own[-1])
    for k in others:  # one for two
        if len(bins[k]) < 2:
            continue
        there = sorted(bins[k], key=lambda i: (sizes[i], i))
        if sizes[there[0]] + sizes[there[1]] >= largest or sizes[there[-1]] + sizes[there[-2]] + gap[k] < smallest:
            continue
        pairs = _pair_sums([sizes[i] for i in there])
        for i, n in zip(mine.tolist(), own.tolist()):
            at = bisect_left(pairs, (n - gap[k],))
            if at < len(pairs) and pairs[at][0] < n:
                return shift(k, (i,), (there[pairs[at][1]], there[pairs[at][2]]))
    return False


def _pair_sums(sizes: list[int]) -> list[tuple[int, int, int]]:
    """(sum, place, place) of all pairs, sorted."""
    if len(sizes) <= 16:
        return sorted((x + y, i, j) for i, x in enumerate(sizes) for j, y in enumerate(sizes[i + 1 :], i + 1))
    x, y = np.triu_indices(len(sizes), 1)
    both = np.array(sizes)[x] + np.array(sizes)[y]
    order = np.argsort(both, kind="stable")
    return list(zip(both[order].tolist(), x[order].tolist(), y[order].tolist()))


def pack(sizes: DataFrame, key: str, capacity: int, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(sequence_id, place, key, piece, token_start, n_tokens) from (key, n_tokens): every token in one sequence.

    A text longer than the capacity is divided into full pieces, which are sequences of their own, and a rest that
    is packed like any other text; no other text is divided. Equal sizes go by key. Sizes of null or 0 take no room
    and have no row. The same table always gives the same sequences.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    rows = sizes.where("n_tokens > 0").select(key, "n_tokens")
    cut = rows.select(key, F.col("n_tokens").alias("_n"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / capacity).cast("int") - 1)).alias("piece"))
    cut = cut.select(key, "piece", (F.col("piece").cast("long") * capacity).alias("token_start"), F.least(F.lit(capacity).cast("long"), F.col("_n") - F.col("piece").cast("long") * capacity).alias("n_tokens"))
    whole = cut.where(F.col("n_tokens") == capacity).select(F.concat_ws("-", F.lit("whole"), F.col(key).cast("string"), "piece").alias("sequence_id"), F.lit(0).alias("place"), key, "piece", "token_start", "n_tokens")
    left = cut.where(F.col("n_tokens") < capacity)
    schema = T.StructType(
        [T.StructField("sequence_id", T.StringType()), T.StructField("place", T.IntegerType()), sizes.schema[key]]
        + [T.StructField("piece", T.IntegerType()), T.StructField("token_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("_fill", T.LongType())]
    )
    out, turn, bins = whole, 0, None
    while True:
        items, tokens = left.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        blocks = max(1, min(-(-items // block_items), tokens // (BLOCK_SEQUENCES * capacity)))
        dealt = left.withColumn("_block", F.pmod(F.xxhash64(F.lit(turn), key, "piece"), F.lit(blocks)))
        tasks = min(blocks, MAX_TASKS)  # a stated number, which adaptive execution leaves alone
        packed = materialize(dealt.repartition(tasks, "_block").groupBy("_block").applyInPandas(_filler(key, capacity, turn, schema.names), schema), "packed")
        if blocks == 1:
            return out.unionByName(packed.drop("_fill"))
        stays = F.col("_fill") < FULL * capacity
        open_items, open_bins = packed.where(stays).agg(F.count("*"), F.countDistinct("sequence_id")).first()
        if open_items > (1 - GAIN) * items and open_bins > (1 - GAIN) * (bins or items):  # only what surely gets fewer is dealt again
            stays = 2 * F.col("_fill") <= capacity
        out = out.unionByName(packed.where(~stays).drop("_fill"))
        left = packed.where(stays).select(key, "piece", "token_start", "n_tokens")
        turn, bins = turn + 1, open_bins


def _filler(key: str, capacity: int, turn: int, names: list[str]):
    """The bins of one block."""

    def fill_bins(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["n_tokens", key, "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        size = part["n_tokens"].tolist()
        bins = local_search(best_fit(size, capacity), size, capacity)
        done = part.iloc[[i for b in bins for i in b]].copy()
        done["sequence_id"] = [f"{turn}-{part['_block'].iloc[0]}-{n}" for n, b in enumerate(bins) for _ in b]
        done["place"] = np.array([p for b in bins for p in range(len(b))], np.int32)
        done["_fill"] = [fill for b in bins for fill in [sum(size[i] for i in b)] for _ in b]
        return done[names]

    return fill_bins


def pack_texts(docs: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``pack`` of the token sizes of whole texts; a key delivered again is packed once."""
    return pack(materialize(token_sizes(docs, key, text, tokenizer), "sizes"), key, capacity)


def fills(packed: DataFrame, capacity: int) -> DataFrame:
    """(sequence_id, documents, tokens, fill) of each sequence."""
    return packed.groupBy("sequence_id").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens")).withColumn("fill", F.col("tokens") / capacity)
