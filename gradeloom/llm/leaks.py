"""Evaluation texts that leak into training texts: greedy string tiling over Karp-Rabin hashes of words.

Words of whole Arrow batches are hashed at once over one array of code points. The test texts are taken in blocks
of bounded size; a block is sent to the workers and every document is tiled against it where it lies, so no
document text is shuffled and any number of test items is handled. Shared runs of ``tile_words`` words are the
seeds; seeds on one diagonal join to maximal matches, which are checked word by word; the longest match that is still
free is marked again and again, and what is left of a partly covered match competes anew, so passages in another order
are all found. Where both sides repeat one run the seeds are taken as rectangles, a diagonal at a time.
"""

from __future__ import annotations

import functools
import heapq
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gradeloom.llm.textform import MARKUP, common_forms, slices

TILE_WORDS = 12
#: Words of test texts that are sent to the workers at once (about 50 bytes each, with their seeds).
BLOCK_WORDS = 500_000
#: Share of a test item that must be covered by tiles for a document to hold the whole of it.
WHOLE = 0.8
FILTER_BITS = 22

# Markup of any length; what isn't well formed may also be prose between comparison signs, and is taken off when short.
_TAG = re.compile(rf"{MARKUP}|</?[A-Za-z][^<>\n]{{0,200}}>")
_COMMAND = re.compile(r"\\(?!boxed)[A-Za-z]+")
_WORDS = re.compile(r"[^\W_]+")  # runs of what isalnum says
_LETTER, _MIX, _RUN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_POWERS = np.cumprod(np.full(1024, _LETTER, np.uint64))


@functools.lru_cache(maxsize=1)
def _letters_and_digits() -> np.ndarray:
    return np.fromiter((chr(cp).isalnum() for cp in range(0x110000)), bool, 0x110000)


def plain_words(texts: list[str]) -> list[str]:
    """Texts with one encoding and case, without markup; words are their runs of letters and digits."""
    out = []
    for form in common_forms(texts):
        if not form.isascii():
            form = unicodedata.normalize("NFKC", form)
        if "<" in form:
            form = _TAG.sub(" ", form)
        if "\\" in form:
            form = _COMMAND.sub(" ", form)
        out.append(form.casefold())
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(hash of each word, index of the text it stands in, plain form of each text), over all texts in order."""
    parts = [(a, *_hashes(texts[a:b])) for a, b in slices(map(len, texts))]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    return np.concatenate([h for _, h, _, _ in parts]), np.concatenate([owner + a for a, _, owner, _ in parts]), [t for *_, plain in parts for t in plain]


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    plain = plain_words(texts)
    points = np.frombuffer("\n".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _letters_and_digits()[points]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), plain
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    value = (points[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 1023]
    hashes = np.add.reduceat(value, first)
    hashes ^= hashes >> np.uint64(29)
    hashes *= _MIX
    hashes ^= hashes >> np.uint64(32)
    until = np.cumsum([len(t) + 1 for t in plain])
    return hashes, np.searchsorted(until, starts, side="right"), plain


def rolling(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(Karp-Rabin hash of the k words from each position on, whether they lie in one text)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total, power = np.zeros(n, np.uint64), np.uint64(1)
    for j in range(k):
        total += hashes[j : j + n] * power
        power = np.multiply(power, _RUN)
    total ^= total >> np.uint64(31)
    return total, owner[:n] == owner[k - 1 :]


def words_of(plain: str) -> list[str]:
    """The words of one text that ``plain_words`` made."""
    return _WORDS.findall(plain)


def tile(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (start in a, start in b, length) of maximal matches to tiles that don't overlap on either side.

    The longest goes first; ties go to the earlier place in a, then in b.
    """
    heap = [(-n, i, p) for i, p, n in matches]
    heapq.heapify(heap)
    free_a = np.ones(max((i + n for i, _, n in matches), default=0), bool)
    free_b = np.ones(max((p + n for _, p, n in matches), default=0), bool)
    tiles = []
    while heap:
        n, i, p = heapq.heappop(heap)
        n = -n
        free = free_a[i : i + n] & free_b[p : p + n]
        if free.all():
            tiles.append((i, p, n))
            free_a[i : i + n] = free_b[p : p + n] = False
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([False], free, [False])).astype(np.int8)))
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - begin >= least:
                heapq.heappush(heap, (begin - end, i + begin, p + begin))
    return tiles


def _maximal(rectangles: list[tuple[int, int, int, int]], k: int) -> list[tuple[int, int, int]]:
    """Seeds of k words to maximal matches along their diagonals.

    A rectangle (place in the document, places from there on, place in the test text, places from there on) stands
    for the seeds of one run at all of these.
    """
    lines: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, a, p, b in rectangles:
        for diagonal in range(i - (p + b - 1), i + a - p):
            lines[diagonal].append((max(i, p + diagonal), min(i + a, p + b + diagonal)))
    out = []
    for diagonal, parts in lines.items():
        begin, end = None, None
        for low, high in sorted(parts):
            if begin is None or low > end:
                if begin is not None:
                    out.append((begin, begin - diagonal, end - begin - 1 + k))
                begin, end = low, high
            end = max(end, high)
        out.append((begin, begin - diagonal, end - begin - 1 + k))
    return out


def equal_parts(match: tuple[int, int, int], a: list[str], b: list[str], least: int) -> list[tuple[int, int, int]]:
    """The parts of a match of hashes whose words are equal, of ``least`` words or more."""
    i, p, n = match
    if a[i : i + n] == b[p : p + n]:
        return [match]
    out, begin = [], 0
    for x in range(n + 1):
        if x == n or a[i + x] != b[p + x]:
            if x - begin >= least:
                out.append((i + begin, p + begin, x - begin))
            begin = x + 1
    return out


def _runs(places: np.ndarray, texts: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first place, how many places) of the runs of neighbouring places."""
    if not len(places):
        return []
    breaks = np.flatnonzero((np.diff(places) != 1) | (np.diff(texts) != 0)) + 1
    starts = np.concatenate(([0], breaks))
    return list(zip(texts[starts].tolist(), places[starts].tolist(), np.diff(np.concatenate((starts, [len(places)]))).tolist()))


def _block(items: list[tuple], k: int) -> dict:
    """The seeds of a block of test items (key, texts...)."""
    texts, home = [], []
    for n, (_, *parts) in enumerate(items):
        for m, part in enumerate(parts):
            if part:
                texts.append(part)
                home.append((n, m))
    hashes, owner, plain = word_hashes(texts)
    said = [" ".join(words_of(t)) for t in plain]
    seeds, valid = rolling(hashes, owner, k)
    at = np.flatnonzero(valid)
    order = at[np.argsort(seeds[at], kind="stable")]
    first = np.searchsorted(owner, np.arange(len(texts)))
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(seeds[order] >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    words = np.zeros(len(items), np.int64)
    np.add.at(words, np.array([n for n, _ in home], np.int64)[owner] if len(owner) else np.zeros(0, np.int64), 1)
    return {"seeds": seeds[order], "text": owner[order], "place": order - first[owner[order]], "home": home, "said": said, "maybe": maybe, "words": words, "keys": [x[0] for x in items]}


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    text: str = "text",
    item_key: str = "idx",
    item_texts: tuple[str, ...] = ("problem", "solution"),
    tile_words: int = TILE_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_key, item_key, tiles, longest, covered_words, item_words, coverage, whole): one row per leak.

    A document leaks an item when a tile of at least ``tile_words`` words of one of the item's texts stands in it.
    ``coverage`` is the share of the item's words that tiles cover, ``whole`` whether it reaches ``WHOLE``. Null and
    empty texts leak nothing, nor do test texts below ``tile_words`` words; an item whose key is repeated counts
    once per distinct texts. The corpus is read once per block of ``block_words`` words of test texts.
    """
    spark = docs.sparkSession
    n_chars = sum((F.coalesce(F.length(c), F.lit(0)) for c in item_texts), F.lit(0))
    total = items.agg(F.sum(n_chars)).first()[0] or 0
    blocks = max(1, -(-total // (4 * block_words)))  # a word and its blank take four characters or more on average
    chosen = items.where(F.col(item_key).isNotNull()).select(item_key, *item_texts).distinct()
    fields = [T.StructField(doc_key, docs.schema[doc_key].dataType), T.StructField(item_key, items.schema[item_key].dataType)]
    fields += [T.StructField(c, T.IntegerType()) for c in ("tiles", "longest", "covered_words", "item_words")]
    out = None
    for b in range(blocks):
        rows = chosen.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == b).collect()
        block = spark.sparkContext.broadcast(_block(sorted(tuple(r) for r in rows) if rows else [], tile_words))
        found = docs.select(doc_key, text).where(F.col(doc_key).isNotNull() & (F.length(text) > 0)).mapInArrow(_tiler(block, tile_words, to_arrow_type(fields[1].dataType)), T.StructType(fields))
        out = found if out is None else out.unionByName(found)
    share = F.col("covered_words") / F.col("item_words")
    return out.withColumn("coverage", share).withColumn("whole", share >= WHOLE)


def _tiler(block, k: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        seeds, maybe, keys, home = b["seeds"], b["maybe"], b["keys"], b["home"]
        for batch in batches:
            names = batch.schema.names
            result: list[tuple] = []
            if len(seeds):
                texts = batch.column(1).to_pylist()
                hashes, owner, plain = word_hashes(texts)
                runs, valid = rolling(hashes, owner, k)
                at = np.flatnonzero(valid & maybe[(runs >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                low, high = np.searchsorted(seeds, runs[at], "left"), np.searchsorted(seeds, runs[at], "right")
                hit = high > low
                by: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))  # document, test text: rectangles
                last = dict(zip(low[hit].tolist(), high[hit].tolist()))
                for lo, i, a in _runs(at[hit], low[hit]):
                    hi = last[lo]
                    where = [(int(b["text"][lo]), int(b["place"][lo]), 1)] if hi == lo + 1 else _runs(b["place"][lo:hi], b["text"][lo:hi])
                    for text, p, b_places in where:
                        by[int(owner[i])][text].append((i, a, p, b_places))
                first = np.searchsorted(owner, np.arange(len(texts)))
                for doc in sorted(by):
                    said = words_of(plain[doc])
                    tiles: dict[int, list] = defaultdict(list)
                    for text, rectangles in by[doc].items():
                        own = [(i - int(first[doc]), a, p, n) for i, a, p, n in rectangles]
                        matches = [m for x in _maximal(own, k) for m in equal_parts(x, said, b["said"][text].split(" "), k)]
                        tiles[home[text][0]] += tile(matches, k)
                    for n in sorted(tiles):
                        lengths = [t[2] for t in tiles[n]]
                        if lengths:
                            result.append((doc, n, len(lengths), max(lengths), sum(lengths), int(b["words"][n])))
            which = pa.array([r[0] for r in result], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(which), pa.array([keys[r[1]] for r in result], item_type)]
                + [pa.array([r[c] for r in result], pa.int32()) for c in range(2, 6)],
                names=[names[0], "item", "tiles", "longest", "covered_words", "item_words"],
            )

    return run
