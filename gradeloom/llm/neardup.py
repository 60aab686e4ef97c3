"""Groups of questions that are small edits of one another.

Every text is the set of its 5-character pieces. Its fingerprint has one bit per hash bucket of a piece, so the
Hamming distance of two fingerprints is at most the number of pieces that only one text has. For texts of m and n
pieces that share at least 3/4 of all their pieces that number is at most (m + n) / 7. The distances of a
fingerprint to many reference fingerprints (pivots) are computed once; by the triangle inequality a pair whose
distances to some pivot differ by more than the bound cannot be alike and is discarded, then the Hamming
distance itself is held against the bound, and the survivors are verified on their whole texts.

At a distance this large no table of pivots can enumerate the pairs to look at without all of them, so candidates
come from equal bands of min-hashes (see the README for the chance to miss a pair). Buckets in which one text lies
are dropped by a partial aggregate of 64-bit keys, so only texts that share a bucket go on, under dense numbers. A
bucket is compared with its first member only; what is not joined by that is compared across the components inside
the bucket, so a bucket of one large group costs a linear number of comparisons and no pair of different components
is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.questions import normal_question
from gradeloom.llm.few import few_rows
from gradeloom.llm.textform import slices
from gradeloom.operators.graph import connected_components
from gradeloom.operators.ordering import global_rank
from gradeloom.operators.pairs import BROADCAST_KEYS, join_hot, pairs_within
from gradeloom.session import discard, materialize

PIECE = 5
#: 32 bands of 6 min-hashes, as two one-permutation sketches of 96 bins.
BINS, SKETCHES, ROWS = 96, 2, 6
BANDS = BINS * SKETCHES // ROWS
BITS, PIVOTS = 1024, 16
#: Most signatures, and characters of texts, that are sent to all workers at once.
BROADCAST_SIGNATURES, BROADCAST_CHARS = 100_000, 16_000_000

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def text_id(text: str) -> bytes:
    """A 128-bit id of a normalised text."""
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each 5-character piece, index of its text); a shorter text is one piece, an empty one none."""
    padded = [t if len(t) >= PIECE or not t else t + "\0" * (PIECE - len(t)) for t in texts]
    sizes = np.array([len(t) for t in padded], np.int64)
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(points) - PIECE + 1
    value = np.zeros(n, np.uint64)
    for j in range(PIECE):
        value = value * _M1 + points[j : j + n] + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    whole = owner[:n] == owner[PIECE - 1 :]
    return _mix(value[whole]), owner[:n][whole]


def fingerprints(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, BITS / 64) words with one bit per bucket of a piece."""
    bits = np.zeros((n, BITS), bool)
    bits[owner, (hashes >> np.uint64(53)).astype(np.int64) % BITS] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def bands(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, BANDS) 64-bit hashes of bands and their min-hashes; rows of texts without pieces are meaningless."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketches = []
    for s in range(SKETCHES):
        h = _mix(hashes + np.uint64((s + 1) * int(_M1) % (1 << 64)))
        least = np.full(n * BINS, top)
        np.minimum.at(least, owner * BINS + (h % np.uint64(BINS)).astype(np.int64), h)
        least = least.reshape(n, BINS)
        gap = least == top
        for _ in range(BINS):  # an empty bin takes the value of the next filled one, marked by the distance
            if not gap.any():
                break
            after = np.roll(least, -1, axis=1)
            filled = np.roll(~gap, -1, axis=1) & gap
            least = np.where(filled, after * _M2 + np.uint64(1), least)
            gap = gap & ~filled
            if gap.all(axis=1).any() and gap[~gap.all(axis=1)].sum() == 0:
                break
        sketches.append(least)
    rows = np.concatenate(sketches, axis=1).reshape(n, BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (n, 1))
    for j in range(ROWS):
        key = _mix(key * _M1 + rows[:, :, j])
    return key.view(np.int64)


def pivot_distances(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(n, pivots) Hamming distances."""
    out = np.empty((len(prints), len(pivots)), np.int16)
    for j, p in enumerate(pivots):
        out[:, j] = np.bitwise_count(prints ^ p).sum(axis=1)
    return out


def distinct_pieces(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct pieces of each text."""
    keyed = np.sort((owner.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))  # a batch has fewer than 2^20 texts
    new = np.ones(len(keyed), bool)
    new[1:] = keyed[1:] != keyed[:-1]
    return np.bincount((keyed[new] >> np.uint64(44)).astype(np.int64), minlength=n)


def alike(a: str, b: str) -> bool:
    """Whether at least 3/4 of all distinct pieces of two different texts occur in both."""
    x = {a[i : i + PIECE] for i in range(max(1, len(a) - PIECE + 1))} if a else set()
    y = {b[i : i + PIECE] for i in range(max(1, len(b) - PIECE + 1))} if b else set()
    both = len(x & y)
    return 4 * both >= 3 * (len(x) + len(y) - both)


PRINTS = [f"f{i}" for i in range(BITS // 64)]
#: Four 16-bit distances in each.
DISTANCES = [f"d{i}" for i in range(PIVOTS // 4)]


def pivot_prints(texts: list[str]) -> np.ndarray:
    """(PIVOTS, BITS / 64): the empty fingerprint, whose distance is the number of bits set, and those of the texts."""
    hashes, owner = pieces(texts)
    out = np.zeros((PIVOTS, BITS // 64), np.uint64)
    out[1 : 1 + len(texts)] = fingerprints(hashes, owner, len(texts))
    return out


def _signatures(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(key, text_id, n, fingerprint and pivot distances as longs, bands).

    A text that is empty or was seen before in its batch has no signature (n is 0 and the rest null).
    """
    fields = [T.StructField("key", rows.schema["key"].dataType), T.StructField("text_id", T.BinaryType()), T.StructField("n", T.IntegerType())]
    fields += [T.StructField(c, T.LongType()) for c in PRINTS + DISTANCES] + [T.StructField("bands", T.ArrayType(T.LongType()))]
    schema = T.StructType(fields)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal_question(t) for t in batch.column(1).to_pylist()]
            ids = [text_id(t) for t in texts]
            first: dict[bytes, int] = {}
            for i, t in enumerate(texts):
                if t:
                    first.setdefault(ids[i], i)
            at = np.array(sorted(first.values()), np.int64)
            n = np.zeros(len(texts), np.int32)
            longs = np.zeros((len(texts), len(PRINTS) + len(DISTANCES)), np.int64)
            lists = np.zeros((len(texts), BANDS), np.int64)
            for lo, hi in slices((len(texts[i]) + 500 for i in at.tolist()), 2_000_000):  # 500 for the bits of a text
                part = at[lo:hi]
                hashes, owner = pieces([texts[i] for i in part])
                prints = fingerprints(hashes, owner, len(part))
                near = np.ascontiguousarray(pivot_distances(prints, pivots))
                longs[part] = np.concatenate([prints.view(np.int64), near.view(np.int64)], axis=1)
                lists[part] = bands(hashes, owner, len(part))
                n[part] = distinct_pieces(hashes, owner, len(part))
            none = np.ones(len(texts), bool)
            none[at] = False
            ends = np.concatenate(([0], np.cumsum(np.where(none, 0, BANDS)))).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(lists[~none].ravel()), mask=pa.array(none))
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(n)]
            columns += [pa.array(np.ascontiguousarray(longs[:, j]), mask=none) for j in range(longs.shape[1])] + [listed]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return rows.mapInArrow(sign, schema)


def _normal_forms(rows: DataFrame) -> DataFrame:
    """(text_id, normal) of (key, text)."""

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal_question(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([text_id(t) for t in texts], pa.binary()), pa.array(texts, pa.string())], names=["text_id", "normal"])

    return rows.mapInArrow(form, "text_id binary, normal string")


def _apart_by_pivots() -> Column:
    """The largest difference of two texts' distances to one pivot."""
    one = lambda side, c, j: F.shiftright(F.col(side + c), 16 * j).bitwiseAND(F.lit(0xFFFF))
    return F.greatest(*[F.abs(one("x", c, j) - one("y", c, j)) for c in DISTANCES for j in range(4)])


def _apart() -> Column:
    """The Hamming distance of two texts' fingerprints."""
    return sum((F.bit_count(F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))) for c in PRINTS), F.lit(0))


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole normalised texts (ta, tb) are alike."""

    @F.pandas_udf("boolean")
    def same(ta: pd.Series, tb: pd.Series) -> pd.Series:
        return pd.Series([alike(x, y) for x, y in zip(ta, tb)], dtype=bool)

    return pairs.where(same("ta", "tb")).select("a", "b")


def _pick(table: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``table`` whose key is among ``keys``; the keys are sent to all workers only up to a checked number.

    For keys that few rows share: every key of a record, and buckets, which a text enters once per batch.
    """
    few = keys.count() <= BROADCAST_KEYS
    return table.join(F.broadcast(keys) if few else keys, on, "left_semi")


def _ends(pairs: DataFrame, table: DataFrame, columns: dict[str, str], most: int) -> DataFrame:
    """``pairs`` (a, b) with columns of ``table`` (node, ...) for both ends, named ``x``..., ``y``...."""
    for end, side in (("a", "x"), ("b", "y")):
        pairs = join_hot(pairs, table.select(F.col("node").alias(end), *[F.col(c).alias(side + to) for c, to in columns.items()]), [end], most=most)
    return pairs


def filtered(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (a, b, by_pivots, by_distance) with their largest coordinate difference and their Hamming distance.

    Both are held against (m + n) / 7; what the pivots discard has no Hamming distance.
    """
    named = {c: c for c in ["n", *PRINTS, *DISTANCES]}
    joined = _ends(pairs, signed, named, BROADCAST_SIGNATURES).withColumn("bound", F.col("xn") + F.col("yn"))
    joined = joined.withColumn("by_pivots", 7 * _apart_by_pivots() <= F.col("bound"))
    return joined.withColumn("by_distance", F.when(F.col("by_pivots"), 7 * _apart() <= F.col("bound"))).select("a", "b", "by_pivots", "by_distance")


def _links(pairs: DataFrame, signed: DataFrame, source: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) of nodes that hold, written."""
    left = materialize(filtered(pairs, signed).where("by_pivots and by_distance").select("a", "b"), "survivors")
    if left.isEmpty():
        return left
    ends = left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct()
    keys = materialize(_pick(signed, materialize(ends, "ends"), "node").select("key", "node", "text_id"), "keys")
    forms = _normal_forms(_pick(source, materialize(keys.select("key").distinct(), "keys"), "key")).groupBy("text_id").agg(F.min("normal").alias("normal"))
    texts = materialize(forms.join(keys, "text_id").select("node", "normal"), "texts")
    most = texts.count() if (texts.agg(F.sum(F.length("normal"))).first()[0] or 0) <= BROADCAST_CHARS else 0
    links = materialize(_verified(_ends(left, texts, {"normal": "t"}, most).withColumnsRenamed({"xt": "ta", "yt": "tb"})), "links")
    discard(left, keys, texts)
    return links


def _grouped(rows: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, text_id of every row; text_id, group, links of the texts that are linked), both written."""
    source = rows.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("key is not null")
    chosen = few_rows(source.where(F.length("text") >= PIECE), PIVOTS - 1, ["key"], ["text"])
    every = materialize(_signatures(source, pivot_prints([normal_question(r["text"]) for r in chosen])), "signatures")

    # a bucket is of one text if all 32-bit hashes in it are equal
    listed = every.where("bands is not null").select("text_id", F.explode("bands").alias("bucket"))
    mark = F.hash("text_id")
    shared = listed.groupBy("bucket").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi")).where("lo < hi").select("bucket")
    shared = materialize(shared, "shared")
    found = materialize(_pick(listed, shared, "bucket"), "found")
    nodes = materialize(global_rank(found.select("text_id").distinct(), ["text_id"], "node"), "nodes")
    first = lambda c: F.first(c).alias(c)
    signed = join_hot(every.where("n > 0").drop("bands"), nodes, ["text_id"]).groupBy("node").agg(F.min("key").alias("key"), *map(first, ["text_id", "n", *PRINTS, *DISTANCES]))
    signed = materialize(signed, "signed")
    sized = materialize(signed.select("text_id", "node", "n"), "sized")
    buckets = materialize(join_hot(found, sized, ["text_id"]).select("bucket", "node", "n").distinct(), "buckets")
    discard(shared, found)

    leads = materialize(buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.min_by("n", "node").alias("lead_n")), "leads")
    star = join_hot(buckets, leads, ["bucket"]).where("node <> lead and 7 * abs(n - lead_n) <= n + lead_n").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    star = materialize(star, "star")
    links = _links(star, signed, source)
    component = materialize(connected_components(links), "component")

    parts = materialize(join_hot(buckets, component, ["node"], "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("part")), "parts")
    across = pairs_within(parts, "bucket", "node", "part", carry=["n"], keep="7 * abs(n_a - n_b) <= n_a + n_b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    more = materialize(across.join(star, ["a", "b"], "left_anti"), "across")
    added = _links(more, signed, source)
    all_links = links.unionByName(added)
    if not added.isEmpty():
        component = connected_components(all_links)

    ends = all_links.select(F.col("a").alias("node")).unionByName(all_links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    named = nodes.select(F.col("node").alias("component"), F.col("text_id").alias("group"))
    linked = component.join(ends, "node").join(nodes, "node").join(named, "component").select("text_id", "group", "links")
    linked = materialize(linked, "linked")
    discard(buckets, leads, star, links, parts, more, signed, added)
    return every.select("key", "text_id"), linked


def near_duplicates(rows: DataFrame, key: str = "train_idx", text: str = "question") -> DataFrame:
    """(key, text_id, group, links): one row per key and normalised text.

    ``text_id`` is a digest of the normalised text, ``group`` that of one text of the connected group, which texts with
    equal normal forms share; ``links`` counts the verified links of the text that joined it (at least those of a
    spanning tree of its group). A text without partner is a group of its own. Null and empty texts are one group
    with no links. Rows delivered again count once; a key with several texts has a row for each; rows with a null key
    are left out.
    """
    every, linked = _grouped(rows, key, text)
    out = join_hot(every.distinct(), linked, ["text_id"], "left")
    return out.select(F.col("key").alias(key), F.hex("text_id").alias("text_id"), F.hex(F.coalesce("group", "text_id")).alias("group"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def near_duplicate_pairs(rows: DataFrame, key: str = "train_idx", text: str = "question") -> DataFrame:
    """(key_a, key_b), smaller first: keys of one group whose normalised texts differ."""
    every, linked = _grouped(rows, key, text)
    groups = materialize(join_hot(every, linked, ["text_id"]).select("key", "group", "text_id").distinct(), "groups")
    return pairs_within(groups, "group", "key", "text_id").select(F.col("id_a").alias(f"{key}_a"), F.col("id_b").alias(f"{key}_b")).distinct()
