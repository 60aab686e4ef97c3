"""One stored form for texts that look alike, over the code points of whole Arrow batches.

A batch of texts is exploded into one array of positioned code points. The mappings (decomposition, look-alike
letters, kinds of blank, invisible characters) are fixed tables derived from the Unicode data of the interpreter;
their size does not depend on the corpus, so every worker holds them, and the lookup is the broadcast join of the
method without a shuffle of single characters. Combining marks are then ordered by class within their run, the
text is recomposed and the strings are rebuilt. ASCII texts without control characters are already in this form.
The form is a key for comparisons, not text to train on: Cyrillic or Greek words come out with Latin letters in them.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.operators.pairs import join_hot, pairs_within
from gradeloom.session import materialize

# Letters of other scripts whose glyphs equal a Latin letter's.
LOOK_ALIKES = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴⲂꓐ", "C": "ϹСᏟⲤꓚ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "Ϝꓝ", "G": "ᏀԌꓖ", "H": "ΗНᎻⲎꓧ", "I": "ΙІӀⲒꓲ",
    "J": "ЈᎫͿꓙ", "K": "ΚКᏦⲔꓗ", "L": "ᏞⳐꓡ", "M": "ΜМᎷϺⲘꓟ", "N": "ΝⲚꓠ", "O": "ΟОՕⲞꓳ", "P": "ΡРᏢⲢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ",
    "S": "ЅᏚՏᏕꓢ", "T": "ΤТᎢⲦꓔ", "U": "Սꓴ", "V": "ᏙѴꓦ", "W": "ԜᎳꓪ", "X": "ΧХⲬꓫ", "Y": "ΥУҮᎩᎽⲨꓬ", "Z": "ΖᏃꓜ", "a": "аɑ",
    "b": "Ꮟ", "c": "сϲᴄⲥꮯ", "d": "ԁᏧ", "e": "е", "g": "ɡց", "h": "һհᏂ", "i": "і", "j": "јϳ", "l": "ӏ",
    "n": "ո", "o": "οоօᴏⲟ", "p": "рⲣ", "q": "ԛ", "s": "ѕꜱꮪ", "u": "ս", "v": "νѵᴠꮩ", "w": "ԝᴡꮃ", "x": "х",
    "y": "у", "z": "ᴢꮓ", "-": "‐‑", ":": "∶", "/": "⁄∕", "|": "∣ǀ",
}
# Ranges of characters that show nothing (default ignorable code points and controls).
INVISIBLE = (
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A),
    (0xE0000, 0xE0FFF),
)
# Kinds of decomposition that change the look, so they are left alone.
DIFFERENT_LOOK = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<font>", "<vertical>")
LINE_BREAKS = (0x0D, 0x85, 0x2028, 0x2029)

#: Characters that are exploded at once.
SLICE_CHARS = 1_000_000

# Markup of any length and over line breaks: a name with attributes, at least one of which has a value, or with none.
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'<>=][^\s"'<>]*)"""
MARKUP = rf"""</?[A-Za-z][\w:-]*+(?:(?=[^<>=]*=)(?:\s++[A-Za-z_:@][\w:.-]*+(?:\s*+=\s*+{_VALUE})?)+)?\s*+/?>"""

_PLAIN_CONTROL = re.compile(r"[\x00-\x09\x0b-\x1f\x7f]")


def _decomposed(ch: str) -> str:
    """Full decomposition of one character that keeps its look."""
    spec = unicodedata.decomposition(ch)
    if not spec or spec.startswith(DIFFERENT_LOOK):
        return unicodedata.normalize("NFD", ch) if "가" <= ch <= "힣" else ch
    parts = [p for p in spec.split() if not p.startswith("<")]
    return "".join(_decomposed(chr(int(p, 16))) for p in parts)


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    """(special, start, length, target, class, joins): the mapping of each code point, built once in each worker.

    ``joins`` tells what may be composed with a character before it: marks, vowels and finals of Hangul and some more.
    """
    top = 0x110000
    alike = {ord(c): ord(to) for to, froms in LOOK_ALIKES.items() for c in froms}
    special = np.zeros(top, bool)
    start, length = np.zeros(top, np.int32), np.ones(top, np.int32)
    marks = np.zeros(top, np.uint8)
    joins = np.zeros(top, bool)
    joins[0x1161:0x1176] = joins[0x11A8:0x11C3] = True
    target: list[int] = []

    def put(cp: int, to: list[int]) -> None:
        special[cp] = True
        start[cp], length[cp] = len(target), len(to)
        target.extend(to)

    for cp in range(0x80, top):
        if 0xD800 <= cp <= 0xDFFF or 0x3400 <= cp <= 0x9FFF or 0xE000 <= cp <= 0xF8FF or 0x30000 <= cp:
            continue
        ch = chr(cp)
        marks[cp] = unicodedata.combining(ch)
        spec = unicodedata.decomposition(ch)
        if " " in spec and not spec.startswith("<"):
            joins[int(spec.split()[1], 16)] = True
        if unicodedata.category(ch) == "Zs":
            put(cp, [0x20])
            continue
        to = [alike.get(ord(c), ord(c)) for c in _decomposed(ch)]
        if to != [cp]:
            put(cp, to)
    put(0x09, [0x20])
    for cp in LINE_BREAKS:
        put(cp, [0x0A])
    for low, high in INVISIBLE:
        for cp in range(low, high + 1):
            put(cp, [])
    return special, start, length, np.array(target or [0], np.uint32), marks, joins


def is_plain(text: str) -> bool:
    """Whether the text is already in the common form because of its characters alone."""
    return text.isascii() and not _PLAIN_CONTROL.search(text)


def slices(sizes: Iterable[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts with at most ``most`` characters together; a longer text is a run of its own."""
    begin = total = end = 0
    for end, n in enumerate(sizes, 1):
        total += n
        if total > most and end - begin > 1:
            yield begin, end - 1
            begin, total = end - 1, n
    if end > begin:
        yield begin, end


def common_forms(texts: list[str]) -> list[str]:
    """The common form of each text (no nulls); whole texts, a bounded number of characters at a time."""
    out = list(texts)
    odd = [i for i, t in enumerate(texts) if not is_plain(t)]
    for a, b in slices(len(texts[i]) for i in odd):
        for i, form in zip(odd[a:b], _forms([texts[i] for i in odd[a:b]])):
            out[i] = form
    return out


def _forms(texts: list[str]) -> list[str]:
    odd = range(len(texts))
    out = list(texts)
    special, start, length, target, marks, joins = _tables()
    raw = [np.frombuffer(texts[i].replace("\r\n", "\n").encode("utf-32-le", "surrogatepass"), np.uint32) for i in odd]
    sizes = np.array([len(r) for r in raw], np.int64)
    points = np.concatenate(raw)
    owner = np.repeat(np.arange(len(odd), dtype=np.int32), sizes)

    hit = special[points]
    if hit.any():
        count = np.where(hit, length[points], 1)
        source = np.repeat(np.arange(len(points)), count)
        ends = np.cumsum(count)
        within = np.arange(len(source)) - (ends - count)[source]
        old = points[source]
        mapped = hit[source]
        points = old.copy()
        points[mapped] = target[start[old[mapped]] + within[mapped]]
        owner = owner[source]

    klass = marks[points]
    at = np.flatnonzero(klass)
    if len(at):
        run = np.cumsum(klass == 0)[at] + owner[at]  # a mark belongs to the last starter of its own text
        order = np.lexsort((at, klass[at], run))
        points[at] = points[at[order]]

    composed = np.zeros(len(odd), bool)
    composed[owner[joins[points]]] = True
    bounds = np.searchsorted(owner, np.arange(len(odd) + 1))
    for k, i in enumerate(odd):
        text = points[bounds[k] : bounds[k + 1]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
        out[i] = unicodedata.normalize("NFC", text) if composed[k] else text
    return out


def normalize_texts(df: DataFrame, text: str = "text", to: str = "text_form") -> DataFrame:
    """Add column ``to``: ``text`` in the one form in which texts that look alike are equal.

    Nulls stay null and empty texts empty; rows, order of columns and all other columns are kept; a column that
    already has the name ``to`` is replaced. Whole texts of any length are read. No shuffle.
    """

    @F.pandas_udf("string")
    def form(values):
        import pandas as pd

        known = values.notna().to_numpy()
        out = pd.Series([None] * len(values), dtype=object)
        out[known] = common_forms(values[known].tolist())
        return out

    return df.withColumn(to, form(F.col(text)))


def look_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look, stored): 128-bit digests of the common form and of the stored text of each non-empty text."""
    kind = docs.schema[key].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms = common_forms(texts)
            stored = [one(t) for t in texts]
            look = [s if f is t else one(f) for t, f, s in zip(texts, forms, stored)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(look, pa.binary()), pa.array(stored, pa.binary())], names=["key", "look", "stored"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and length(text) > 0")
    schema = T.StructType([T.StructField("key", kind), T.StructField("look", T.BinaryType()), T.StructField("stored", T.BinaryType())])
    return rows.mapInArrow(digest, schema)


def look_alike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), smaller first: texts with one look that are stored with different characters.

    Only keys and digests are shuffled, after the looks with a single stored form are dropped. Pairs of a look are
    made in salted blocks, so a look that many rows share does not fall to one task. A key that is delivered
    several times with the same text counts once.
    """
    return pairs_within(materialize(look_keys(docs, key, text), "looks"), "look", "key", "stored").select(
        F.col("id_a").alias(f"{key}_a"), F.col("id_b").alias(f"{key}_b")
    )


def look_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, look, documents, forms): one row per key and look of its non-empty text.

    ``look`` is the digest of the common form, ``documents`` how many rows share it, ``forms`` in how many stored forms.
    """
    looks = materialize(look_keys(docs, key, text).distinct(), "looks")
    groups = materialize(looks.groupBy("look").agg(F.count("*").alias("documents"), F.countDistinct("stored").alias("forms")), "groups")
    return join_hot(looks.select("key", "look").distinct(), groups, ["look"]).select(F.col("key").alias(key), F.hex("look").alias("look"), "documents", "forms")
