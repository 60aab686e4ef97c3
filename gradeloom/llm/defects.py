"""Question and answer pairs whose answer makes them unfit for training, each with its kind of defect.

Copies are found by compression: the answer is compressed with its question as a raw zstandard dictionary, and what
a copy takes beyond the question itself is then a small share of it. Refusals and languages come from dictionaries. Whether an answer breaks
off is decided by a model of terminal contexts: a logistic regression over the shape of the last characters and the
state of the formula they stand in, fitted on a bounded sample of the answers themselves, where real ends are one
class and cuts at hashed places within sentences the other. Flagging is one pass without a shuffle of texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.few import few_rows
from gradeloom.llm.language import language
from gradeloom.llm.textform import MARKUP

#: Most rows the model of terminal contexts is fitted on (those with the smallest hashes of the key).
SAMPLE_ROWS = 4000
#: Compressed bytes that a copy takes at most beyond those of the question itself, as a share of those it takes without dictionary.
COPY_SHARE = 0.15
#: Words of prose that an answer must have to be a copy, unless it is the whole question; fewer are a bare result.
COPY_WORDS = 3

# What is written where an answer was not given, without blanks and marks.
PLACEHOLDERS = frozenset("null none nan nil na tbd tba todo empty pending placeholder notavailable notprovided noanswer missing".split())
# Phrases that decline to answer.
REFUSALS = {
    "en": r"(?:can(?:no|')t|cannot|can not|unable to|not able to|won't|will not|not allowed to|not permitted to|not going to)(?: be able to)? "
    r"(?:help|assist|answer|provide|respond|solve|comply|do that|discuss|fulfill|be working|complete)|unable to (?:assist|help)|must decline|have to decline|"
    r"decline to|(?:rather|prefer to) not|don't feel comfortable|do not feel comfortable|guidelines (?:keep|prevent|do not|don't)|no solution can be|"
    r"against my|not something i can|refuse to",
    "de": r"kann (?:diese|dieses|ich|dir|ihnen|das|dabei|hier|nicht)[^.!?]{0,40}(?:nicht|keine)|darf ich (?:nicht|keine)|möchte (?:hierzu |dazu |ich )?(?:keine|nicht)|"
    r"ich (?:lehne|verweigere)|nicht (?:helfen|beantworten)|keine lösung geben|keine antwort geben",
    "fr": r"je ne (?:peux|puis|suis|veux|vais|souhaite) (?:pas|malheureusement)|je préfère ne pas|je dois (?:refuser|décliner)|je refuse|pas autorisée? à|"
    r"impossible (?:pour moi )?de (?:répondre|vous aider)",
    "es": r"no (?:puedo|podré|quiero|debo|voy a) (?:ayudar|responder|contestar|dar|resolver|ofrecer)|no me está permitido|no se me permite|prefiero no|"
    r"me niego a|debo (?:rechazar|declinar)",
    "ru": r"не (?:могу|смогу|стану|буду|хочу|вправе) (?:помочь|ответить|отвечать|решать|давать|дать|предоставить|помогать)|нельзя отвечать|"
    r"вынужден[аы]? отказать|отказываюсь|мне (?:нельзя|запрещено|не разрешено)",
    "zh": r"(?:不能|无法|不便|不可以|没法|不会)(?:帮|回答|提供|解答|协助|给出|处理|为)|不想(?:回答|提供|给出|解答)|不允许|不被允许|拒绝|不方便|不打算|恕难|恕我|抱歉",
}
# Words that announce a result.
RESULT_WORDS = (
    r"answer|result|value|total|equals|therefore|antwort|ergebnis|wert|insgesamt|réponse|résultat|valeur|trouve|respuesta|resultado|valor|"
    r"obtiene|ответ|значение|получаем|итог|答案|结果|得到|所求"
)
# Headings before a question that is repeated.
LABELS = r"question|problem|task|exercise|frage|aufgabe|énoncé|exercice|problème|pregunta|problema|ejercicio|вопрос|задача|题目|问题|題目|問題"

_INVISIBLE = re.compile(r"[\u00ad\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\x00-\x08\x0e-\x1f\x7f]")
_HAN = re.compile(r"[\u3400-\u9fff]")
_TAG = re.compile(rf"{MARKUP}|</?[A-Za-z][^<>]{{0,58}}>")
_MORE_THAN_A_PLACEHOLDER = re.compile(rf"(?:[^\W_][\W_]*+){{{max(map(len, PLACEHOLDERS)) + 1}}}")
_WRAPPER = re.compile(r"\\(?:boxed|fbox|text|mathrm|textbf|left|right)\b")
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS.values()))
_MATH_SIGN = re.compile(r"[$\\=]")
_FORMULA = re.compile(r"\$\$.+?\$\$|\$[^$]+\$|\\\[.+?\\\]|\\\(.+?\\\)", re.S)
_LABEL = re.compile(rf"^[\s*_#\"“]*(?:{LABELS})[\s*_]*[:：]", re.I)
_BOX_OPENS, _BRACE = re.compile(r"\\(?:boxed|fbox)\s*\{"), re.compile(r"(?<!\\)[{}]")
_CUE = re.compile(rf"(?:{RESULT_WORDS})", re.I)
_CUE_NUMBER = re.compile(rf"(?:{RESULT_WORDS})[^.!?。！？\n$]{{0,24}}?[:：=]?[\s*_]*\$?-?\d[\d.,/]*\$?[\s*_]*[.。]?$", re.I)
_SENTENCE_END = re.compile(r"[.!?。！？][\"'»”)\]*_]*\s|\n")
_FORMATTING = re.compile(r"\\(?:[,!;:]|quad|qquad|left\b|right\b|[()\[\]])|[$*_`\"“”]+")
_COMMAND, _PROSE = re.compile(r"\\[A-Za-z]+"), re.compile(r"[^\W\d_\u3400-\u9fff]{2,}")
_ENDS = ".!?。！？…"


def visible(text: str | None) -> str:
    return _INVISIBLE.sub("", text or "").strip()


def says_nothing(answer: str | None) -> bool:
    """Null, blank, invisible, wrappers around nothing, or a mere placeholder."""
    text = _WRAPPER.sub("", _TAG.sub("", visible(answer)))
    if _MORE_THAN_A_PLACEHOLDER.search(text):
        return False
    text = "".join(c for c in text.casefold() if not c.isspace() and not (unicodedata.category(c)[0] == "P" or c in "$`^|~+=<>"))
    return not text or text in PLACEHOLDERS


def declines(question: str | None, answer: str) -> bool:
    """A refusal phrase in a text that has no result and no formula but those of the question."""
    text = answer.lower().replace("\u2019", "'")
    if not _REFUSAL.search(text):
        return False
    asked = (question or "").lower()
    own = _FORMULA.sub(lambda m: " " if m.group() in asked else m.group(), text)
    return not _MATH_SIGN.search(own) and not _CUE_NUMBER.search(own.rstrip())


def prose_words(text: str) -> int:
    """Words outside TeX commands; two Chinese characters count as one."""
    return len(_PROSE.findall(_COMMAND.sub(" ", text))) + len(_HAN.findall(text)) // 2


def _squeezed(text: str) -> bytes:
    """A text without blanks, letter case, formatting and a heading."""
    text = _LABEL.sub("", text, count=1)
    plain = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()
    return "".join(_FORMATTING.sub(" ", plain).split()).encode("utf-8", "surrogatepass")


def _with_dictionary(text: bytes, words: bytes) -> int:
    """Compressed bytes of a text with another as its dictionary."""
    d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if words else None
    params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0)
    return len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(text))


def copies_question(question: str, answer: str) -> bool:
    """The whole question or a part of it, perhaps with small changes, and no result after it.

    What the answer takes compressed, with the question as dictionary, beyond what the question itself takes is held
    against what it takes without, so short, long and repetitive texts are judged alike.
    """
    asked, said = _squeezed(question), _squeezed(answer)
    if not asked or not said:
        return False
    if said == asked:
        return True
    if said not in asked:
        own = _with_dictionary(said, asked)
        if own > COPY_SHARE * len(said) + 48:  # with room for what a question itself takes, 16 to 25
            return False
        if own - _with_dictionary(asked, asked) > COPY_SHARE * _with_dictionary(said, b""):
            return False
    if prose_words(answer) < COPY_WORDS:
        return False
    return not (asked in said and any(48 <= c < 58 for c in said.replace(asked, b"")))  # restated and given a result


_CLASSES = 12


def _char_class(c: str) -> int:
    if c.isdigit():
        return 0
    if c.isalpha():
        return 1 if ord(c) < 0x3400 else 2
    if c.isspace():
        return 3
    if c in _ENDS:
        return 4
    return {"$": 5, "}": 6, "]": 7, ")": 8, "\\": 9, "{": 10}.get(c, 11)


FEATURES = 10 + 64 + _CLASSES**2


def last_sentence(text: str) -> str:
    """What follows the last end of a sentence that is not the end of the text."""
    for begin in (len(text) - 300, 0):  # most sentences are short; the whole text where this one isn't
        ends = [m.end() for m in _SENTENCE_END.finditer(text, max(0, begin))]
        ends = [e for e in ends if e < len(text)]
        if ends:
            return text[ends[-1] :]
    return text


def has_box(text: str) -> bool:
    """A box that is closed, however long it is."""
    return "box" in text and any(depth_end(text, m.end()) for m in _BOX_OPENS.finditer(text))


def depth_end(text: str, at: int) -> int:
    """Where the brace that opens before ``at`` closes, 0 if it doesn't."""
    depth = 1
    for m in _BRACE.finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return 0


def terminal_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of the features of the end of a text."""
    tail = text[-1:]
    cut = text.rstrip()
    n = cut.count("$") - cut.count("\\$")
    open_math = n % 2 == 1 or cut.rfind("\\[") > cut.rfind("\\]") or cut.rfind("\\(") > cut.rfind("\\)")
    stars = cut.count("**") % 2 == 1
    final = last_sentence(cut)
    braces = final.count("{") != final.count("}")
    box = has_box(final)
    ended = cut[-1:] in _ENDS and not open_math
    flags = (1.0, open_math, stars, braces, box, ended, bool(_CUE_NUMBER.search(final)), bool(_CUE.search(final)), cut.endswith(("\\]", "\\)", "$$")), len(final) < 30)
    at = [i for i, f in enumerate(flags) if f]
    at.append(10 + zlib.crc32(tail.encode("utf-8", "surrogatepass")) % 64)
    a, b = (_char_class(c) for c in (cut[-2:] if len(cut) > 1 else "  "))
    at.append(74 + a * _CLASSES + b)
    return np.array(at), np.ones(len(at))


def _cut(text: str, seed: int) -> str | None:
    """The text broken off at a hashed place within a sentence before its last one."""
    low, high = max(12, len(text) // 12), max(13, int(len(text) * 0.92))
    place = low + zlib.crc32(f"{seed}".encode()) % (high - low)
    part = text[:place].rstrip()
    if not part or part[-1] in _ENDS or has_box(part) or _SENTENCE_END.match(text, place - 1):
        return None
    return part


class TerminalModel:
    """Logistic regression of whether a text breaks off, over the features of its end."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def fit(cls, answers: list[str], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> TerminalModel:
        rows, labels = [], []
        for seed, text in enumerate(answers):
            text = visible(text)
            if len(text) < 60:
                continue
            rows.append(text)
            labels.append(0.0)
            part = _cut(text, seed)
            if part:
                rows.append(part)
                labels.append(1.0)
        weights = np.zeros(FEATURES)
        if not rows:
            return cls(weights)
        x = np.zeros((len(rows), FEATURES))
        for i, text in enumerate(rows):
            x[i, terminal_features(text)[0]] = 1
        y = np.array(labels)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(x @ weights)))
            weights -= rate * 10 * ((x.T @ (p - y)) / len(y) + ridge * weights)
        return cls(weights)

    def breaks_off(self, answer: str) -> float:
        return float(1 / (1 + math.exp(-float(self.weights[terminal_features(answer)[0]].sum()))))


def truncated(answer: str, model: TerminalModel) -> bool:
    """No result is reached and the end looks like a break within a sentence, word or formula."""
    text = visible(answer)
    if has_box(text):
        return False
    if text.replace("\\$", "").count("$") % 2:
        return True  # within a formula
    words = re.findall(r"[^\W\d_]{2,}", re.sub(r"\\[A-Za-z]+", " ", text))
    if len(words) < 2 and len(_HAN.findall(text)) < 4 and text.count("$") % 2 == 0 and text.count("{") == text.count("}") and not text.endswith(("\\", "=", "^", "_", "+")):
        return False  # a bare result
    return model.breaks_off(text) > 0.5


def defect(question: str | None, answer: str | None, model: TerminalModel) -> str | None:
    """The one defect of a pair: the first of empty, refusal, copied_question, other_language and truncated."""
    if says_nothing(answer):
        return "empty"
    if declines(question, answer):
        return "refusal"
    if question and copies_question(question, answer):
        return "copied_question"
    spoken = language(answer)
    if spoken and (asked := language(question)) and spoken != asked:
        return "other_language"
    return "truncated" if truncated(answer, model) else None


def fit_terminal_model(pairs: DataFrame, key: str, answer: str, sample_rows: int = SAMPLE_ROWS) -> TerminalModel:
    """Fitted on at most ``sample_rows`` rows."""
    sample = few_rows(pairs.where(F.length(answer) >= 60), sample_rows, [key, answer], [answer])
    return TerminalModel.fit([r[answer] for r in sample])


def defects(pairs: DataFrame, key: str = "train_idx", question: str = "question", answer: str = "answer", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, defect): the defective pairs, one row per key.

    Rows delivered again count once; if rows of one key differ, the first defect in the order of ``defect`` is kept.
    A null answer is empty; a null question can neither be copied nor differ in language. Rows with a null key are
    left out. Whole texts are judged, however long.
    """
    model = pairs.sparkSession.sparkContext.broadcast(fit_terminal_model(pairs, key, answer, sample_rows).weights)
    schema = T.StructType([T.StructField(key, pairs.schema[key].dataType), T.StructField("defect", T.StringType())])

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TerminalModel(model.value)
        for batch in batches:
            kinds = [defect(q, a, own) for q, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            at = pa.array([i for i, k in enumerate(kinds) if k], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([k for k in kinds if k], pa.string())], names=[key, "defect"])

    order = F.array(*[F.lit(k) for k in ("empty", "refusal", "copied_question", "other_language", "truncated")])
    flagged = pairs.select(key, question, answer).where(F.col(key).isNotNull()).mapInArrow(flag, schema)
    return flagged.groupBy(key).agg(F.min_by("defect", F.array_position(order, F.col("defect"))).alias("defect"))
