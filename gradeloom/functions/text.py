"""Column functions over questions and solutions; built-ins wherever Spark has them."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.questions import normal_question

# The patterns of the reject rules, as regular expressions that Java, Python and RE2 read alike.
PROOF = r"(?i)\b(?:prove|show|demonstrate|establish)\s+(?:that|why)\b"
MULTIPLE_CHOICE = (
    r"(?is)(?:\\text\s*\{?\s*\(?[A-E]\)?\s*\}?\s*[,;]|(?:^|\n)\s*\(?[A-E]\)\s+.*(?:\n\s*\(?[B-E]\)\s+)|"
    r"\b(?:multiple choice|choose (?:the|an) (?:correct|best)|answer choices?)\b)"
)
INLINE_OPTION = r"(?i)(?:^|\s)(?:\\text\s*\{\s*)?\(?[A-E]\)(?:\s*\})?"
DIAGRAM = r"(?i)\b(?:diagram|figure|graph shown|pictured|illustration|shown (?:above|below)|not drawn to scale)\b"
NON_UNIQUE = r"(?i)(?:\b(?:give|provide|construct|find)\s+(?:an|one|some)\s+(?:example|possible|such)\b|\banswers?\s+(?:may|can)\s+vary\b)"
ANSWER_CUE = r"(?i)(?:\b(?:answer|solution)\s*(?:is|:|=)|\\boxed\s*\{)"
TOOL_RESIDUE = (
    r"(?i)(?:```|<tool|</tool>|tool[_ -]?(?:call|output)|python\s*(?:code|output)|sympy\.|wolfram|calculator\s*(?:output|result)|execution\s+result)"
)
NUMBER = r"(?<![a-z])[-+]?\d+(?:[.,]\d+)*(?:e[-+]?\d+)?"
VARIABLE = r"(?<![a-z])[a-z](?![a-z])"
THINK_TAG = r"(?i)</?think\s*>"
# Fixed value: the prompt a question is put into; its digest is part of every graded table.
PROMPT = "Solve the math problem. Please reason step by step, and put your final answer within \\boxed{}.\n\n"
LINE_CHARS, LOOP_COUNT, LOOP_WORDS, WINDOW_WORDS = 24, 3, 60, 20


def normalize_question(text: Column | str) -> Column:
    """The normal form of a question; null becomes the empty string."""

    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return values.map(normal_question, na_action=None)

    return form(F.col(text) if isinstance(text, str) else text)


def question_hash(text: Column | str) -> Column:
    """sha256 of the normal form."""
    return F.sha2(normalize_question(text), 256)


def template(normalized: Column) -> Column:
    """A normalised question with numbers and single Latin letters replaced by marks."""
    numbers = F.regexp_replace(normalized, "(?U)" + NUMBER, " <num> ")
    return F.trim(F.regexp_replace(F.regexp_replace(numbers, VARIABLE, " <var> "), r"(?U)\s+", " "))


def template_hash(text: Column | str) -> Column:
    """The family of a question: sha256 of its template."""
    return F.sha2(template(normalize_question(text)), 256)


def char_ngrams(text: Column, n: int = 5) -> Column:
    """The distinct n-character pieces; none for an empty text, the text itself if it is shorter. Null stays null."""
    # the characters are bound to a variable, else each piece would split the text again
    of = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.concat(*[F.element_at(c, i + k) for k in range(n)])))
    grams = F.get(F.transform(F.array(F.split(text, "")), of), F.lit(0))
    return F.when(text == "", F.array().cast("array<string>")).when(F.length(text) < n, F.array(text)).when(text.isNotNull(), grams)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets of pieces; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def strip_think_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), THINK_TAG, ""))


def has_tool_residue(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(TOOL_RESIDUE)


def question_reject_reason(question: Column) -> Column:
    """The first reason to leave a question out, null for none; null and blank questions are ``empty_question``."""
    q = F.coalesce(question, F.lit(""))
    return (
        F.when(q.rlike(r"(?U)^\s*$"), "empty_question")
        .when(q.rlike(PROOF), "proof_problem")
        .when(q.rlike(MULTIPLE_CHOICE) | (F.regexp_count(q, F.lit(INLINE_OPTION)) >= 3), "multiple_choice")
        .when(q.rlike(DIAGRAM), "diagram_dependent")
        .when(q.rlike(NON_UNIQUE), "non_unique_answer")
        .when(q.rlike(ANSWER_CUE), "answer_leakage_cue")
    )


def _comes_again(items: Iterable, times: int) -> bool:
    """Whether an item comes so many times; stops where one does."""
    seen: Counter = Counter()
    for x in items:
        seen[x] += 1
        if seen[x] == times:
            return True
    return False


def loops(text: str | None) -> bool:
    """A line of 24 characters or a run of 20 words that comes three times (runs only in texts of 60 words)."""
    folded = (text or "").casefold()
    long_lines = (line for raw in folded.splitlines() if len(line := " ".join(raw.split())) >= LINE_CHARS)
    if _comes_again(long_lines, LOOP_COUNT):
        return True
    words = folded.split()
    return len(words) >= LOOP_WORDS and _comes_again(zip(*(words[k:] for k in range(WINDOW_WORDS))), LOOP_COUNT)


def has_repetition_loop(text: Column) -> Column:
    @F.pandas_udf("boolean")
    def check(values: pd.Series) -> pd.Series:
        return values.map(loops, na_action=None).astype(bool)

    return check(text)


def gold_boxed(answer: Column) -> Column:
    a = F.trim(F.coalesce(answer, F.lit("")))
    return F.when(a.rlike(r"\\(?:boxed|fbox)\s*\{"), a).otherwise(F.concat(F.lit("\\boxed{"), a, F.lit("}")))


def difficulty_bucket(value: Column) -> Column:
    """The lower half step, printed with one decimal."""
    return F.format_string("%.1f", F.floor(value * 2) / 2)


def prompt(question: Column) -> Column:
    return F.concat(F.lit(PROMPT), question)


def prompt_version() -> Column:
    return F.substring(F.sha1(F.lit(PROMPT.replace("{}", "{{}}") + "{q}")), 1, 12)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def capped_slug(name: Column, cap: int = 64) -> Column:
    """A slug of at most ``cap`` characters; a longer one ends in the first 12 digits of its sha256."""
    s = slug(name)
    return F.when(F.length(s) <= cap, s).otherwise(F.concat(F.substring(s, 1, cap - 13), F.lit("-"), F.substring(F.sha2(s, 256), 1, 12)))


def data_tag(name: str, prefix: str = "", cap: int = 20) -> str:
    """A short tag of a data set: letters, digits and ``._-``; one longer than the cap keeps its beginning and a digest."""
    tag = "".join(c if c.isalnum() or c in "._-" else "-" for c in name.removeprefix(prefix)).strip("-.") or "run"
    return tag if len(tag) <= cap else f"{tag[: cap - 9]}-{hashlib.sha256(tag.encode()).hexdigest()[:8]}"


def run_slug(parts: Sequence[tuple[str, str | int | float]], cap: int = 64) -> str:
    """Labelled settings of a run in one name; numbers are printed short, a name over the cap is an error."""
    name = "-".join(label + (f"{value:g}" if isinstance(value, float) else str(value)) for label, value in parts)
    if len(name) > cap:
        raise ValueError(f"{name!r} has more than {cap} characters")
    return name


def hit_limit(ids: Column, stops: list[int], n: int) -> Column:
    """1 if a generation has n ids or more and none of them is a stop id, else 0."""
    return F.when((F.size(ids) >= n) & ~F.exists(ids, lambda x: x.isin(stops)), 1).otherwise(0)


def first_line(text: Column) -> Column:
    """First line that isn't blank, trimmed; null if there is none."""
    return F.get(F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))


def last_line(text: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(-1))


def keep_last(ids: Column, n: int) -> Column:
    """Left truncation: the last n ids."""
    return F.when(F.size(ids) <= n, ids).otherwise(F.slice(ids, -n, n))


def expected_bos(ids: Column, n: int) -> Column:
    """How many start marks a prompt should have: none once it was cut on the left."""
    return F.when(F.size(ids) > n, 0).otherwise(1)


def count_id(ids: Column, which: int) -> Column:
    return F.size(F.filter(ids, lambda x: x == which))


def train_ids(prompt_ids: Column, completion_ids: Column, n: int) -> Column:
    return F.slice(F.concat(prompt_ids, completion_ids), 1, n)


def train_labels(prompt_ids: Column, completion_ids: Column, n: int, masked: int = -100) -> Column:
    return F.slice(F.concat(F.transform(prompt_ids, lambda x: F.lit(masked).cast("long")), completion_ids), 1, n)


def stop_position(ids: Column, stops: list[int]) -> Column:
    """Number of ids up to and with the first stop id, all of them if there is none."""
    found = F.filter(F.transform(ids, lambda x, i: F.when(x.isin(stops), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.size(ids))


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.to_json(ids), 256)


def first_truthy(*columns: Column) -> Column:
    """The first value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])
