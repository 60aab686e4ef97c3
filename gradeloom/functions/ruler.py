"""Rulers that decide whether an answer equals the gold answer, and the default for a documented subset.

The default ruler needs no symbolic mathematics: it compares answers that are, after TeX clean-up, equal as text, or
are numbers (integers, decimals, fractions, percentages, roots and powers of numbers), or are tuples, sets and
intervals of such. What it can't read and isn't equal as text counts as wrong; ``supported`` tells them apart.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.boxes import answer_source, box_content, last_box, terminal_answer

RULER_VERSION = "gradeloom-subset-v1"


class Ruler(Protocol):
    version: str

    def parse_strict(self, text: str | None) -> str | None: ...

    def parse_fallback(self, text: str | None) -> str | None: ...

    def is_correct(self, gold: str | None, answer: str | None) -> bool: ...


def clean(answer: str) -> str:
    """TeX without layout: delimiters, sizes, spacing and text wrappers removed."""
    s = answer.strip()
    s = re.sub(r"\\(?:left|right|big|Big|displaystyle|limits)\b|\\[,!;: ]|\\(?:quad|qquad)\b|~", "", s)
    s = re.sub(r"\\(?:text|mathrm|mathbf|operatorname)\s*\{([^{}]*)\}", r"\1", s)
    s = re.sub(r"\\[dt]frac", r"\\frac", s)
    s = s.replace("\\(", "").replace("\\)", "").replace("\\[", "").replace("\\]", "").replace("$", "").replace("\\%", "%").replace("\\cdot", "*").replace("\\times", "*")
    return re.sub(r"\s+", "", s).rstrip(".,;")


_NUMBER = re.compile(r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)?(?:\.\d+)?")


def value(text: str) -> Fraction | float | None:
    """The number a cleaned answer stands for."""
    s = text
    sign = 1
    while s[:1] in "+-" and s:
        sign, s = (-sign if s[0] == "-" else sign), s[1:]
    if s.endswith("%"):
        v = value(s[:-1])
        return None if v is None else sign * v / 100
    if s and _NUMBER.fullmatch(s) and any(c.isdigit() for c in s):
        return sign * Fraction(s.replace(",", ""))
    for pattern, make in (
        (r"\\frac\{(.+)\}\{(.+)\}", lambda a, b: a / b),
        (r"\\frac(\d)(\d)", lambda a, b: a / b),
        (r"([^/]+)/([^/]+)", lambda a, b: a / b),
        (r"(.+)\*(.+)", lambda a, b: a * b),
        (r"\\sqrt\[(.+)\]\{(.+)\}", lambda n, a: float(a) ** (1 / float(n))),
        (r"(.+)\^\{(.+)\}", lambda a, b: float(a) ** float(b)),
        (r"(.+)\^(\d)", lambda a, b: a**b),
        (r"(\d+)\\sqrt\{(.+)\}", lambda a, b: float(a) * math.sqrt(b)),
    ):
        if m := re.fullmatch(pattern, s):
            parts = [value(g) for g in m.groups()]
            if None not in parts:
                try:
                    return sign * make(*parts)
                except (ZeroDivisionError, OverflowError, ValueError, TypeError):
                    return None
    if m := re.fullmatch(r"\\sqrt\{(.+)\}|\\sqrt(\d)", s):
        v = value(m.group(1) or m.group(2))
        return None if v is None or v < 0 else sign * math.sqrt(v)
    if m := re.fullmatch(r"[({](.+)[)}]", s):
        v = value(m.group(1))
        return None if v is None else sign * v
    return None


def _same(a: str, b: str) -> bool:
    if a == b:
        return True
    x, y = value(a), value(b)
    if x is not None and y is not None:
        return x == y if isinstance(x, Fraction) and isinstance(y, Fraction) else math.isclose(float(x), float(y), rel_tol=1e-9)
    m, n = (re.fullmatch(r"(\\?[(\[{])(.*?,.*?)(\\?[)\]}])", t, re.S) for t in (a, b))
    if m and n and m.group(1) == n.group(1) and m.group(3) == n.group(3):
        p, q = m.group(2).split(","), n.group(2).split(",")
        if m.group(1).endswith("{"):
            return len(p) == len(q) and all(any(_same(u, v) for v in q) for u in p) and all(any(_same(u, v) for u in p) for v in q)
        return len(p) == len(q) and all(map(_same, p, q))
    for u, v in ((a, b), (b, a)):
        if (k := re.fullmatch(r"[A-Za-z]=(.+)", u)) and "=" not in v:
            return _same(k.group(1), v)
    return False


class SubsetRuler:
    version = RULER_VERSION

    def parse_strict(self, text: str | None) -> str | None:
        return (clean(box_content(text)) or None) if last_box(text or "") is not None else None

    def parse_fallback(self, text: str | None) -> str | None:
        if last_box(text or "") is not None:
            return self.parse_strict(text)
        return clean(terminal_answer(text)[0]) or None

    def is_correct(self, gold: str | None, answer: str | None) -> bool:
        return bool(gold) and bool(answer) and _same(gold, answer)

    def supported(self, answer: str | None) -> bool:
        return bool(answer) and value(answer) is not None


# Fixed values: (gold, answer, whether they are equal) that any ruler must judge so; an answer without box counts by its cue.
GOLDEN = (
    ("\\boxed{\\frac{1}{2}}", "so \\boxed{\\frac{1}{2}}", True), ("\\boxed{0.5}", "\\boxed{\\frac{1}{2}}", True), ("\\boxed{2}", "\\boxed{3}", False), ("\\boxed{(0,1)}", "\\boxed{(0,1)}", True),
    ("\\boxed{12}", "there is no boxed answer here", False), ("\\boxed{1/2}", "Final answer: $\\frac{1}{2}$", True), ("\\boxed{2}", "Intermediate: $2$.\nFinal answer: $3$", False),
)


def check_ruler(ruler: Ruler) -> None:
    """Fail unless a ruler judges the golden cases as it must and reads a strict answer from boxes alone."""
    wrong = [(g, t) for g, t, same in GOLDEN if ruler.is_correct(ruler.parse_strict(g), ruler.parse_fallback(t)) != same]
    if ruler.parse_strict("Final answer: $3$") is not None or ruler.parse_fallback("No final answer was given.") is not None:
        wrong.append(("", "answers without box"))
    if wrong:
        raise ValueError(f"ruler {ruler.version} fails {wrong}")


def grade(gold: Column, text: Column, ruler: Ruler | None = None) -> Column:
    """struct(strict_correct, fallback_correct, parse_fail, fallback_source, ruler_version) of a text against a boxed gold answer.

    A strict answer is a fallback answer, so strict_correct never exceeds fallback_correct. A ruler that fails the
    golden cases grades nothing.
    """
    r = ruler or SubsetRuler()
    check_ruler(r)

    @F.pandas_udf("strict_correct int, fallback_correct int, parse_fail int, fallback_source string, ruler_version string")
    def call(golds: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for g, t in zip(golds, texts):
            g, t = (None if v is None or v != v else v for v in (g, t))
            want, strict, loose = r.parse_strict(g), r.parse_strict(t), r.parse_fallback(t)
            rows.append((int(r.is_correct(want, strict)), int(r.is_correct(want, loose)), int(loose is None), answer_source(t), r.version))
        return pd.DataFrame(rows, columns=["strict_correct", "fallback_correct", "parse_fail", "fallback_source", "ruler_version"])

    return call(gold, text)
