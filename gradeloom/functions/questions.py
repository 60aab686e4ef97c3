"""Normal form of questions, in plain Python for use inside Arrow functions."""

from __future__ import annotations

import re
import unicodedata

# TeX spacing commands that count as a blank.
TEX_SPACES = r"\\(?:,|!|;|:|quad|qquad)"
_TEX_SPACES = re.compile(TEX_SPACES)
_SIDES = re.compile(r"\\(?:left|right)\b")


def normal_question(text: str | None) -> str:
    """NFKC, case folding, TeX spacing and dollar signs to blanks, no ``\\left``/``\\right``, single blanks."""
    if not text:
        return ""
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    if "\\" in folded:
        folded = _SIDES.sub("", _TEX_SPACES.sub(" ", folded).replace("$", " "))
    else:
        folded = folded.replace("$", " ")
    return " ".join(folded.split())
