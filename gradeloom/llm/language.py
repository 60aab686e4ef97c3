"""Languages of short mathematical texts by scripts and dictionaries of function words."""

from __future__ import annotations

import re
from collections import Counter

# Frequent function words of each language written in Latin letters.
FUNCTION_WORDS = {
    "en": "the of and is are to in that we it for by as be with on this which so from has have not each at than its an when if then "
    "how what such where must can all no into after between find given let",
    "de": "der die das und ist ein eine einen nicht wir mit für den von zu dem auf es als dass des sich wenn wird werden gilt für sind "
    "bei aus nach alle im wobei deren damit durch da man ich kann falls höchstens sodass",
    "fr": "le la les et est un une des du que pour dans on qui avec par en ce sont au aux ne pas dont donc je il se comme sur plus tous "
    "toutes quel quelle soit nous entre après chaque car",
    "es": "el la los las y es un una de que por con en se del para lo como al su sus no si ya más son tras cada cuyo cuya entre así "
    "todos todas cuántos cuál sea porque qué",
}
# Words that mathematical texts of each language often use.
SUBJECT_WORDS = {
    "en": "answer result value sum equals gives yields becomes terms contributes therefore thus since because both sides obtain next step proof number",
    "de": "antwort ergebnis wert summe gleich gilt erhalten insgesamt somit also daraus folgt sofort zahl gesuchte nun setzen finden seiten beide aufgabe lösung",
    "fr": "réponse résultat valeur somme égale égal obtient trouve finalement donc maintenant membres nombre cherchée ensemble comme aucune solution",
    "es": "respuesta resultado valor suma igual obtenemos obtiene hallamos finalmente entonces ahora tomamos ambos lados número buscado deduce tanto solución",
}
# Letters that only one of these languages uses often.
OWN_LETTERS = {"de": "ßäöü", "fr": "çèêàùœîôû", "es": "ñ¿¡íóú"}

# Words of further languages, which count only where they outnumber those of the languages above.
MORE_WORDS = {
    "it": "il lo gli di che è e non per una uno sono della delle degli del nel nella con alla dei quindi dunque poiché allora risposta risultato valore trovare trova dato siano sia ogni come anche cui si ha",
    "pt": "o os as um uma de do da dos das que é e não para com em no na nos nas ao são então portanto resposta resultado valor logo assim temos seja onde cada pelo pela mais",
    "nl": "het een en van is dat de niet zijn wordt met voor op te als dus daarom antwoord waarde geeft vinden hebben we uit bij naar ook er dan maar elke",
    "pl": "i w na nie jest się z do że o to jak dla są więc zatem odpowiedź wynik wartość liczba oraz który która gdy mamy przez po od każdy",
    "sv": "och att det som en är på av för med den till inte om ett har vi så därför svaret värdet får alltså varje eller från kan",
    "tr": "ve bir bu için ile olan olarak değeri cevap sonuç ise da de en çok olduğu buna göre her sayı bulunur eşittir",
}
# Ranges of letters that tell a language; Greek letters stand in formulas and need more of them.
SCRIPTS = {"ja": (r"[\u3040-\u30ff]", 2), "ko": (r"[\u1100-\u11ff\uac00-\ud7af]", 4), "ar": (r"[\u0600-\u06ff]", 4), "he": (r"[\u0590-\u05ff]", 4), "hi": (r"[\u0900-\u097f]", 4), "th": (r"[\u0e00-\u0e7f]", 4), "el": (r"[\u0370-\u03ff]", 12)}

_MATH = re.compile(r"\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\)|\\[A-Za-z]+", re.S)
_WORD = re.compile(r"[^\W\d_]+")
_CYRILLIC, _HAN = re.compile(r"[\u0400-\u04ff]"), re.compile(r"[\u3400-\u9fff]")
_BY_WORD: dict[str, tuple[str, ...]] = {}
for _lang in FUNCTION_WORDS:
    for _w in {*FUNCTION_WORDS[_lang].split(), *SUBJECT_WORDS[_lang].split()}:
        _BY_WORD[_w] = (*_BY_WORD.get(_w, ()), _lang)
_MORE: dict[str, tuple[str, ...]] = {}
for _lang, _words in MORE_WORDS.items():
    for _w in {w for w in _words.split() if len(w) > 1}:  # single letters stand in formulas
        _MORE[_w] = (*_MORE.get(_w, ()), _lang)
_SCRIPTS = {lang: (re.compile(letters), least) for lang, (letters, least) in SCRIPTS.items()}
_BY_LETTER = {c: lang for lang, letters in OWN_LETTERS.items() for c in letters}


def language(text: str | None) -> str | None:
    """A language of the dictionaries or scripts, or None where the words outside formulas don't decide it."""
    if not text:
        return None
    prose = _MATH.sub(" ", text).lower()
    words = _WORD.findall(prose)
    han = cyrillic = 0
    if not prose.isascii():
        han, cyrillic = len(_HAN.findall(prose)), len(_CYRILLIC.findall(prose))
    latin = sum(map(len, words)) - han - cyrillic
    if not prose.isascii():
        for lang, (letters, least) in _SCRIPTS.items():
            if (n := len(letters.findall(prose))) >= least and 3 * (n + (han if lang == "ja" else 0)) >= latin - n:
                return lang
    if han >= 2 and 3 * han >= latin:
        return "zh"
    if cyrillic >= 4 and cyrillic >= latin:
        return "ru"
    scores = {"en": 0.0, "de": 0.0, "fr": 0.0, "es": 0.0}
    for w in words:
        langs = _BY_WORD.get(w)
        if langs:
            for lang in langs:
                scores[lang] += 1.0 / len(langs)
    if not prose.isascii():
        for c in prose:
            if c in _BY_LETTER:
                scores[_BY_LETTER[c]] += 0.5
    more = [w for w in words if w in _MORE]
    if len(more) >= 3 and len(more) >= 1.5 * max(scores.values()):
        known = Counter(lang for w in words for lang in _BY_WORD.get(w, ()))
        found = Counter(lang for w in more for lang in _MORE[w])
        lang, n = max(found.items(), key=lambda x: (x[1], x[0]))
        next_best = max((k for x, k in found.items() if x != lang), default=0)
        if len({w for w in more if lang in _MORE[w]}) >= 3 and n >= 1.5 * max(known.values(), default=0) and n >= 1.2 * next_best:
            return lang
    (best, top), (_, second) = sorted(scores.items(), key=lambda x: -x[1])[:2]
    return best if top >= 1.5 and top >= 1.5 * second else None
