"""Stems of English words by Porter's algorithm (1980), as column expressions.

A measure, the number of times a vowel is followed by a consonant, is asked for by
patterns; a y is a vowel behind a consonant. Each step is bound to a variable of
its own, so that no step is computed more than once a word. ``stemmed`` is the same
for one word, for workers that count words as they read them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_ANY, _ONE, _MORE = rf"^({_C})?{_V}{_C}", rf"^({_C})?{_V}{_C}({_V})?$", rf"^({_C})?{_V}{_C}{_V}{_C}"
_VOWEL = rf"^({_C})?[aeiouy]"
_SHORT = rf"^{_C}[aeiouy][^aeiouwxy]$"

# The suffixes of the second, third and fourth step, and what takes their place.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous",
    "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(word: Column, letters: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - letters)


def _plural(w: Column) -> Column:
    return F.when(w.endswith("sses") | w.endswith("ies"), _cut(w, 2)).when(w.endswith("s") & ~w.endswith("ss"), _cut(w, 1)).otherwise(w)


def _mended(w: Column) -> Column:
    """What is left of a word without its ed or ing."""
    silent = w.endswith("at") | w.endswith("bl") | w.endswith("iz")
    double = w.rlike(r"([^aeiouylsz])\1$")
    return F.when(silent, F.concat(w, F.lit("e"))).when(double, _cut(w, 1)).when(w.rlike(_ONE) & w.rlike(_SHORT), F.concat(w, F.lit("e"))).otherwise(w)


def _past(w: Column) -> Column:
    short = _cut(w, 3)
    return (
        F.when(w.endswith("eed"), F.when(short.rlike(_ANY), _cut(w, 1)).otherwise(w))
        .when(w.endswith("ed"), let(_cut(w, 2), lambda s: F.when(s.rlike(_VOWEL), _mended(s)).otherwise(w)))
        .when(w.endswith("ing"), let(short, lambda s: F.when(s.rlike(_VOWEL), _mended(s)).otherwise(w)))
        .otherwise(w)
    )


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, 1).rlike(_VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _replaced(w: Column, suffixes: dict[str, str], measure: str) -> Column:
    """The longest suffix that fits is replaced if what stands before it is long enough."""
    out = w
    for suffix, by in sorted(suffixes.items(), key=lambda x: len(x[0])):
        stem = _cut(w, len(suffix))
        out = F.when(w.endswith(suffix), F.when(stem.rlike(measure), F.concat(stem, F.lit(by))).otherwise(w)).otherwise(out)
    return out


def _final_e(w: Column) -> Column:
    stem = _cut(w, 1)
    return F.when(w.endswith("e") & (stem.rlike(_MORE) | stem.rlike(_ONE) & ~stem.rlike(_SHORT)), stem).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(_MORE), _cut(w, 1)).otherwise(w)


def _fourth(w: Column) -> Column:
    """As the others; an ion goes only behind s or t, which count as what stands before it."""
    stem = _cut(w, 3)
    ion = w.endswith("sion") | w.endswith("tion")
    return F.when(ion, F.when(stem.rlike(_MORE), stem).otherwise(w)).otherwise(_replaced(w, dict.fromkeys(FOURTH, ""), _MORE))


_STEPS: tuple[Callable[[Column], Column], ...] = (
    _plural, _past, _final_y, lambda w: _replaced(w, SECOND, _ANY), lambda w: _replaced(w, THIRD, _ANY), _fourth,
    _final_e, _final_l,
)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; words of one or two letters, and words with other letters than a to z, stay."""
    out = F.regexp_replace(word, "^y", "Y")  # at the beginning it is a consonant
    for step in _STEPS:
        out = let(out, step)
    return F.when(word.rlike("^[a-z]{3,}$"), F.lower(out)).otherwise(word)


_ENDINGS = [(table, sorted({len(x) for x in table}, reverse=True)) for table in (SECOND, THIRD, dict.fromkeys(FOURTH, ""))]
_LETTERS, _DOUBLE = re.compile("[a-z]{3,}"), re.compile(r"([^aeiouylsz])\1$")
_IS_ANY, _IS_ONE, _IS_MORE, _HAS_VOWEL, _IS_SHORT = (re.compile(p).search for p in (_ANY, _ONE, _MORE, _VOWEL, _SHORT))


def _without(word: str, step: int, measure: Callable[[str], object]) -> str:
    suffixes, lengths = _ENDINGS[step]
    for k in lengths:
        if (suffix := word[-k:]) in suffixes:
            before = word[: len(word) - len(suffix)]
            return before + suffixes[suffix] if measure(before) else word
    return word


@lru_cache(1 << 18)
def stemmed(word: str) -> str:
    """What ``stem`` gives for a word."""
    if not _LETTERS.fullmatch(word):
        return word
    w = "Y" + word[1:] if word[0] == "y" else word
    if w.endswith("s") and not w.endswith("ss") or w.endswith("sses"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _IS_ANY(w[:-3]) else w
    elif w.endswith(("ed", "ing")) and _HAS_VOWEL(short := w[:-2] if w.endswith("ed") else w[:-3]):
        w = short
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _DOUBLE.search(w):
            w = w[:-1]
        elif _IS_ONE(w) and _IS_SHORT(w):
            w += "e"
    if w.endswith("y") and _HAS_VOWEL(w[:-1]):
        w = w[:-1] + "i"
    w = _without(_without(w, 0, _IS_ANY), 1, _IS_ANY)
    if w.endswith(("sion", "tion")):
        w = w[:-3] if _IS_MORE(w[:-3]) else w
    else:
        w = _without(w, 2, _IS_MORE)
    if w.endswith("e") and (_IS_MORE(short := w[:-1]) or _IS_ONE(short) and not _IS_SHORT(short)):
        w = short
    if w.endswith("ll") and _IS_MORE(w):
        w = w[:-1]
    return w.lower()
