"""Stems of English words after Porter's published rules, as column functions.

Consonants and vowels are told apart by patterns: a y is a vowel but at a word's beginning or behind a vowel. A stem's measure
is the number of its vowel-consonant sequences. Words under three letters stay as they are. Stem distinct words, and
join them back: a word costs some forty patterns.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: A measure of one or more, of just one, of two or more; a vowel; a last consonant-vowel-consonant (not w, x, y).
SOME, ONE, MORE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"

#: Endings and what stands for them, in the rules' order.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _ending(endings) -> str:
    """A pattern of a stem and the longest of the endings."""
    return f"^(.+?)({'|'.join(endings)})$"


def _replaced(word: Column, endings: dict[str, str]) -> Column:
    pattern = _ending(endings)
    to = F.create_map(*map(F.lit, chain.from_iterable(endings.items())))
    own = F.struct(F.regexp_extract(word, pattern, 1).alias("stem"), F.regexp_extract(word, pattern, 2).alias("end"))
    return _let(own, lambda x: F.when((x.end != "") & x.stem.rlike(SOME), F.concat(x.stem, to[x.end])).otherwise(word))


def _plural(w: Column) -> Column:
    return F.when(w.rlike("^.+(ss|i)es$"), F.regexp_replace(w, "es$", "")).when(w.rlike("^.+[^s]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)


def _past(w: Column) -> Column:
    shorter = lambda x: F.substring(x, F.lit(1), F.length(x) - 1)

    def tidied(x: Column) -> Column:
        double = x.rlike("[^aeiouylsz]$") & (F.length(x) > 1) & (F.substring(x, -1, 1) == F.substring(x, -2, 1))
        return F.when(x.rlike("(at|bl|iz)$") | ~double & x.rlike(SHORT), F.concat(x, F.lit("e"))).when(double, shorter(x)).otherwise(x)

    stem = F.regexp_extract(w, "^(.+?)(ed|ing)$", 1)
    other = _let(stem, lambda s: F.when(s.rlike(VOWEL), tidied(s)).otherwise(w))
    return F.when(w.rlike("^.+eed$"), F.when(F.regexp_extract(w, "^(.+?)eed$", 1).rlike(SOME), shorter(w)).otherwise(w)).otherwise(other)


def _last_y(w: Column) -> Column:
    stem = F.regexp_extract(w, "^(.+?)y$", 1)
    return F.when(stem.rlike(VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)


def _dropped(w: Column) -> Column:
    own, ion = F.regexp_extract(w, _ending(FOURTH), 1), F.regexp_extract(w, "^(.+?[st])ion$", 1)
    return F.when(own != "", F.when(own.rlike(MORE), own).otherwise(w)).when(ion.rlike(MORE), ion).otherwise(w)


def _last_e(w: Column) -> Column:
    stem = F.regexp_extract(w, "^(.+?)e$", 1)
    return F.when(stem.rlike(MORE) | stem.rlike(ONE) & ~stem.rlike(SHORT), stem).otherwise(w)


def _last_l(w: Column) -> Column:
    return F.when(w.rlike("ll$") & w.rlike(MORE), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def stem(word: Column) -> Column:
    """The stem of a lower-case word."""
    steps = [_plural, _past, _last_y, lambda w: _replaced(w, SECOND), lambda w: _replaced(w, THIRD), _dropped, _last_e, _last_l]
    out = F.regexp_replace(word, "^y", "Y")  # a consonant there
    for step in steps:
        out = _let(out, step)
    return F.when((F.length(word) < 3) | (F.length(word) > 64), word).otherwise(F.regexp_replace(out, "^Y", "y"))
