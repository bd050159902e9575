"""The suffix rules of Porter's published algorithm (1980) as tables, applied to the distinct words of a batch."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_C, _V = "[^aeiou](?:[^aeiouy]*)", "[aeiouy][aeiou]*"
_ONE = re.compile(rf"^(?:{_C})?{_V}{_C}")
_TWO = re.compile(rf"^(?:{_C})?{_V}{_C}{_V}{_C}")
_JUST_ONE = re.compile(rf"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_HAS_VOWEL = re.compile(rf"^(?:{_C})?[aeiouy]")
_SHORT = re.compile(r"^(?:.*[^aeiou])?[^aeiou][aeiouy][^aeiouwxy]$")
# The suffixes of steps 2 to 4 of the publication and what takes their place.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _longest(pairs: str) -> list[tuple[str, str]]:
    return sorted((tuple(x.split(":")) for x in pairs.split()), key=lambda x: -len(x[0]))


_RULES = (_longest(_STEP2), _longest(_STEP3))
_LAST = sorted(_STEP4.split(), key=len, reverse=True)


@lru_cache(maxsize=65536)
def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to three letters stay."""
    if len(word) <= 3 or not word.isalpha():
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _ONE.match(w[:-3]) else w
    elif w.endswith("ed") and _HAS_VOWEL.match(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _HAS_VOWEL.match(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            cut += "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and cut[-1] not in "aeioulsz":
            cut = cut[:-1]
        elif _JUST_ONE.match(cut) and _SHORT.match(cut):
            cut += "e"
        w = cut
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    for rules in _RULES:
        for suffix, instead in rules:
            if w.endswith(suffix):
                if _ONE.match(w[: -len(suffix)]):
                    w = w[: -len(suffix)] + instead
                break
    for suffix in _LAST:
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _TWO.match(base) and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _TWO.match(base) or (_ONE.match(base) and not (_JUST_ONE.match(base) and _SHORT.match(base))):
            w = base
    return w[:-1] if w.endswith("ll") and _TWO.match(w[:-1]) else w


@F.arrow_udf(ArrayType(StringType()))
def stems(words: pa.Array) -> pa.Array:
    """Word arrays with every word stemmed; each distinct word of a batch once."""
    flat = words.flatten().dictionary_encode()
    made = pa.array([stem(w) if w is not None else None for w in flat.dictionary.to_pylist()], pa.string()).take(flat.indices)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_pylist()
    offsets, at = [], 0
    for n in sizes:
        offsets.append(at)
        at += n
    out = pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), made)
    return pc.if_else(words.is_valid(), out, pa.scalar(None, out.type)) if words.null_count else out
