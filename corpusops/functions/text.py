"""Text normalisers and word n-grams as Catalyst expressions.

Spark has no Unicode normalisation function, so NFC/NFKC run in an Arrow UDF. The UDF only receives rows that hold a
character outside ASCII; other rows travel as null and keep their text, which ASCII guarantees to be in both forms.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from corpusops.functions import words as W

_BETWEEN = "\x1e"
NON_ASCII = r"[^\x00-\x7F]"
# Fixed value: a word of a question key, letters and digits, one decimal part allowed.
KEY_WORD = r"[a-z0-9]+(?:\.[0-9]+)?"


def _normalizer(form: str):
    @F.arrow_udf(StringType())
    def run(text: pa.Array) -> pa.Array:
        rows = text.drop_null().to_pylist()
        whole = unicodedata.normalize(form, _BETWEEN.join(rows)).split(_BETWEEN)  # one call for a batch; the separator combines with nothing
        if len(whole) != max(len(rows), 1):  # a text holds the separator
            whole = [unicodedata.normalize(form, t) for t in rows]
        at = np.cumsum(text.is_valid().to_numpy(zero_copy_only=False)) - 1
        return pa.array(whole[: len(rows)], pa.string()).take(pa.array(at, mask=text.is_null().to_numpy(zero_copy_only=False)))

    return run


_FORMS = {form: _normalizer(form) for form in ("NFC", "NFKC", "NFD", "NFKD")}


def unicode_form(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form; null stays null."""
    foreign = text.rlike(NON_ASCII)
    return F.when(foreign, _FORMS[form](F.when(foreign, text))).otherwise(text)


def newlines(text: Column) -> Column:
    """Every line end as a single line feed."""
    return F.regexp_replace(text, "\r\n?", "\n")


def strip(text: Column) -> Column:
    """Removes white space of any script from both ends; trim() would only remove blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def collapse(text: Column) -> Column:
    """Runs of white space of any script become one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def required_text(text: Column) -> Column:
    """Line ends unified, ends stripped; null when nothing is left."""
    return F.nullif(strip(newlines(text)), F.lit(""))


def key_words(text: Column) -> Column:
    """The words of a question in compatibility-composed lower case; null for null."""
    return F.regexp_extract_all(F.lower(unicode_form(text, "NFKC")), F.lit(KEY_WORD), F.lit(0))


def question_key(text: Column) -> Column:
    """Word key of a question: its words joined by blanks; null when there is none."""
    return F.nullif(F.array_join(key_words(text), " "), F.lit(""))


def question_of(prompt: Column) -> Column:
    """The text between 'Question: ' and the line 'Answer:'; null where the prompt has another form."""
    return F.nullif(F.regexp_extract(prompt, r"(?s)Question: (.*)\nAnswer:", 1), F.lit(""))


def math_key(text: Column) -> Column:
    """NFC, white space collapsed, letter case and punctuation kept."""
    return collapse(unicode_form(text, "NFC"))


def match_text(text: Column) -> Column:
    """NFC, lower case, white space collapsed; null when empty."""
    return F.nullif(collapse(F.lower(unicode_form(required_text(text), "NFC"))), F.lit(""))


def word_ngrams(words: Column, n: int, distinct: bool = True) -> Column:
    """Word n-grams joined by blanks; an empty array for fewer than n words; null for null."""
    empty = F.array().cast("array<string>")
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))),
        lambda i: F.array_join(F.slice(words, i, n), " "),
    )
    out = F.when(words.isNull(), F.lit(None)).when(F.size(words) < n, empty).otherwise(grams)
    return F.array_distinct(out) if distinct else out


def gram_hashes(n: int):
    """A function of word keys (words joined by single blanks): 64-bit hashes of their word n-grams in order, with repeats; null for null."""

    @F.arrow_udf(ArrayType(LongType()))
    def run(keys: pa.Array) -> pa.Array:
        h, off = W.word_hashes(keys.fill_null(""))
        g, inside = W.windows(h, off, n)
        ends = np.concatenate([[0], np.cumsum(np.maximum(np.diff(off) - n + 1, 0))]).astype(np.int32)
        made = pa.ListArray.from_arrays(pa.array(ends), pa.array(g[inside].view(np.int64)))
        return pc.if_else(keys.is_valid(), made, pa.scalar(None, made.type)) if keys.null_count else made

    return run


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two sets held as arrays without repeats; 0 when either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        both / (F.size(left) + F.size(right) - both)
    )


def substring_coverage(left: Column, right: Column) -> Column:
    """Length share of the shorter text where the longer one contains it, 1 for equal texts, else 0."""
    a, b = F.length(left), F.length(right)
    inside = F.when(a <= b, F.contains(right, left)).otherwise(F.contains(left, right))
    return F.when(left == right, F.lit(1.0)).when(
        inside & (F.greatest(a, b) > 0), F.least(a, b) / F.greatest(a, b)
    ).otherwise(F.lit(0.0))
