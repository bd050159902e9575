"""Answer normalisers, markers and parsers as Catalyst expressions.

Functions that can reject return a struct (value, reason): reason is '' for an accepted value, and the value is null when
there is a reason. Null input gives the documented 'missing' reason.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from corpusops.functions import text as T

# Markers and number grammars of the answer formats.
HASH = "####"
SAYS = "The answer is:"
INTEGER = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)"
DECIMAL = rf"[+-]?(?:{INTEGER}(?:\.[0-9]+)?|\.[0-9]+)"
FRACTION = rf"([+-]?)({INTEGER})\s*/\s*({INTEGER})"
NUMBER = r"[-+]?(?:[0-9][0-9,]*/[0-9][0-9,]*|[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)"
PERMISSIVE_MARKER = r"(?i)####|\bthe answer is\b:?|\banswer:|\banswer is\b"


def result(value: Column, reason: Column) -> Column:
    return F.struct(F.when(reason == "", value).alias("value"), reason.alias("reason"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once; nested expressions would otherwise be copied into every mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def numeric_answer(value: Column) -> Column:
    """Decimal or fraction without thousands separators, or a reason."""
    return let(T.strip(value), _numeric)


def _numeric(v: Column) -> Column:
    fraction, decimal = v.rlike(rf"\A{FRACTION}\z"), v.rlike(rf"\A{DECIMAL}\z")
    part = lambda i: F.replace(F.regexp_extract(v, rf"\A{FRACTION}\z", i), F.lit(","), F.lit(""))
    plain = F.regexp_replace(F.replace(v, F.lit(","), F.lit("")), r"\A([+-]?)\.", "$10.")
    reason = (
        F.when(v.isNull() | (v == ""), "missing_answer")
        .when(fraction, F.when(part(3).rlike("[1-9]"), "").otherwise("zero_fraction_denominator"))
        .when(decimal, "")
        .otherwise("unsupported_answer")
    )
    return result(F.when(fraction, F.concat(part(1), part(2), F.lit("/"), part(3))).otherwise(plain), reason)


def strip_marker_line(text: Column) -> Column:
    """The text without a closing '#### ...' line, or a reason where a marker is left."""
    bare = T.strip(F.regexp_replace(T.strip(text), r"(?U)\s*####\s*[^\n]*\s*\z", ""))
    return let(bare, lambda b: result(b, F.when(b.isNull(), "missing_solution").when(F.contains(b, F.lit(HASH)), "answer_marker_in_rationale").otherwise("")))


def target(rationale: Column, gold: Column) -> Column:
    """Rationale and one closing '#### gold' line, or a reason."""

    def build(body: Column) -> Column:
        made = F.when(body["value"] == "", F.concat(F.lit(HASH + " "), gold)).otherwise(F.concat(body["value"], F.lit("\n" + HASH + " "), gold))
        reason = F.when(body["reason"] != "", body["reason"]).when(gold.isNull() | F.contains(gold, F.lit(HASH)), "invalid_target").otherwise("")
        return result(made, reason)

    return let(strip_marker_line(rationale), build)


def _after_last(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, -1)


def _before_last(text: Column, marker: str) -> Column:
    return F.left(text, F.length(text) - F.length(_after_last(text, marker)) - len(marker))


def canonical_response(text: Column, marker: str, absent: str, single_line: bool) -> Column:
    """(target, gold, reason) of a response that names its answer after the last marker."""

    def judge(part: Column) -> Column:
        answer, number, made = part["answer"], part["number"], part["made"]
        reason = F.when(text.isNull(), "missing_solution").when(~F.contains(text, F.lit(marker)), absent)
        if single_line:
            reason = reason.when(F.contains(answer, F.lit("\n")), "multiline_answer")
        reason = reason.when(number["reason"] != "", number["reason"]).otherwise(made["reason"])
        return F.struct(made["value"].alias("target"), number["value"].alias("gold"), reason.alias("reason"))

    def parts(answer: Column) -> Column:
        return let(numeric_answer(answer), lambda number: F.struct(answer.alias("answer"), number.alias("number"), target(_before_last(text, marker), number["value"]).alias("made")))

    judged = let(let(T.strip(_after_last(text, marker)), parts), judge)
    return let(judged, lambda r: F.struct(F.when(r["reason"] == "", r["target"]).alias("target"), F.when(r["reason"] == "", r["gold"]).alias("gold"), r["reason"].alias("reason")))


def strict_answer(text: Column) -> Column:
    """The number right after the last '#### ', commas removed; null unless it ends there."""
    tail = _after_last(text, HASH)
    found = F.regexp_extract(tail, rf"\A ({NUMBER})(?![0-9,./])", 1)
    return F.when(F.contains(text, F.lit(HASH)) & (found != ""), F.replace(found, F.lit(","), F.lit("")))


def permissive_answer(text: Column) -> Column:
    """The first number after the last marker of any kind, else the last number, commas removed; null without one."""
    pieces = F.split(text, PERMISSIVE_MARKER)
    marked = F.size(pieces) > 1
    first = F.regexp_extract(F.element_at(pieces, -1), NUMBER, 0)
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(-1))
    return F.replace(F.nullif(F.when(marked, first).otherwise(last), F.lit("")), F.lit(","), F.lit(""))


_PLAIN = re.compile(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]{1,3})?")


def _rational(text: str) -> Fraction | None:
    top, _, bottom = text.partition("/")
    if not _PLAIN.fullmatch(top) or (bottom and not (bottom.isascii() and bottom.isdigit() and top.lstrip("+-").isdigit())) or text.endswith("/"):
        return None
    den = Fraction(Decimal(bottom or 1))
    return Fraction(Decimal(top)) / den if den else None


@F.arrow_udf(BooleanType())
def _equal_rationals(left: pa.Array, right: pa.Array) -> pa.Array:
    """Equality of two numbers or fractions with all their digits; null where one is neither."""
    out = []
    for a, b in zip(left.to_pylist(), right.to_pylist()):
        x, y = (None if t is None else _rational(t) for t in (a, b))
        out.append(None if x is None or y is None else x == y)
    return pa.array(out, pa.bool_())


def same_number(left: Column, right: Column) -> Column:
    """Equality of two answers as exact rationals; texts that are no numbers compare as text. Null for null."""
    a, b = (F.regexp_replace(F.regexp_replace(T.strip(c), r"[$,]", ""), r"[.。,) \]}]+\z", "") for c in (left, right))
    return F.coalesce(_equal_rationals(a, b), T.strip(left) == T.strip(right))


def choice_letter(text: Column) -> Column:
    """A to D where the whole text is that letter, else null."""
    return F.upper(F.nullif(F.regexp_extract(text, r"\A\s*([A-Da-d])\s*\z", 1), F.lit("")))


def rationale_choice(text: Column, exact: bool) -> Column:
    """The letter after 'Final answer: ': its only mention, closing the text (exact), or its last one in any case."""
    if not exact:
        found = F.regexp_extract_all(text, F.lit(r"(?i)final\s+answer\s*:\s*([A-D])\b"), F.lit(1))
        return F.upper(F.try_element_at(found, F.lit(-1)))
    v = T.strip(text)
    once = (F.length(v) - F.length(F.replace(v, F.lit("Final answer:"), F.lit("")))) == len("Final answer:")
    return F.when(once, F.nullif(F.regexp_extract(v, r"(?m)^Final answer: ([A-D])\z", 1), F.lit("")))


def tex_problem(value: Column) -> Column:
    """First structural fault of a TeX answer in scan order: braces or an unescaped special; '' for none.

    An escaped character (backslash and any one character) counts for nothing.
    """
    bare = F.regexp_replace(value, r"(?s)\\.", "")
    chars = F.split(bare, "")
    state = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("depth"), F.lit("").alias("fault")),
        lambda s, c: F.struct(
            (s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
            F.when(s["fault"] != "", s["fault"])
            .when((c == "}") & (s["depth"] == 0), "unbalanced_braces")
            .when(c == "$", "unescaped_dollar")
            .when(c == "%", "unescaped_percent")
            .when(c == "#", "unescaped_hash")
            .otherwise("")
            .alias("fault"),
        ),
    )
    return F.when(value.isNull(), "missing_answer").when(state["fault"] != "", state["fault"]).when(state["depth"] != 0, "unbalanced_braces").otherwise("")
