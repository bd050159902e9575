"""Registered queries of the core operators and their DuckDB counterparts."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from corpusops.runtime import table

def nfkc_sql(text: str) -> str:
    """DuckDB expression for the NFKC of a text whose compatibility forms stand for one character, a ligature or a fraction."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0x1F000) if unicodedata.decomposition(chr(c)).startswith("<")]
    single = [(a, b) for a, b in pairs if len(b) == 1 and b != "'"]
    for wide in "ﬀﬁﬂﬃﬄ½¼¾":
        text = f"replace({text}, '{wide}', '{unicodedata.normalize('NFKC', wide)}')"
    return f"nfc_normalize(translate({text}, '{''.join(a for a, _ in single)}', '{''.join(b for _, b in single)}'))"


QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers fn(spark, t) under its name; ``t(name)`` loads a table of the run."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(spark, lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


from corpusops.plans import arrays, benchmarks, corpus, evaluation, lifecycle, texts  # noqa: E402, F401  (they register on import)
