"""Problem 6: evaluation texts inside training texts, found by Wu-Manber multi-pattern search.

Method. Texts are read as words, runs of letters and digits in their consistent form (see forms), compatibility forms and lower case. The
patterns are all windows of ``WINDOW`` words of the evaluation texts, so every occurrence of that many consecutive
words is one of some pattern. The words are the symbols of the search: a shift table, indexed by the hash of a block of
``BLOCK`` words, tells how far a window can move on; where it is 0, a prefix table tells whether the first block starts some
pattern, and a third table whether the whole window may be one. A batch of texts is one array of words cut
into lanes of equal length, and all lanes take their next step together. Texts are separated by a word of no pattern.

Documents are read once, whatever the number of patterns: only the three tables, whose size is bounded by ``MOST_BITS``, go to
the executors. The buckets of patterns stay a table of the cluster; windows that pass the tables are sent to their bucket by
their hash and compared there, by two independent 64-bit hashes of all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.llm import forms
from corpusops.llm import words as W
from corpusops.runtime import written

WINDOW = 20
BLOCK = 3
LANE = 192
#: Slots of a table as a power of two: four for each block of the patterns, within these bounds.
LEAST_BITS, MOST_BITS = 16, 24
CHUNK = 1 << 16
SHIFT, PREFIX, WHOLE = range(3)


def word_stream(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, n+1 offsets) of pieces of an array of texts without nulls."""
    for begin, _, raw, off in forms.pieces(texts):
        cps, coff = forms.fold_all(raw, off)
        yield begin, *words_of(cps, coff)[:2]


def words_of(cps: np.ndarray, coff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (never 0), n+1 offsets of the texts into them, and where each word starts and ends."""
    t = forms.tables()
    at = np.flatnonzero(t.alnum[cps])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(coff), np.int64), at, at
    row_start = np.zeros(len(cps) + 1, bool)
    row_start[coff] = True
    head = np.ones(len(at), bool)
    head[1:] = (at[1:] != at[:-1] + 1) | row_start[at[1:]]
    starts = np.flatnonzero(head)
    ends = np.concatenate([starts[1:], [len(at)]])
    with np.errstate(over="ignore"):
        symbols = t.lower[cps[at]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(0xD6E8FEB86659FD93)
    return W.span_hashes(symbols, starts, ends) | np.uint64(1), np.searchsorted(at[starts], coff), at[starts], at[ends - 1] + 1


def block_hash(words) -> np.ndarray:
    """Hash of blocks given as one array for each of their words."""
    with np.errstate(over="ignore"):
        return W.mix(sum((words[k] * W.WINDOW[k] for k in range(1, len(words))), words[0] * W.WINDOW[0]))


def window_hashes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of windows given as rows of words."""
    n, out = words.shape[1], []
    for salt in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)):
        with np.errstate(over="ignore"):
            factor = W.mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) | np.uint64(1)
            out.append(W.mix(((words ^ salt) * factor).sum(1, dtype=np.uint64)))
    return out[0], out[1]


def _item_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(items, windows of words) of the evaluation texts."""
    for batch in batches:
        item = batch.column("item").to_numpy(zero_copy_only=False)
        for begin, h, off in word_stream(batch.column("q")):
            n = np.maximum(np.diff(off) - window + 1, 0)
            if n.any():
                start = W.positions_in_runs(off[:-1], off[:-1] + n)
                yield np.repeat(item[begin : begin + len(n)], n), h[start[:, None] + np.arange(window)[None, :]]


def _patterns(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for item, words in _item_windows(batches, window):
            one, two = window_hashes(words)
            yield pa.record_batch([pa.array(item), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["item", "h1", "h2"])

    return run


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _partial_tables(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = window - BLOCK + 1
        tables = np.full((3, 1 << bits), most, np.uint8)
        for _, words in _item_windows(batches, window):
            for j in range(most):
                np.minimum.at(tables[SHIFT], _slots(block_hash(words[:, j : j + BLOCK].T), bits), np.uint8(most - 1 - j))
            tables[PREFIX, _slots(block_hash(words[:, :BLOCK].T), bits)] = 0
            tables[WHOLE, _slots(window_hashes(words)[0], bits)] = 0
        chunks = tables.reshape(-1, CHUNK)
        used = np.flatnonzero((chunks < most).any(1))
        yield pa.record_batch([pa.array(used), pa.array([chunks[k].tobytes() for k in used], pa.binary())], ["chunk", "cells"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least of each cell over the parts of a chunk."""
    whole: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells")):
            part = np.frombuffer(cells.as_buffer(), np.uint8)
            whole[chunk] = np.minimum(whole[chunk], part) if chunk in whole else part
    if whole:
        yield pa.record_batch([pa.array(list(whole), pa.int64()), pa.array([x.tobytes() for x in whole.values()], pa.binary())], ["chunk", "cells"])


def scan(tables: np.ndarray, h: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, two hashes) of the windows of texts that pass the tables."""
    n, bits = np.diff(off), int(tables.shape[1]).bit_length() - 1
    none = np.zeros(0, np.int64)
    if not (n >= window).any():
        return none, none.view(np.uint64), none.view(np.uint64)
    gap = np.arange(len(n))
    stream = np.zeros(len(h) + len(n) + window, np.uint64)  # 0 is the hash of no word
    stream[np.arange(len(h)) + np.repeat(gap, n)] = h
    begin, stop_all = off[:-1] + gap, len(stream) - window
    pos = np.arange(0, stop_all, LANE)
    stop = np.minimum(pos + LANE, stop_all)
    hits = [none]
    while len(pos):
        end = pos + window
        step = tables[SHIFT, _slots(block_hash([stream[end - BLOCK + k] for k in range(BLOCK)]), bits)]
        hit = pos[step == 0]
        if len(hit):
            hits.append(hit[tables[PREFIX, _slots(block_hash([stream[hit + k] for k in range(BLOCK)]), bits)] == 0])
        pos = pos + np.maximum(step, 1)
        live = pos < stop
        pos, stop = pos[live], stop[live]
    at = np.concatenate(hits)
    one, two = window_hashes(stream[at[:, None] + np.arange(window)[None, :]])
    may = tables[WHOLE, _slots(one, bits)] == 0
    return np.searchsorted(begin, at[may], "right") - 1, one[may], two[may]


def _search(tables: np.ndarray, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("t")
            for begin, h, off in word_stream(texts):
                text, one, two = scan(tables, h, off, window)
                if len(text):
                    yield pa.record_batch([ids.take(pa.array(begin + text)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["id", "h1", "h2"])

    return run


def leaked_items(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, question_col: str, window: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """(id, item): documents that hold at least ``window`` consecutive words of an item's text, each pair once.

    Items with fewer words cannot occur. Null ids and texts take no part; a document id that occurs twice is one
    document. Ids are bigint. ``most_bits`` bounds the tables, thus the work that they save, and never the result.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(question_col).alias("q")).where("item is not null and q is not null")
    patterns = written(asked.mapInArrow(_patterns(window), "item bigint, h1 bigint, h2 bigint").distinct())
    n = patterns.count()
    bits = min(max(int(4 * n * (window - BLOCK + 1)).bit_length(), LEAST_BITS), max(most_bits, LEAST_BITS))
    parts = asked.mapInArrow(_partial_tables(window, bits), "chunk bigint, cells binary").repartition("chunk").mapInArrow(_merged, "chunk bigint, cells binary")
    tables = np.full((3, 1 << bits), window - BLOCK + 1, np.uint8)
    for r in parts.collect():  # three tables of at most 2**most_bits cells
        tables.reshape(-1, CHUNK)[r.chunk] = np.frombuffer(r.cells, np.uint8)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null and t <> ''")
    passed = rows.mapInArrow(_search(tables, window), "id bigint, h1 bigint, h2 bigint")
    return passed.join(patterns, ["h1", "h2"]).select("id", "item").distinct()


def leak_report(found: DataFrame, items: DataFrame, item_col: str, suite_col: str) -> DataFrame:
    """Items per suite, those found in some document, and the documents that hold one of the suite's items."""
    asked = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(suite_col).alias("suite"))
    return (
        asked.join(found, "item", "left")
        .groupBy("suite")
        .agg(
            F.countDistinct("item").alias("items"),
            F.countDistinct(F.when(F.col("id").isNotNull(), F.col("item"))).alias("leaked_items"),
            F.countDistinct("id").alias("documents"),
        )
    )
