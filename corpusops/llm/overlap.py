"""Problem 1: records shared, exactly or almost, between a training split and evaluation splits.

Method. A suffix array over the texts as they stand finds shared spans, but near-same texts are to be found whatever the order of their
words, and reordered ones need not share any long span. So the pairs come from a set-similarity join in its place, and the suffix
array then shows on the linked texts which spans they share.

The join is exact. The elements of a text are its words numbered by their repeats; all texts order them alike, rare ones
first. With d(a, b) = (1 - s) / (1 + s) * (a + b), two texts of a and b elements and at least the similarity s differ in
d(a, b) elements at most. So they share an element, and the first one that they share has at most d(a, b) elements before it in both
texts together; and the two lengths differ by the factor s at most. Therefore only the first (1 - s) * n + 1 elements of
each text are emitted, to the partition of the element and the length class; there the held-out texts meet the training
texts within that bound of positions, which one sort by position less the text's part of d gives. What is left is
thinned by a sketch of ``SKETCH`` parities, which differ in d(a, b) bits at most, and verified by the exact multiset
similarity. No step leaves out a pair of the similarity asked.

Spans. The two texts of every link are concatenated and a suffix array over a batch of them, in which the links keep apart,
is built by prefix doubling. The nearest suffixes of the other side before and after a suffix have its longest common
prefixes; those of ``SPAN`` words or more are shared spans, and their union over all links of a record is its coverage.

How often a word occurs is read from a hash sample of the texts, for the words that are more than 1 / ``RANKED`` of it; this
decides on the order of the elements, thus on the work, and never on the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusops.functions import text as T
from corpusops.llm import words as W
from corpusops.runtime import written

SKETCH = 128
BLOCK_PAIRS = 1_000_000
SAMPLE_ONE_IN = 8
#: Words are ranked by frequency down to this part of all words, so these are fewer than RANKED words.
RANKED = 262_144
TRAIN, HELD_OUT = 1, 2
#: Least words of a shared span, and links of which one suffix array is built.
SPAN, LINKS_A_TIME = 5, 2_000
#: Roundings of floats must not lose a pair that lies on a bound.
SLACK = 1e-6

_ELEMENT = pa.schema([("route", pa.int64()), ("rep", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64()), ("place", pa.int64())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _class_starts() -> np.ndarray:
    """Least lengths of the length classes, each a third longer than the one before."""
    out = [1]
    while out[-1] < 2**31:
        out.append(max(out[-1] + 1, out[-1] * 4 // 3))
    return np.array(out)


_STARTS = _class_starts()


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(_STARTS, n, "right")


def _elements(keys: pa.Array, ranked: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of every element: its text, hash and position in the common order; the length of every text and its sketch."""
    h, off = W.word_hashes(keys)
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    h = h[np.lexsort((h, doc))]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    start, end = W.runs(np.cumsum(new))
    repeat = np.arange(len(h)) - np.repeat(start, end - start) + 1
    element = W.mix(h + repeat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    often = np.zeros(len(h), np.int64)
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
        often = np.where(ranked[at] == h, counts[at], 0) // repeat**2
    element = element[np.lexsort((element, often, doc))]
    odd = np.bincount(doc * SKETCH + (element >> np.uint64(57)).astype(np.int64), minlength=len(n) * SKETCH) & 1
    sketch = np.packbits(odd.astype(np.uint8).reshape(len(n), SKETCH), axis=1).view(np.int64)
    return doc, element, np.arange(len(h)) - np.repeat(off[:-1], n), n, sketch


def _emit(ranked: np.ndarray, counts: np.ndarray, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, element, place, n, sketch = _elements(batch.column("key"), ranked, counts)
            kept = place < n[doc] - np.ceil(threshold * n[doc] - SLACK) + 1
            doc, element, place = doc[kept], element[kept], place[kept]
            rep, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "side"))
            own = _length_class(n)
            least, most = _length_class(np.ceil(threshold * n - SLACK)), _length_class(np.floor(n / threshold + SLACK))
            # a training text goes to its own length class, a held-out one to all that its partners may have
            for held, first, last in ((0, own, own), (1, least, most)):
                of = np.flatnonzero((side[doc] & (HELD_OUT if held else TRAIN)) > 0)
                classes = W.positions_in_runs(first[doc[of]], last[doc[of]] + 1)
                of = np.repeat(of, (last - first + 1)[doc[of]])
                d = doc[of]
                route = W.mix(element[of] + classes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
                packed = place[of] << 33 | n[d] << 1 | held
                yield pa.record_batch([pa.array(route.view(np.int64)), pa.array(rep[d]), pa.array(sketch[d, 0]), pa.array(sketch[d, 1]), pa.array(packed)], schema=_ELEMENT)

    return run


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            word, n = np.unique(W.word_hashes(batch.column("key"))[0], return_counts=True)
            yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])


def _candidates(threshold: float):
    part = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a held-out and a training text of a partition that no bound excludes."""
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        route, rep, s0, s1, packed = (t.column(c).to_numpy() for c in ("route", "rep", "s0", "s1", "place"))
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)  # bits of negative numbers are counted otherwise
        del t, got
        held, n = packed & 1, packed >> 1 & 0xFFFFFFFF
        rest = (packed >> 33) - part * n  # of two texts that share an element first: not above 0 in sum
        order = np.lexsort((held, np.where(held, SLACK - rest, rest), route))
        route, rep, s0, s1, n, held = (x[order] for x in (route, rep, s0, s1, n, held > 0))
        # a held-out text meets the training texts before it in its run
        before = np.concatenate([[0], np.cumsum(~held)])
        start, end = W.runs(route)
        first, last = np.repeat(before[start], end - start)[held], before[:-1][held]
        x, y = np.flatnonzero(held)[last > first], np.flatnonzero(~held)
        first, last = first[last > first], last[last > first]
        block = np.cumsum(last - first) // BLOCK_PAIRS
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(x)]]) if len(x) else []
        ny, r0, r1, rep_y = n[y], s0[y], s1[y], rep[y]
        for s, e in zip(cuts[:-1], cuts[1:]):
            i = np.repeat(x[s:e], last[s:e] - first[s:e])
            j = W.positions_in_runs(first[s:e], last[s:e])
            most = part * (n[i] + ny[j]) + SLACK
            near = np.bitwise_count(s0[i] ^ r0[j]) <= most
            i, j, most = i[near], j[near], most[near]
            near = np.bitwise_count(s0[i] ^ r0[j]) + np.bitwise_count(s1[i] ^ r1[j]) <= most
            near &= (np.minimum(n[i], ny[j]) >= threshold * np.maximum(n[i], ny[j]) - SLACK) & (rep[i] != rep_y[j])
            yield pa.record_batch([pa.array(rep[i[near]]), pa.array(rep_y[j[near]])], schema=_PAIR)

    return run


@F.arrow_udf(DoubleType())
def near_same(left: pa.Array, right: pa.Array) -> pa.Array:
    """Shared words over all words of two keys, counted with repeats."""
    shared, a, b = W.multiset_overlap(left, right)
    return pa.array(shared / np.maximum(a + b - shared, 1))


def keyed_rows(df: DataFrame, id_col: str, split_col: str, prompt_col: str, train: str = "train") -> DataFrame:
    """(id, side, key): rows with an id, a split and a question; every split but the training one counts as held out."""
    return df.select(
        F.col(id_col).alias("id"),
        F.when(F.col(split_col) == train, TRAIN).otherwise(HELD_OUT).alias("side"),
        T.question_key(T.question_of(F.col(prompt_col))).alias("key"),
    ).where(F.col("id").isNotNull() & F.col("key").isNotNull() & df[split_col].isNotNull())


def suffix_array(symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffixes in order, ranks by prefixes of 1, 2, 4, ... symbols) of concatenated texts; ``end`` is where a symbol's text ends."""
    rank = np.unique(symbols, return_inverse=True)[1] + 1
    ranks, width, longest = [rank], 1, int((end - np.arange(len(end))).max(initial=0))
    while width < longest:
        after = np.arange(len(rank)) + width
        second = np.where(after < end, rank[np.minimum(after, len(rank) - 1)], 0)
        rank = np.unique(rank * np.int64(len(rank) + 2) + second, return_inverse=True)[1] + 1
        ranks.append(rank)
        width *= 2
    return np.argsort(rank, kind="stable"), ranks


def common_prefix(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes i and j, read off the ranks from the widest down."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = i + out, j + out
        inside = (x < end[i]) & (y < end[j])
        same = inside & (ranks[k][np.minimum(x, len(end) - 1)] == ranks[k][np.minimum(y, len(end) - 1)])
        out[same] += 1 << k
    return np.minimum(out, np.minimum(end[i] - i, end[j] - j))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, side, begin, stop) of the spans that the texts of a link share, for both of its texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, LINKS_A_TIME):
            part = batch.slice(at, LINKS_A_TIME)
            n = part.num_rows
            both = [W.word_hashes(part.column(c)) for c in ("ka", "kb")]
            size = np.stack([np.diff(off) for _, off in both], 1).reshape(-1)  # texts a and b of each link in turn
            begin = np.concatenate([[0], np.cumsum(size)])
            text = np.repeat(np.arange(2 * n), size)
            h = np.empty(begin[-1], np.uint64)
            for side, (words, _) in enumerate(both):
                h[text % 2 == side] = words
            with np.errstate(over="ignore"):
                symbols = W.mix(h + (text // 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))  # links keep apart
            end = begin[text + 1]
            order, ranks = suffix_array(symbols, end)
            side = text[order] % 2
            best = np.zeros(len(h), np.int64)
            for turn in (1, -1):  # the nearest suffix of the other side before, then after
                o, sd = order[::turn], side[::turn]
                place = np.arange(len(o))
                near = [np.maximum.accumulate(np.where(sd == k, place, -1)) for k in (0, 1)]
                other = np.where(sd == 0, near[1], near[0])
                has = other >= 0
                i, j = o[has], o[other[has]]
                best[i] = np.maximum(best[i], common_prefix(ranks, i, j, end))
            starts = np.concatenate([[True], best[1:] >= best[:-1]]) if len(best) else np.zeros(0, bool)
            starts[begin[:-1][size > 0]] = True
            at_ = np.flatnonzero((best >= SPAN) & starts)
            rep = np.stack([part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")], 1).reshape(-1)[text[at_]]
            first = at_ - begin[text[at_]]
            yield pa.record_batch(
                [pa.array(rep), pa.array(np.where(text[at_] % 2 == 0, HELD_OUT, TRAIN)), pa.array(first), pa.array(first + best[at_])], ["rep", "side", "begin", "stop"]
            )


def cross_split_links(rows: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Links between distinct texts, and the membership of rows in them.

    ``rows`` has id:bigint, side (1 training, 2 held out) and key (words joined by blanks, none null).
    Returns (links, members): links(a, b, similarity, ka, kb) with a held-out text a and a training text b, both
    named by the least id of their rows, each pair once, without pairs of a text with itself; members(rep, id, side).
    Exact copies are one text, so a group of copies of any size costs one element set. Empty input gives empty tables.
    """
    spark = rows.sparkSession
    digest = [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")]
    rows = written(rows.select("id", "side", "key", *digest))
    texts = written(
        rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.bit_or("side").cast("bigint").alias("side"), F.first("key").alias("key"))
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sample = texts.where(F.pmod("h1", F.lit(SAMPLE_ONE_IN)) == 0).select("key").mapInArrow(_sample_words, "word bigint, n bigint")
    all_words = sample.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = sample.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(all_words / RANKED)).collect()
    ranked, counts = np.array([r.word for r in frequent], np.int64).view(np.uint64), np.array([r.n for r in frequent], np.int64)
    order = np.argsort(ranked)

    elements = texts.select("rep", "side", "key").mapInArrow(_emit(ranked[order], counts[order], threshold), "route bigint, rep bigint, s0 bigint, s1 bigint, place bigint")
    pairs = elements.repartition(parts, "route").mapInArrow(_candidates(threshold), "a bigint, b bigint").distinct()
    left = texts.select(F.col("rep").alias("a"), F.col("key").alias("ka"))
    right = texts.select(F.col("rep").alias("b"), F.col("key").alias("kb"))
    links = (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("similarity", near_same("ka", "kb"))
        .where(F.col("similarity") >= threshold)
        .select("a", "b", "similarity", "ka", "kb")
    )
    members = rows.select("id", "side", "h1", "h2").join(texts.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "id", "side")
    return links, members


def cross_split_pairs(rows: DataFrame, threshold: float = 0.75) -> DataFrame:
    """All (id_a, id_b), id_a < id_b, of a training and a held-out row with near-same or equal texts."""
    links, members = cross_split_links(rows, threshold)
    held = members.where(F.col("side") == HELD_OUT).select(F.col("rep").alias("a"), F.col("id").alias("x"))
    train = members.where(F.col("side") == TRAIN).select(F.col("rep").alias("b"), F.col("id").alias("y"))
    near = links.select("a", "b").join(held, "a").join(train, "b").select("x", "y")
    twice = members.groupBy("rep").agg(F.bit_or("side").alias("side")).where(F.col("side") == (TRAIN | HELD_OUT)).select(F.col("rep").alias("a"))
    same = held.join(twice, "a").join(train, F.col("a") == F.col("b")).select("x", "y")
    return near.unionByName(same).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def record_overlap(rows: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row for each record of ``rows`` (see cross_split_links): (id, text_id, copied, links, pairs, coverage).

    ``text_id`` names its class of copies, ``copied`` tells whether the same text stands on the other side, ``links`` counts the different texts
    there that are near-same, ``pairs`` the records behind both. ``coverage`` is the share of its words in spans of
    ``SPAN`` words or more that it shares with a linked text, 1 for a copied one and 0 without a link.
    """
    links, members = cross_split_links(rows, threshold)
    links = written(links)
    sizes = written(members.groupBy("rep").agg(F.count_if(F.col("side") == TRAIN).alias("in_train"), F.count_if(F.col("side") == HELD_OUT).alias("in_held")))
    other = sizes.select(F.col("rep").alias("other"), "in_train", "in_held")
    ends = links.select(F.explode(F.array(*(
        F.struct(F.col(x).alias("rep"), F.lit(side).alias("side"), F.col(y).alias("other"), F.size(F.split(f"k{x}", " ")).alias("words")) for x, side, y in (("a", HELD_OUT, "b"), ("b", TRAIN, "a"))
    ))).alias("e")).select("e.*")
    facing = F.when(F.col("side") == HELD_OUT, F.col("in_train")).otherwise(F.col("in_held"))
    linked = ends.join(other, "other").groupBy("rep", "side").agg(F.count("*").alias("links"), F.sum(facing).alias("near"), F.first("words").alias("words"))
    # a record has at most as many different spans as places in its text, whatever the number of its links
    spans = links.select("a", "b", "ka", "kb").mapInArrow(_spans, "rep bigint, side bigint, begin bigint, stop bigint").distinct()
    before = F.max("stop").over(Window.partitionBy("rep", "side").orderBy("begin", "stop").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("from", F.greatest("begin", F.coalesce(before, F.lit(0)))).groupBy("rep", "side").agg(F.sum(F.greatest(F.col("stop") - F.col("from"), F.lit(0))).alias("covered"))
    own = members.join(sizes, "rep").join(linked.join(covered, ["rep", "side"], "left"), ["rep", "side"], "left")
    copies = F.when(F.col("side") == HELD_OUT, F.col("in_train")).otherwise(F.col("in_held"))
    share = F.when(copies > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("covered") / F.col("words"), F.lit(0.0)))
    return own.select(
        "id", F.col("rep").alias("text_id"), (copies > 0).alias("copied"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), (copies + F.coalesce("near", F.lit(0))).cast("bigint").alias("pairs"), F.round(share, 6).alias("coverage")
    )


def overlap_report(df: DataFrame, records: DataFrame, id_col: str, split_col: str, source_col: str) -> DataFrame:
    """Rows per split and source, those with a partner across splits, the pairs they take part in and their mean coverage.

    Sources are compared in trimmed lower case; a null source is reported as null.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), F.lower(T.strip(F.col(source_col))).alias("source"))
    return (
        base.join(records.select("id", "pairs", "coverage").where("pairs > 0"), "id", "left")
        .groupBy("split", "source")
        .agg(
            F.count("*").alias("rows"),
            F.count("pairs").alias("overlapping_rows"),
            F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("pairs"),
            F.round(F.avg("coverage"), 6).alias("mean_coverage"),
        )
        .withColumn("overlapping_share", F.round(F.col("overlapping_rows") / F.col("rows"), 6))
    )
