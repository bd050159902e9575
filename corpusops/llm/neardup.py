"""Problem 4: groups of near-duplicate texts by BagMinHash signatures of their word multisets.

Method. A text is a multiset of words. Its weight axis is discretised to whole counts and cut into the intervals (0, 1],
(1, 2], (2, 4], (4, 8] and so on; every word has one Poisson process per interval, with one point a unit of weight and
signature component. A point has a time, a component and, in intervals longer than 1, the count from which it holds,
so a text takes the points of all intervals below its count and thins those of the last. The earliest point of a
component, over all words, is the same in two texts with the probability of their multiset Jaccard similarity.
Points come from a hash of word and interval, in order of time, and are read only up to the time by which nearly every
component has one; texts with open components are read on to twice that time, until none is open.

Bands of ``ROWS`` components are bucketed; pairs in a bucket whose 64-bit sketches (one bit of each of 64 components)
agree often enough are verified by their exact multiset overlap. With 7 rows and 40 bands a pair of similarity s is
missed by the bands with probability (1 - s**7)**40: 0.003 at 0.75, 0.0002 at 0.79, under 1e-6 from 0.85; by the sketch with that of
fewer than ``AGREE`` successes in 64 trials of (1 + s) / 2: 6e-4 at 0.75, 7e-5 at 0.79. Equal texts form one class before this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.llm import words as W
from corpusops.llm.overlap import near_same
from corpusops.runtime import written

ROWS, BANDS = 7, 40
#: Bits of the sketch that must agree; a pair of similarity 0.79 agrees in 57 on average, with a deviation of 2.4.
AGREE = 47
CHUNK = 2000
_BUCKET = pa.schema([("bucket", pa.int64()), ("rep", pa.int64()), ("sketch", pa.int64())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _points(seed: np.ndarray, rate: np.ndarray, span: np.ndarray, m: int, until: np.ndarray) -> tuple[np.ndarray, ...]:
    """Times, components, counts (from 1 within the interval) and number of the points of each process up to its time.

    Points are drawn by number, so a longer draw repeats the shorter one.
    """
    most = float((rate * until).max())
    n = int(most + 3 * np.sqrt(most) + 4)
    while True:
        with np.errstate(over="ignore"):
            bits = W.mix(seed[:, None] + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95))
        times = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        np.cumsum(times, axis=1, out=times)
        times /= rate[:, None]
        if (times[:, -1] > until).all():
            break
        n *= 2
    keep = times <= until[:, None]
    with np.errstate(over="ignore"):
        more = W.mix(bits[keep] + np.uint64(0x632BE59BD9B4E019))
    size = keep.sum(1)
    component = (((more >> np.uint64(40)) * np.uint64(m)) >> np.uint64(24)).astype(np.int32)
    level = np.ones(len(more), np.int32)
    if span.max() > 1:
        level += (((more & np.uint64(0xFFFFFF)) * np.repeat(span, size).astype(np.uint64)) >> np.uint64(24)).astype(np.int32)
    return times[keep].astype(np.float32), component, level, size


def signatures(keys: pa.Array, m: int) -> np.ndarray:
    """BagMinHash signatures, one row of m 32-bit values for each key; keys have at least one word."""
    h, off = W.word_hashes(keys)
    n_docs = len(keys)
    doc = np.repeat(np.arange(n_docs), np.diff(off))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    count = np.diff(np.concatenate([head, [len(h)]]))
    h, doc = h[head], doc[head]
    # one entry for each text, word and interval reached by its count; interval k > 0 covers 2**(k-1) .. 2**k
    entries, k, low = [], 0, 0
    while (has := count > low).any():
        span = 1 if k == 0 else 2 ** (k - 1)
        entries.append((doc[has], h[has], np.full(has.sum(), k), np.minimum(count[has] - low, span)))
        low, k = low + span, k + 1
    e_doc, e_word, e_k, e_take = (np.concatenate(x) for x in zip(*entries))
    with np.errstate(over="ignore"):
        process, where = np.unique(W.mix(e_word + np.uint64(0x9E37) * (e_k.astype(np.uint64) + np.uint64(1))), return_inverse=True)
    span_of = np.ones(len(process), np.int64)
    span_of[where] = np.where(e_k == 0, 1, 2 ** np.maximum(e_k - 1, 0))
    best = np.full(n_docs * m, np.inf, np.float32)
    todo = np.arange(n_docs)
    reach = (np.log(m) + 3) / np.maximum(np.bincount(doc, count, n_docs), 1)
    while len(todo):
        mine = np.zeros(n_docs, bool)
        mine[todo] = True
        sel = np.flatnonzero(mine[e_doc])
        until = np.zeros(len(process))
        np.maximum.at(until, where[sel], reach[e_doc[sel]])
        used = np.flatnonzero(until > 0)
        used = used[np.argsort(until[used] * span_of[used], kind="stable")]  # processes of like length are drawn together
        drawn = [_points(process[x], (m * span_of[x]).astype(np.float64), span_of[x], m, until[x]) for x in np.array_split(used, max(1, len(used) // 2000))]
        t, c, lv, size = (np.concatenate(x) for x in zip(*drawn))
        number = np.empty(len(process), np.int64)
        number[used] = np.arange(len(used))
        begin = np.concatenate([[0], np.cumsum(size)])
        # of each entry the points up to the reach of its text, found in one sorted axis of (process, time)
        scale = float(until.max()) * 2
        axis = t.astype(np.float64) + np.repeat(np.arange(len(used)) * scale, size)
        p = number[where[sel]]
        stop = np.maximum(np.searchsorted(axis, p * scale + reach[e_doc[sel]], "right"), begin[p])
        # single counts come first; only longer intervals are thinned
        single = int(np.searchsorted(e_k[sel], 2))
        for x, y in ((0, single), (single, len(sel))):
            take = stop[x:y] - begin[p[x:y]]
            at = W.positions_in_runs(begin[p[x:y]], stop[x:y], np.int32)
            base = np.repeat((e_doc[sel[x:y]] * m).astype(np.int32), take)
            if x:
                ok = lv[at] <= np.repeat(e_take[sel[x:y]], take)
                at, base = at[ok], base[ok]
            base += c[at]
            np.minimum.at(best, base, t[at])
        todo = todo[np.isinf(best.reshape(n_docs, m)[todo]).any(1)]
        reach[todo] *= 2
    return best.reshape(n_docs, m).view(np.uint32).astype(np.uint64)


def _bands(rows: int, bands: int):
    m = rows * bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(pc.binary_length(batch.column("key"))))  # like lengths read like times
            for begin in range(0, batch.num_rows, CHUNK):
                part = batch.slice(begin, CHUNK)
                sig = W.mix(signatures(part.column("key"), m))
                n = len(sig)
                sketch = np.zeros(n, np.uint64)
                for i in range(64):
                    sketch |= ((sig[:, (i * 7) % m] >> np.uint64(17)) & np.uint64(1)) << np.uint64(i)
                bucket = np.zeros((n, bands), np.uint64)
                with np.errstate(over="ignore"):
                    cube = sig.reshape(n, bands, rows)
                    for r in range(rows):
                        bucket += cube[:, :, r] * W.WINDOW[r]
                    bucket = W.mix(bucket + np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xA0761D6478BD642F))
                rep = np.repeat(part.column("rep").to_numpy(zero_copy_only=False), bands)
                yield pa.record_batch([pa.array(bucket.reshape(-1).view(np.int64)), pa.array(rep), pa.array(np.repeat(sketch, bands).view(np.int64))], schema=_BUCKET)

    return run


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the buckets of a partition whose sketches agree; each pair once per partition."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    bucket, rep, sketch = (t.column(c).to_numpy() for c in ("bucket", "rep", "sketch"))
    del t, got
    order = np.argsort(bucket, kind="stable")
    bucket, rep, sketch = bucket[order], rep[order], sketch[order].view(np.uint64)
    start, end = W.runs(bucket)
    many = end - start > 1
    # every member of a bucket with those after it: as many rows as pairs, made in blocks
    at = W.positions_in_runs(start[many], end[many])
    stop = np.repeat(end[many], end[many] - start[many])
    later = stop - at - 1
    keep = later > 0
    at, stop, later = at[keep], stop[keep], later[keep]
    block = np.cumsum(later) // 4_000_000
    for b in np.unique(block):
        mine = block == b
        i = np.repeat(at[mine], later[mine])
        j = W.positions_in_runs(at[mine] + 1, stop[mine])
        same = np.bitwise_count(sketch[i] ^ sketch[j]) <= 64 - AGREE
        x, y = rep[i[same]], rep[j[same]]
        a, c = np.minimum(x, y), np.maximum(x, y)
        pair = np.unique(np.rec.fromarrays([a, c])) if len(a) else None
        if pair is not None:
            pair = pair[pair["f0"] != pair["f1"]]
            yield pa.record_batch([pa.array(np.ascontiguousarray(pair["f0"])), pa.array(np.ascontiguousarray(pair["f1"]))], schema=_PAIR)


def text_classes(df: DataFrame, id_col: str, key_col: str) -> tuple[DataFrame, DataFrame]:
    """(texts(rep, key), members(rep, id)): rows with equal keys are one text, named by their least id.

    Rows without an id, and rows whose key is null or blank, take no part. An id that occurs twice keeps both rows.
    """
    rows = written(
        df.select(F.col(id_col).cast("bigint").alias("id"), F.trim(F.col(key_col)).alias("key"))
        .where(F.col("id").isNotNull() & (F.col("key") != ""))
        .withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit(7), "key")})
    )
    texts = written(rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("key").alias("key")))
    members = rows.select("id", "h1", "h2").join(texts.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "id")
    return texts.select("rep", "key"), members


def near_duplicate_links(texts: DataFrame, threshold: float = 0.75, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Links (a, b, similarity) with a < b between different texts(rep:bigint, key:string) of at least the threshold.

    ``rows`` and ``bands`` set the recall (see the module); the threshold is exact. Empty input gives no links.
    """
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = texts.select("rep", "key").mapInArrow(_bands(rows, bands), "bucket bigint, rep bigint, sketch bigint")
    pairs = buckets.repartition(parts, "bucket").mapInArrow(_bucket_pairs, "a bigint, b bigint").distinct()
    return (
        pairs.join(texts.select(F.col("rep").alias("a"), F.col("key").alias("ka")), "a")
        .join(texts.select(F.col("rep").alias("b"), F.col("key").alias("kb")), "b")
        .withColumn("similarity", near_same("ka", "kb"))
        .where(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
    )


def near_duplicate_pairs(df: DataFrame, id_col: str, key_col: str, threshold: float = 0.75) -> DataFrame:
    """All (id_a, id_b), id_a < id_b, of different rows whose word keys are near-same or equal."""
    texts, members = text_classes(df, id_col, key_col)
    links = near_duplicate_links(texts, threshold).select("a", "b")
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    near = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    repeated = members.groupBy("rep").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.col("rep").alias("a"))
    again = left.join(repeated, "a")
    same = again.join(right, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return near.unionByName(same)


def near_duplicate_groups(df: DataFrame, id_col: str, key_col: str, threshold: float = 0.75) -> DataFrame:
    """One row for each document with a key: (id, group_id, group_size, links).

    ``group_id`` is the least id connected to it by near-same texts, ``links`` the number of different texts near-same to
    its own. Documents without a key have none and do not appear.
    """
    from corpusops.operators.graph import connected_components

    texts, members = text_classes(df, id_col, key_col)
    links = written(near_duplicate_links(texts, threshold).select("a", "b"))
    component = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    by_rep = texts.select("rep").join(component.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    out = members.join(by_rep, "rep").select(
        "id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")
    )
    sizes = out.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return out.join(sizes, "group_id").select("id", "group_id", "group_size", "links")
