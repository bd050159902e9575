"""Evaluation statistics: accuracies, pass@k, text overlap, entropy and length summaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def pass_at_1(df: DataFrame, groups: list[str], seed: str, correct: str) -> DataFrame:
    """Mean and sample deviation over seeds of the percentage correct; the deviation is null for one seed."""
    by_seed = df.groupBy(*groups, seed).agg((100 * F.avg(F.coalesce(F.col(correct), F.lit(False)).cast("int"))).alias("p"))
    return by_seed.groupBy(*groups).agg(F.count("*").alias("seeds"), F.avg("p").alias("pass_at_1"), F.stddev_samp("p").alias("sd"))


def subset_pass_at_k(df: DataFrame, groups: list[str], question: str, correct: str) -> DataFrame:
    """Unbiased pass@k in percent for k = 1..n, averaged over questions: 1 - C(n-c, k) / C(n, k), as a running product."""
    per = df.groupBy(*groups, question).agg(F.count("*").cast("int").alias("n"), F.count_if(F.coalesce(F.col(correct), F.lit(False))).cast("int").alias("c"))
    every = per.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    miss = F.when(F.col("k") > F.col("n") - F.col("c"), 0.0).when(F.col("c") == 0, 1.0).otherwise(
        F.aggregate(F.sequence(F.col("n") - F.col("c") + 1, F.col("n")), F.lit(1.0), lambda a, i: a * (1 - F.col("k") / i))
    )
    return every.groupBy(*groups, "k").agg((100 * F.avg(1 - miss)).alias("pass_at_k"), F.count("*").alias("questions"))


def ngram_counts(df: DataFrame, key: str, words: str, n: int) -> DataFrame:
    w = F.col(words)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return df.where(F.size(w) >= n).select(key, F.explode(grams).alias("g")).groupBy(key, "g").agg(F.count("*").alias("m"))


def corpus_bleu(df: DataFrame, key: str, hypothesis: str, reference: str) -> DataFrame:
    """One row (bleu, brevity): clipped 1- to 4-gram precision of word arrays, orders without n-grams left out, 0 without a match."""
    lengths = df.agg(F.sum(F.size(hypothesis)).alias("h"), F.sum(F.size(reference)).alias("r"))
    parts = []
    for n in range(1, 5):
        h, r = ngram_counts(df, key, hypothesis, n), ngram_counts(df, key, reference, n).withColumnRenamed("m", "cap")
        parts.append(h.join(r, [key, "g"], "left").agg(F.sum(F.least("m", F.coalesce("cap", F.lit(0)))).alias("hit"), F.sum("m").alias("all")).withColumn("n", F.lit(n)))
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.unionByName(p)
    mean = stats.where(F.col("all") > 0).agg(F.avg(F.log(F.when(F.col("hit") > 0, F.col("hit") / F.col("all")))).alias("l"), F.min("hit").alias("least"))
    brevity = F.when(F.col("h") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("h")))
    return mean.crossJoin(lengths).select(F.when(F.col("least") > 0, 100 * brevity * F.exp("l")).otherwise(0.0).alias("bleu"), brevity.alias("brevity"))  # one row by one row


def rouge_n(df: DataFrame, key: str, hypothesis: str, reference: str, n: int) -> DataFrame:
    """(key, f1) in percent of word n-grams; 0 where a side has none."""
    h, r = ngram_counts(df, key, hypothesis, n), ngram_counts(df, key, reference, n).withColumnRenamed("m", "cap")
    hit = h.join(r, [key, "g"]).groupBy(key).agg(F.sum(F.least("m", "cap")).alias("hit"))
    nh, nr = (F.greatest(F.size(c) - (n - 1), F.lit(0)) for c in (hypothesis, reference))
    return df.join(hit, key, "left").select(key, F.when(nh + nr > 0, 200.0 * F.coalesce("hit", F.lit(0)) / (nh + nr)).otherwise(0.0).alias("f1"))


@F.arrow_udf(DoubleType())
def rouge_l(left: pa.Array, right: pa.Array) -> pa.Array:
    """F1 in percent of the longest common subsequence of two word arrays."""
    out = []
    for a, b in zip(left.to_pylist(), right.to_pylist()):
        if not a or not b:
            out.append(None if a is None or b is None else 0.0)
            continue
        bits: dict[str, int] = {}  # bit-parallel rows: one big integer for each word of a
        for i, x in enumerate(a):
            bits[x] = bits.get(x, 0) | 1 << i
        row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
        for y in b:
            m = row & bits.get(y, 0)
            row = (row + m | row - m) & full
        n = len(a) - row.bit_count()
        out.append(200.0 * n / (len(a) + len(b)))
    return pa.array(out, pa.float64())


def token_entropy(df: DataFrame, key: str, ids: str) -> DataFrame:
    """Shannon entropy of the token frequencies of each row: -sum p ln(p + 1e-10)."""
    counts = df.select(key, F.explode(ids).alias("t")).groupBy(key, "t").agg(F.count("*").alias("m"))
    p = F.col("m") / F.sum("m").over(Window.partitionBy(key))
    return counts.withColumn("p", p).groupBy(key).agg(F.sum(-F.col("p") * F.log(F.col("p") + 1e-10)).alias("entropy"))


def weighted_perplexity(df: DataFrame, groups: list[str], nll: Column, weight: Column) -> DataFrame:
    return df.groupBy(*groups).agg(F.exp(F.sum(nll) / F.sum(weight)).alias("perplexity"))
