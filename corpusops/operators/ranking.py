"""Ranks and running totals within groups of any size, without putting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.runtime import written


def running_total(df: DataFrame, groups: list[str], order: list[str], value: Column, name: str, parts: int, key: Column | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row of its group, as bigint.

    A group is cut into ``parts`` slices by the hash of ``key`` (the order columns if not given); rows follow the slice,
    then ``order``. Slices are summed, the sums are accumulated over the small table of slices, and rows are only
    sorted within their slice. Nulls in a value count as 0. ``order`` must be unique in a group for a
    definite result. With row count 1 as value this is the row number, from 0.
    """
    cut = F.pmod(F.xxhash64(*order) if key is None else key, F.lit(parts)).cast("int")
    own = df.withColumn("__slice", cut).withColumn("__value", F.coalesce(value.cast("bigint"), F.lit(0)))
    sums = own.groupBy(*groups, "__slice").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*groups).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*groups, "__slice", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*groups, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = own.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    conditions = [summed[g].eqNullSafe(starts[g]) for g in groups] + [summed["__slice"] == starts["__slice"]]
    joined = summed.join(starts, conditions)
    return joined.select(*[summed[c] for c in df.columns], (F.col("__start") + F.col("__inside")).alias(name))


def ordered_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in the order of the columns, from 0 without gaps, as bigint.

    Rows go to sampled ranges of the order, which are written once so that both passes see the same ranges; only the
    sizes of the ranges are summed in one task. ``order`` must be unique for a definite result; nulls come first.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__part").agg(F.count("*").alias("m")).select("__part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__inside", inside).join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__start") + F.col("__inside")).cast("bigint").alias(name))
