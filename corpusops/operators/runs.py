"""Integrity of resumable runs: sequences, shards, manifests and appends that happen once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequence_gaps(df: DataFrame, groups: list[str], position: str) -> DataFrame:
    """(groups, after, found): places where a position is not one more than the one before; repeats count as gaps."""
    w = Window.partitionBy(*groups).orderBy(position)
    d = df.withColumn("after", F.lag(position).over(w))
    return d.where(F.col("after").isNotNull() & (F.col(position) != F.col("after") + 1)).select(*groups, "after", F.col(position).alias("found"))


def append_once(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose key is not there yet, nulls in keys comparing as equal; each key once."""
    there = existing.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    condition = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return new.dropDuplicates(keys).join(there, condition, "left_anti")


def set_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """(column, side): values on one side only; empty for equal sets."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def manifest_mismatches(expected: dict, found: dict, ignored: tuple[str, ...] = (), defaults: dict | None = None) -> list[str]:
    """Fields that differ between two manifests, in order; ignored fields do not count, absent ones take their default."""
    base = defaults or {}
    fields = sorted((set(expected) | set(found) | set(base)) - set(ignored))
    return [f for f in fields if expected.get(f, base.get(f)) != found.get(f, base.get(f))]


def require_sequence(df: DataFrame, groups: list[str], position: str) -> DataFrame:
    """The table itself; raises ValueError unless the positions of each group are 0, 1, 2 and so on, each once."""
    n, ids, most = F.count("*"), F.countDistinct(position), F.max(position) + 1
    bad = df.groupBy(*groups).agg(n.alias("n"), ids.alias("ids"), most.alias("most"), F.min(position).alias("least")).where("n <> ids or n <> most or least <> 0")
    if not bad.isEmpty():
        raise ValueError(f"positions with gaps or repeats: {bad.first()}")
    return df


def require_aligned(df: DataFrame, left: str, right: str) -> DataFrame:
    """The rows; one whose two lengths differ raises an error when it is read."""
    same = F.col(left).eqNullSafe(F.col(right))
    return df.withColumn(left, F.when(same, F.col(left)).otherwise(F.raise_error(F.lit("rows are not aligned")).cast(df.schema[left].dataType)))
