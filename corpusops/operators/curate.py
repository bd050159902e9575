"""Curation operators: reasons, deduplication, groups, samples, splits, batches and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusops.operators.ranking import ordered_index, running_total

PAIR_LIMIT = 100_000
# The judged fields and the length of a test list.
JUDGED = ("requirement_conformance", "logical_correctness", "edge_case_consideration")
TESTS = 10
# What stands before and after the answer that closes a target.
CLOSINGS = (("#### ", ""), ("Final answer: $\\boxed{", "}$"))


def first_reason(*reasons: Column) -> Column:
    """The first reason that is not null, else ''."""
    return F.coalesce(*reasons, F.lit(""))


def rejections(rows: DataFrame, stage: str) -> DataFrame:
    return rows.withColumn("stage", F.lit(stage))


def require_columns(df: DataFrame, required: list[str], exact: bool = False) -> DataFrame:
    """The table itself; raises ValueError when columns are missing, or with ``exact`` when there are others."""
    missing, extra = sorted(set(required) - set(df.columns)), sorted(set(df.columns) - set(required))
    if missing or (exact and extra):
        raise ValueError(f"columns missing: {missing}" + (f", not expected: {extra}" if exact and extra else ""))
    return df


def require_empty(df: DataFrame, message: str) -> None:
    """Raises ValueError when a table of violations has a row."""
    if not df.isEmpty():
        raise ValueError(message)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; rows with a null key are left out.

    An aggregate with map-side combination, so copies of a hot key meet as one row a partition.
    """
    first = df.where(F.forall(F.array(*(F.col(k).isNotNull() for k in keys)), lambda x: x)).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return first.select("row.*")


def conflicts(df: DataFrame, key: str, answer: str) -> DataFrame:
    """Keys with more than one distinct answer: (key, answers in order, n). Nulls take no part."""
    per = df.where(F.col(key).isNotNull() & F.col(answer).isNotNull()).groupBy(key, answer).agg(F.count("*").alias("m"))
    out = per.groupBy(key).agg(F.array_sort(F.collect_list(answer)).alias("answers"), F.sum("m").alias("n"))
    return out.where(F.size("answers") > 1)


def composition(df: DataFrame, source: str, question: str, source_question: str) -> DataFrame:
    """Rows and distinct questions of each source and their shares; the shares of distinct counts refer to the sum over sources."""
    per = df.groupBy(source).agg(F.count("*").alias("n"), F.countDistinct(question).alias("questions"), F.countDistinct(source_question).alias("source_questions"))
    whole = per.agg(*(F.sum(c).alias(f"all_{c}") for c in ("n", "questions", "source_questions")))
    share = lambda c: F.round(F.col(c) / F.col(f"all_{c}"), 9)
    return per.join(F.broadcast(whole)).select(source, "n", "questions", "source_questions", share("n").alias("row_share"), share("questions").alias("question_share"), share("source_questions").alias("source_question_share"))


def quality_reason(judgement: str, tests: str, statuses: str, score: str, least: int = 4) -> Column:
    """'' or why a judged code row is refused: a score below ``least``, or an average score that is not a tenth of the passes.

    Metadata that is there but malformed raises an error: scores must be JSON integers of 1 to 5 with a justification, ten tests and
    ten pass/fail states. A null in any of the four gives 'missing_metadata'.
    """
    field = lambda f, x: F.get_json_object(judgement, f"$.{f}.{x}")
    known = F.json_object_keys(judgement)
    states, texts = F.from_json(statuses, "array<string>"), F.from_json(tests, "array<string>")
    passed = F.size(F.filter(states, lambda s: s == "pass"))
    any_of = lambda f: F.exists(F.array(*map(f, JUDGED)), lambda x: x)
    malformed = first_reason(
        F.when(known.isNull() | states.isNull() | texts.isNull(), "invalid_serialized_metadata"),
        F.when(any_of(lambda f: ~F.array_contains(known, f)), "invalid_judgement_fields"),
        F.when(any_of(lambda f: ~F.coalesce(field(f, "score").rlike(r"\A[1-5]\z"), F.lit(False))), "invalid_judgement_score"),
        F.when(any_of(lambda f: F.coalesce(F.trim(field(f, "justification")), F.lit("")) == ""), "invalid_judgement_justification"),
        F.when(F.size(texts) != TESTS, "invalid_unit_tests"),
        F.when((F.size(states) != TESTS) | F.exists(states, lambda s: ~s.isin("pass", "fail")), "invalid_test_statuses"),
    )
    return first_reason(
        F.when(F.col(judgement).isNull() | F.col(tests).isNull() | F.col(statuses).isNull() | F.col(score).isNull(), "missing_metadata"),
        F.when(malformed != "", F.raise_error(malformed).cast("string")),
        F.when(any_of(lambda f: field(f, "score").try_cast("int") < least), f"judge_score_below_{least}"),
        F.when(F.coalesce(F.col(score).try_cast("decimal(12,6)") * 10, F.lit(-1)) != passed, "inconsistent_average_test_score"),
    )


def exhaustive_pairs(left: DataFrame, right: DataFrame, condition: Column, limit: int = PAIR_LIMIT) -> DataFrame:
    """All pairs under a condition, for two small tables; raises ValueError beyond ``limit`` pairs (the gram join has no such bound)."""
    if left.count() * right.count() > 2 * limit:
        raise ValueError("too many pairs for the exhaustive mode")
    return left.join(F.broadcast(right), condition)


def linked_pairs(df: DataFrame, key: str, source_key: str) -> DataFrame:
    """Distinct (u, v) of a question and the question it derives from; nulls and empty keys take no part."""
    return df.select(F.col(key).alias("u"), F.col(source_key).alias("v")).where("u <> '' and v <> ''").distinct()


def group_ids(components: DataFrame, prefix: str = "problem_") -> DataFrame:
    """Adds problem_group_id to (node, component): numbered from 0 by the order of the components' least members.

    Components are ranked within sampled ranges of their order, written once, so no task sees them all.
    """
    numbered = ordered_index(components.select("component").distinct(), ["component"], "number")
    return components.join(numbered, "component").withColumn("problem_group_id", F.concat(F.lit(prefix), F.lpad(F.col("number").cast("string"), 8, "0"))).drop("number")


def finalize(df: DataFrame, order: list[str], target: str, answer: str) -> DataFrame:
    """Adds index, the place in the order from 0. A row whose target does not close with its answer raises an error when it is read."""
    closes = [F.col(target).endswith(F.concat(F.lit(a), F.col(answer), F.lit(b))) for a, b in CLOSINGS]
    fine = F.coalesce(closes[0] | closes[1], F.lit(False))
    checked = df.withColumn(target, F.when(fine, F.col(target)).otherwise(F.raise_error(F.concat(F.lit("target without its answer: "), F.coalesce(F.right(F.col(target), F.lit(60)), F.lit("null")))).cast("string")))
    return ordered_index(checked, order, "index")


def attach_groups(df: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """Adds problem_group_id from groups(node, problem_group_id) by the row's key; a row whose key has no group raises an error."""
    known = groups.select(F.col("node").alias(key), "problem_group_id")
    missing = F.raise_error(F.concat(F.lit("no group for the key "), F.coalesce(F.col(key), F.lit("null"))))
    return df.join(known, key, "left").withColumn("problem_group_id", F.coalesce("problem_group_id", missing.cast("string")))


def whole_groups(df: DataFrame, key: str, group: str, chosen: DataFrame) -> DataFrame:
    """(group) of every row whose key is among the chosen ones: a sample of keys is taken to all of their groups."""
    return df.join(chosen.select(F.col("key").alias(key)).distinct(), key, "left_semi").select(group).where(F.col(group).isNotNull()).distinct()


def require_split(df: DataFrame, group: str, split: str, sides: tuple[str, str] = ("train", "validation")) -> DataFrame:
    """The table itself; raises ValueError when a side is empty or a group lies on both."""
    counts = {r[0]: r[1] for r in df.groupBy(split).agg(F.count("*")).collect()}
    if any(not counts.get(s) for s in sides):
        raise ValueError(f"empty side of a split: {counts}")
    both = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(split).alias("n")).where("n > 1")
    require_empty(both, "a group lies on both sides of the split")
    return df


def sample_keys(df: DataFrame, strata: list[str], key: str, fraction: float, seed: str) -> DataFrame:
    """(strata, key): of each stratum floor(n * fraction + 0.5) distinct keys, by the order of a seeded hash."""
    keys = df.where(F.col(key).isNotNull() & (F.col(key) != "")).select(*strata, F.col(key).alias("key")).distinct().withColumn("h", F.md5(F.concat(F.lit(seed), "key")))
    sliced = keys.withColumn("__s", F.conv(F.substring("h", 1, 2), 16, 10).cast("int"))
    ranked = running_total(sliced, strata, ["h", "key"], F.lit(1), "rank", 256, key=F.col("__s"))
    sizes = keys.groupBy(*strata).agg(F.count("*").alias("n"))
    return ranked.join(sizes, strata).where(F.col("rank") < F.floor(F.col("n") * fraction + 0.5)).select(*strata, "key")


def require_sample(chosen: DataFrame, whole: DataFrame) -> DataFrame:
    """The chosen keys; raises ValueError when they are none or all."""
    n, m = chosen.count(), whole.count()
    if n == 0 or n >= m:
        raise ValueError(f"a sample of {n} keys of {m} splits nothing")
    return chosen


def fixed_subset(df: DataFrame, size: int, seed: str, key: str, order: list[str]) -> DataFrame:
    """``size`` rows by the order of a seeded hash of their key; raises ValueError when there are fewer. The feature is a top-k."""
    picked = df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), *order).limit(size)
    if picked.count() < size:
        raise ValueError(f"fewer than {size} rows to choose from")
    return picked


def require_release(df: DataFrame, rows: int, id_col: str, prefix: str, required: list[str]) -> DataFrame:
    """The table itself; raises ValueError unless it has the number of rows, unique ids with the prefix, and no null in a required column."""
    require_columns(df, [id_col, *required])
    n, ids, named, whole = df.agg(F.count("*"), F.countDistinct(id_col), F.count_if(F.col(id_col).startswith(prefix)), F.count_if(F.forall(F.array(*(F.col(c).isNotNull() for c in required)), lambda x: x))).first()
    if (n, ids, named, whole) != (rows,) * 4:
        raise ValueError(f"{n} rows, {ids} ids, {named} of them with the prefix, {whole} rows complete; {rows} of each expected")
    return df


def split_by_group(df: DataFrame, group: str, chosen: DataFrame) -> DataFrame:
    """Adds split: 'validation' for the rows of chosen groups, else 'train'."""
    marked = chosen.select(F.col(group)).distinct().withColumn("__in", F.lit(True))
    return df.join(marked, group, "left").withColumn("split", F.when(F.col("__in"), "validation").otherwise("train")).drop("__in")


def length_grouped_batches(df: DataFrame, id_col: str, length: str, seed: str, batch: int, window: int, world: int) -> DataFrame:
    """(id, batch, rank): rows in hash order, cut to full batches, sorted by length within windows of batches, dealt to ranks.

    Batches are numbered in the order of a second seeded hash, so that an epoch does not run by length.
    """
    h = F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")))
    rows = df.select(id_col, F.col(length).alias("__n"), h.alias("__h"), F.lit(0).alias("__all")).withColumn("__s", F.conv(F.substring("__h", 1, 2), 16, 10).cast("int"))
    placed = running_total(rows, ["__all"], ["__h", id_col], F.lit(1), "__p", 256, key=F.col("__s"))
    total = df.count() // batch * batch
    kept = placed.where(F.col("__p") < total).withColumn("__w", F.floor(F.col("__p") / (window * batch)))
    q = F.row_number().over(Window.partitionBy("__w").orderBy(F.col("__n").desc(), "__p")) - 1
    batches = spark_range(df, total // batch).withColumn("__all", F.lit(0)).withColumn("__h", F.md5(F.concat(F.lit(seed), F.lit("b"), F.col("__b").cast("string")))).withColumn("__s", F.conv(F.substring("__h", 1, 2), 16, 10).cast("int"))
    order = running_total(batches, ["__all"], ["__h", "__b"], F.lit(1), "batch", 256, key=F.col("__s")).select("__b", "batch")
    dealt = kept.withColumn("__q", q).select(id_col, (F.col("__w") * window + F.floor(F.col("__q") / batch)).cast("bigint").alias("__b"), (F.col("__q") % world).cast("int").alias("rank"))
    return dealt.join(order, "__b").select(id_col, "batch", "rank")


def spark_range(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).withColumnRenamed("id", "__b")


def range_lookup(rows: DataFrame, position: str, ranges: DataFrame, start: str, end: str, cell: int) -> DataFrame:
    """Each row with the half-open range [start, end) that holds its position.

    An equi-join on cells of the axis, to which ranges are expanded, so it neither broadcasts nor compares all pairs.
    """
    cells = ranges.where(F.col(end) > F.col(start)).withColumn("__c", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))))
    return rows.withColumn("__c", F.floor(F.col(position) / cell)).join(cells, "__c").where((F.col(position) >= F.col(start)) & (F.col(position) < F.col(end))).drop("__c")
