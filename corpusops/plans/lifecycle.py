"""Queries of run lifecycle, naming, staging, loss terms and the assembled pipelines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusops.functions import arrays as K
from corpusops.functions import text as T
from corpusops.operators import curate as U
from corpusops.operators import runs as R
from corpusops.operators import similarity as S
from corpusops.plans.benchmarks import code_corpus_tokens
from corpusops.plans.registry import query


@query("""
WITH b AS (SELECT id, length(input) AS n, CAST(unit_tests AS VARCHAR[])[1:3] AS x FROM code_rows WHERE input IS NOT NULL)
SELECT id, CAST(list_max(list_filter([0, 1, 2, 3], lambda k: k = 0 OR n + coalesce(list_sum(list_transform(x[1:k], lambda a: length(a))), 0) <= 450)) AS INT) AS fitting FROM b""")
def prompt_fit_assertions(spark, t):
    """The most of three assertions that still fit a prompt's budget."""
    first = F.slice(F.from_json("unit_tests", "array<string>"), 1, 3)
    size = lambda k: F.length("input") + F.aggregate(F.slice(first, F.lit(1), k), F.lit(0), lambda s, a: s + F.length(a))
    ks = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: (k == 0) | (size(k) <= 450))
    return t("code_rows").where("input is not null").select("id", F.array_max(ks).alias("fitting"))


@query("SELECT status, count(*) AS n FROM (SELECT unnest(CAST(tests_execution_status AS VARCHAR[])) AS status FROM code_rows) GROUP BY status")
def execution_status_counts(spark, t):
    return t("code_rows").select(F.explode(F.from_json("tests_execution_status", "array<string>")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT domain, count(*) AS n, count(*) FILTER (contains(output, '```')) AS fenced, round(coalesce(count(*) FILTER (contains(output, '```')) / count(output), 0), 6) AS fenced_rate, count(*) FILTER (input IS NULL) AS without_input FROM code_rows GROUP BY domain")
def generation_diagnostics(spark, t):
    fenced = F.count_if(F.contains("output", F.lit("```")))
    return t("code_rows").groupBy("domain").agg(F.count("*").alias("n"), fenced.alias("fenced"), F.round(F.coalesce(F.try_divide(fenced, F.count("output")), F.lit(0.0)), 6).alias("fenced_rate"), F.count_if(F.col("input").isNull()).alias("without_input"))


@query("SELECT lower(trim(source)) AS source, list(DISTINCT source_subtype ORDER BY source_subtype) FILTER (source_subtype IS NOT NULL) AS subtypes FROM prepared_rows GROUP BY 1")
def subtypes_by_source(spark, t):
    return t("prepared_rows").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.array_sort(F.collect_set("source_subtype")).alias("subtypes"))


_SHARDS = "SELECT label AS shard, min(vec_id) AS row_start, max(vec_id) + 1 AS row_end FROM embeddings GROUP BY label"


@query(f"SELECT shard, row_start, previous FROM (SELECT shard, row_start, lag(row_end) OVER (ORDER BY row_start, shard) AS previous FROM ({_SHARDS})) WHERE previous IS NOT NULL AND previous <> row_start")
def shard_contiguity(spark, t):
    """Shards that do not start where the one before ends; the shard table is a manifest of a few rows."""
    shards = t("embeddings").groupBy(F.col("label").alias("shard")).agg(F.min("vec_id").alias("row_start"), (F.max("vec_id") + 1).alias("row_end"))
    d = shards.withColumn("previous", F.lag("row_end").over(Window.orderBy("row_start", "shard")))
    return d.where("previous is not null and previous <> row_start").select("shard", "row_start", "previous")


@query("SELECT run_id, seed_no, example_id, generation_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seed_no, example_id ORDER BY written_at, generation_id) AS rn FROM generations) WHERE rn = 1")
def shard_merge(spark, t):
    """Shards of a run merged to one row for each id, the first written; late repeats are left out."""
    g = t("generations").select("run_id", "seed_no", "example_id", "generation_id", F.coalesce("written_at", F.lit("9999-12-31").cast("timestamp_ntz")).alias("w"))
    return U.keep_first(g, ["run_id", "seed_no", "example_id"], ["w", "generation_id"]).select("run_id", "seed_no", "example_id", "generation_id")


@query("SELECT run_id, seed_no, max(example_id) + 1 AS expected, count(DISTINCT example_id) AS found, max(example_id) + 1 = count(DISTINCT example_id) AS complete FROM generations GROUP BY ALL")
def resume_completeness(spark, t):
    n, d = F.max("example_id") + 1, F.countDistinct("example_id")
    return t("generations").groupBy("run_id", "seed_no").agg(n.alias("expected"), d.alias("found"), (n == d).alias("complete"))


@query("SELECT DISTINCT run_id, seed_no, 'eval_' || run_id || '_seed' || seed_no || CASE WHEN seed_no % 2 = 0 THEN '_ema' ELSE '' END AS run_name, regexp_replace(run_id || '/seed' || seed_no || '.jsonl', '\\.jsonl$', '.results.json') AS result_path, run_id || '.rank' || lpad(CAST(seed_no AS VARCHAR), 4, '0') || '.jsonl' AS shard_name FROM generations")
def run_names(spark, t):
    seed = F.col("seed_no").cast("string")
    return t("generations").select("run_id", "seed_no").distinct().select(
        "run_id", "seed_no", F.concat(F.lit("eval_"), "run_id", F.lit("_seed"), seed, F.when(F.col("seed_no") % 2 == 0, "_ema").otherwise("")).alias("run_name"),
        F.regexp_replace(F.concat("run_id", F.lit("/seed"), seed, F.lit(".jsonl")), r"\.jsonl$", ".results.json").alias("result_path"), F.concat("run_id", F.lit(".rank"), F.lpad(seed, 4, "0"), F.lit(".jsonl")).alias("shard_name"),
    )


@query("SELECT sha256(string_agg(token || '=' || id, ',' ORDER BY token)) AS fingerprint, count(*) AS entries FROM (SELECT source_subtype AS token, count(*) AS id FROM prepared_rows WHERE source_subtype IS NOT NULL GROUP BY 1)")
def vocabulary_hash(spark, t):
    v = t("prepared_rows").where("source_subtype is not null").groupBy(F.col("source_subtype").alias("token")).agg(F.count("*").alias("id"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("token", "id"))), lambda x: F.concat(x["token"], F.lit("="), x["id"].cast("string")))
    return v.agg(F.sha2(F.array_join(lines, ","), 256).alias("fingerprint"), F.count("*").alias("entries"))


@query("SELECT label, arg_max(name, step) AS latest, max(step) AS step FROM (SELECT label, 'checkpoint_' || vec_id * 10 AS name, CAST(regexp_extract('checkpoint_' || vec_id * 10, '_([0-9]+)$', 1) AS BIGINT) AS step FROM embeddings) GROUP BY label")
def latest_checkpoint(spark, t):
    name = F.concat(F.lit("checkpoint_"), (F.col("vec_id") * 10).cast("string"))
    step = F.regexp_extract(name, "_([0-9]+)$", 1).cast("bigint")
    return t("embeddings").groupBy("label").agg(F.max_by(name, step).alias("latest"), F.max(step).alias("step"))


@query("SELECT collection_id AS path, min(doc_id) AS first_seen FROM documents WHERE collection_id IS NOT NULL GROUP BY 1")
def staging_plan(spark, t):
    return t("documents").where("collection_id is not null").groupBy(F.col("collection_id").alias("path")).agg(F.min("doc_id").alias("first_seen"))


@query("SELECT final_id, list_concat(input_ids[2:], [0]) AS shifted, len(condition_input_ids) AS prompt, CASE WHEN len(input_ids) > 1 THEN len(input_ids) - 1 ELSE 0 END AS counted FROM final_rows")
def shifted_targets(spark, t):
    n = F.size("input_ids")
    return t("final_rows").select("final_id", F.concat(F.slice("input_ids", F.lit(2), n), F.array(F.lit(0))).alias("shifted"), F.size("condition_input_ids").cast("bigint").alias("prompt"), F.greatest(n - 1, F.lit(0)).cast("bigint").alias("counted"))


@query("SELECT user_id % 8 AS rank, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) / greatest(1, (SELECT count(*) FROM events WHERE event_type = 'click') / 8.0), 6) AS click_term, round(sum(CASE WHEN event_type <> 'click' THEN value ELSE 0 END) / greatest(1, (SELECT count(*) FROM events WHERE event_type <> 'click') / 8.0), 6) AS other_term FROM events GROUP BY 1")
def normalised_loss_terms(spark, t):
    """Sums of a rank's rows over the number expected on each rank, so that ranks add up to the global mean."""
    click = F.col("event_type") == "click"
    whole = t("events").agg(F.greatest(F.lit(1.0), F.count_if(click) / 8.0).alias("a"), F.greatest(F.lit(1.0), F.count_if(~click) / 8.0).alias("b"))
    term = lambda flag: F.sum(F.when(flag, F.col("value")).otherwise(0.0))
    by_rank = t("events").groupBy((F.col("user_id") % 8).alias("rank")).agg(term(click).alias("x"), term(~click).alias("y"))
    return by_rank.join(F.broadcast(whole)).select("rank", F.round(F.col("x") / F.col("a"), 6).alias("click_term"), F.round(F.col("y") / F.col("b"), 6).alias("other_term"))


@query("SELECT n, list_transform(range(0, n + 1), lambda i: round(i / n, 9)) AS uniform, list_transform(range(0, n + 1), lambda i: round(sqrt(i / n), 9)) AS power FROM (SELECT unnest([4, 16, 64]) AS n)")
def time_grids(spark, t):
    grid = F.sequence(F.lit(0), F.col("n"))
    return spark.createDataFrame([(4,), (16,), (64,)], "n int").select("n", F.transform(grid, lambda i: F.round(i / F.col("n"), 9)).alias("uniform"), F.transform(grid, lambda i: F.round(F.sqrt(i / F.col("n")), 9)).alias("power"))


_CLOSED = "coalesce(ends_with(target, '#### ' || gold_answer) OR ends_with(target, 'Final answer: $\\boxed{' || gold_answer || '}$'), false)"


@query(f"SELECT row_number() OVER (ORDER BY source, source_index, final_id) - 1 AS \"index\", source, CAST(source_index AS INT) AS source_index, gold_answer, target FROM final_rows WHERE split = 'train' AND {_CLOSED}")
def finalize_rows(spark, t):
    """The rows that unfinished_rows does not report, numbered in source order and cast to the final types; one that did not close would fail the query."""
    rows = t("final_rows").where("split = 'train'").where(_closed())
    placed = U.finalize(rows.select("source", "source_index", "final_id", "gold_answer", "target"), ["source", "source_index", "final_id"], "target", "gold_answer")
    return placed.select("index", "source", F.col("source_index").cast("int").alias("source_index"), "gold_answer", "target")


def _closed():
    return F.coalesce(F.col("target").endswith(F.concat(F.lit("#### "), F.col("gold_answer"))) | F.col("target").endswith(F.concat(F.lit("Final answer: $\\boxed{"), F.col("gold_answer"), F.lit("}$"))), F.lit(False))


@query(f"SELECT final_id, gold_answer IS NULL AS without_answer FROM final_rows WHERE split = 'train' AND NOT {_CLOSED}")
def unfinished_rows(spark, t):
    """Training rows whose target does not close with their answer."""
    return t("final_rows").where("split = 'train'").where(~_closed()).select("final_id", F.col("gold_answer").isNull().alias("without_answer"))


@query()
def code_corpus_pipeline(spark, t):
    """The code corpus from raw rows to kept rows: metadata, fences and syntax, token budgets, then the first of each task. Counts by outcome."""
    rows = code_corpus_tokens(spark, t).select("id", "reason", T.match_text(F.col("input")).alias("task"))
    first = U.keep_first(rows.where("reason = ''").select("task", "id"), ["task"], ["id"]).select("id", F.lit(True).alias("first"))
    final = rows.join(first, "id", "left").select(F.when(F.col("reason") != "", F.col("reason")).when(F.col("first"), "kept").otherwise("repeated_task").alias("outcome"))
    return final.groupBy("outcome").agg(F.count("*").alias("n"))


@query()
def metadata_document(spark, t):
    """One JSON document of a curated corpus: counts by source and reason, composition and sizes of each split, thresholds, seeds, and fingerprints of the settings and of all of it."""
    p = t("prepared_rows").withColumn("source", F.lower(F.trim("source")))
    lists = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))  # noqa: E731  (a row for each source, reason or split)
    sources = lists(p.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("filter_reason") == "").alias("accepted"), F.countDistinct("question_key").alias("questions"), F.countDistinct("source_question_key").alias("source_questions")), "sources")
    reasons = lists(p.where("filter_reason <> ''").groupBy("filter_reason").agg(F.count("*").alias("n")), "reasons")
    f = t("final_rows").withColumn("tokens", F.size("condition_input_ids") + F.size("input_ids"))
    outputs = lists(f.groupBy("split", F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("n"), F.countDistinct("problem_group_id").alias("groups"), F.sum("tokens").alias("tokens")), "outputs")
    settings = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in {"benchmark_coverage": 0.85, "eight_gram": S.EIGHT, "five_gram": S.FIVE, "split_coverage": 0.90, "validation_fraction": 0.10, "validation_seed": "7"}.items())))
    whole = sources.join(F.broadcast(reasons)).join(F.broadcast(outputs)).withColumn("settings", settings)  # one row each
    document = whole.select(F.to_json(F.struct("settings", "sources", "reasons", "outputs")).alias("document"), F.sha2("settings", 256).alias("settings_fingerprint"))
    return document.withColumn("fingerprint", F.sha2("document", 256))


@query("SELECT field FROM (SELECT unnest(['dims', 'rows']) AS field, unnest([64, 1]) AS expected, unnest([max(len(embedding)), count(*)]) AS found FROM embeddings) WHERE expected <> found")
def manifest_check(spark, t):
    """Fields in which a cache differs from its manifest."""
    found = t("embeddings").agg(F.max(F.size("embedding")).alias("dims"), F.count("*").alias("rows")).first().asDict()
    return spark.createDataFrame([(f,) for f in R.manifest_mismatches({"dims": 64, "rows": 1}, found)], "field string")


@query("SELECT field FROM (SELECT unnest(['batch', 'dims', 'rounds', 'rows']) AS field, unnest([8, 64, 1, 1]) AS expected, unnest([16, max(len(embedding)), 1, count(*)]) AS found FROM embeddings) WHERE expected <> found AND field <> 'batch'")
def manifest_check_with_defaults(spark, t):
    """The same with a field that does not count and one that an older manifest lacks and takes its default."""
    found = t("embeddings").agg(F.max(F.size("embedding")).alias("dims"), F.count("*").alias("rows")).first().asDict()
    differ = R.manifest_mismatches({"dims": 64, "rows": 1, "batch": 8}, {**found, "batch": 16, "rounds": 1}, ignored=("batch",), defaults={"rounds": 1})
    return spark.createDataFrame([(f,) for f in differ], "field string")


@query("SELECT CAST(n AS INT) AS n, true AS rising, n + 1 AS points FROM (SELECT unnest([4, 16, 64]) AS n)")
def drawn_time_grids(spark, t):
    """Grids between 0 and 1 of sorted logit-normal draws that depend on their place alone; all must rise."""
    draw = lambda n, i: 1 / (1 + F.exp(-(K.normal(n, i, seed=9) * 0.8 - 0.8)))
    points = spark.createDataFrame([(4,), (16,), (64,)], "n int").select("n", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("i")).select("n", draw(F.col("n"), F.col("i")).alias("x"))
    grid = points.groupBy("n").agg(F.array_sort(F.collect_list("x")).alias("x")).select("n", F.concat(F.array(F.lit(0.0)), "x", F.array(F.lit(1.0))).alias("x"))
    rises = F.forall(F.zip_with(F.slice("x", F.lit(1), F.size("x") - 1), F.slice("x", F.lit(2), F.size("x") - 1), lambda a, b: a < b), lambda y: y)
    return grid.select("n", rises.alias("rising"), F.size("x").cast("bigint").alias("points"))
