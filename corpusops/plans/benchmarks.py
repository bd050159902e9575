"""Queries of benchmark building, run records, vocabularies, caches and averages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusops.functions import answers as A
from corpusops.functions import arrays as K
from corpusops.functions import code as P
from corpusops.functions import settings as C
from corpusops.functions import text as T
from corpusops.functions.tokens import pair_tokens, token_count
from corpusops.operators import curate as U
from corpusops.operators import metrics as M
from corpusops.operators import runs as R
from corpusops.plans.registry import nfkc_sql, query
from corpusops.runtime import ensure_checkpoint_dir
from corpusops.sources import jsonl

# Fixed value: the prompt of a code task.
CODE_PROMPT = ("Write a complete Python solution. Return only code.\n\n", "\n\nPython solution:\n")


@query("SELECT item_id, 'Write a complete Python solution. Return only code.' || chr(10) || chr(10) || trim(question) || chr(10) || chr(10) || 'Python solution:' || chr(10) AS prompt FROM eval_items WHERE suite = 'code'")
def code_prompts(spark, t):
    return t("eval_items").where("suite = 'code'").select("item_id", F.concat(F.lit(CODE_PROMPT[0]), T.required_text(F.col("question")), F.lit(CODE_PROMPT[1])).alias("prompt"))


@query("SELECT key, len(list_distinct(w)) AS tokens, len(list_distinct(list_transform(range(1, greatest(length(key) - 2, 1)), lambda i: substr(key, i, 4)))) AS characters, CAST(greatest(len(w) - 4, 0) > 0 AS INT) + CAST(greatest(len(w) - 7, 0) > 0 AS INT) + 2 - CAST(length(key) < 4 AS INT) AS families FROM (SELECT DISTINCT question_key AS key, string_split(question_key, ' ') AS w FROM prepared_rows WHERE question_key <> '' AND length(question_key) >= 4)")
def signature_families(spark, t):
    """The feature sets that signatures are taken of: words, runs of four characters, word 5-grams and 8-grams; empty families are left out."""
    keys = t("prepared_rows").where("question_key <> '' and length(question_key) >= 4").select(F.col("question_key").alias("key")).distinct()
    w = F.split("key", " ")
    four = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - 3, F.lit(1))), lambda i: F.substring("key", i, F.lit(4))))
    made = keys.select("key", F.array_distinct(w).alias("a"), four.alias("b"), T.gram_hashes(5)(F.col("key")).alias("c"), T.gram_hashes(8)(F.col("key")).alias("d"))
    some = sum((F.size(x) > 0).cast("int") for x in "abcd")
    return made.select("key", F.size("a").cast("bigint").alias("tokens"), F.size("b").cast("bigint").alias("characters"), some.alias("families"))


@query("SELECT item_id, solution AS code, true AS parses FROM eval_items WHERE suite = 'code'")
def benchmark_solutions(spark, t):
    """Whole programs of the code tasks: a solution that continues its prompt is put behind it, any other stands alone; all must parse."""
    code = F.when(F.col("solution").rlike(r"\A\s+\S"), F.concat("question", "solution")).otherwise(F.col("solution"))
    rows = t("eval_items").where("suite = 'code'").select("item_id", T.newlines(code).alias("code"))
    parses = P.canonical_ast(F.col("code")) != ""
    return rows.select("item_id", "code", F.when(parses, True).otherwise(F.raise_error(F.concat(F.lit("no program: "), F.col("item_id").cast("string"))).cast("boolean")).alias("parses"))


@query()
def benchmark_dataset(spark, t):
    """Prompts, solutions and token ids of the code tasks; a task beyond its budget of 512 and 1,024 tokens fails the build."""
    rows = code_prompts(spark, t).join(benchmark_solutions(spark, t), "item_id").select("item_id", "prompt", "code", pair_tokens(F.col("prompt"), F.col("code"), joint="").alias("ids"))
    a, b = F.size("ids.condition_ids"), F.size("ids.response_ids")
    fits = F.when((a <= 512) & (a + b <= 1024), True).otherwise(F.raise_error(F.concat(F.lit("task too long: "), F.col("item_id").cast("string"))).cast("boolean"))
    return rows.select("item_id", "prompt", "code", a.alias("prompt_tokens"), b.alias("solution_tokens"), fits.alias("fits"))


@query()
def code_corpus_tokens(spark, t):
    """Code rows with their token ids: refused before the length test they stay empty, beyond 512 and 1,024 tokens they keep their texts and ids."""
    rows = t("code_rows").select("id", T.required_text(F.col("input")).alias("task"), P.unfenced(F.col("output")).alias("code"), "output", U.quality_reason("llm_judgement", "unit_tests", "tests_execution_status", "average_test_score").alias("quality"))
    early = rows.withColumn("reason", U.first_reason(F.nullif("quality", F.lit("")), F.when(F.col("task").isNull(), "missing_task"), F.nullif(P.code_problem(F.col("code"), F.col("output")), F.lit(""))))
    fine = F.col("reason") == ""
    ids = pair_tokens(F.when(fine, F.concat(F.lit(CODE_PROMPT[0]), F.col("task"), F.lit(CODE_PROMPT[1]))), F.when(fine, F.col("code")), joint="")
    sized = early.withColumn("ids", ids).withColumn("a", F.size("ids.condition_ids")).withColumn("b", F.size("ids.response_ids"))
    late = F.when(~fine, F.col("reason")).when(F.col("a") > 512, "input_too_long").when(F.col("a") + F.col("b") > 1024, "sequence_too_long").otherwise("")
    return sized.select("id", late.alias("reason"), F.when(fine, F.col("task")).otherwise("").alias("input"), F.when(fine, F.col("code")).otherwise("").alias("target"), F.when(fine, F.col("a")).alias("prompt_tokens"), F.when(fine, F.col("b")).alias("target_tokens"))


@query()
def prompt_fit_tokens(spark, t):
    """The most of three assertions that fit a prompt of 96 tokens."""
    first = F.slice(F.from_json("unit_tests", "array<string>"), 1, 3)
    prompt = lambda k: F.concat(F.col("input"), F.array_join(F.slice(first, 1, k), ""))
    sizes = t("code_rows").where("input is not null").select("id", *(token_count(prompt(k)).alias(f"n{k}") for k in range(4)))
    return sizes.select("id", F.when(F.col("n3") <= 96, 3).when(F.col("n2") <= 96, 2).when(F.col("n1") <= 96, 1).otherwise(0).alias("fitting"), F.col("n0").alias("task_tokens"))


@query()
def code_variants(spark, t):
    """Counters of all modes of treating the programs of the code corpus, each wanted under its tested name."""
    call = F.regexp_extract(F.try_element_at(F.from_json("unit_tests", "array<string>"), F.lit(1)), r"assert\s+(\w+)\(", 1)
    rows = t("code_rows").where("output is not null").select(P.unfenced(F.col("output")).alias("code"), F.nullif(call, F.lit("")).alias("wanted"))
    out = None
    for mode in P.MODES:
        r = rows.select(P.transformer(mode)(F.col("code"), F.col("wanted")).alias("r")).where("r is not null")
        part = r.agg(F.count("*").alias("programs"), *(F.sum(f"r.{c}").alias(c) for c in P.COUNTERS)).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT CAST(i AS INT) AS place, label FROM (VALUES (0, 'raw'), (1, 'ema0p999'), (2, 'ema0p9999')) x(i, label)")
def decay_labels(spark, t):
    return spark.createDataFrame([(i, C.decay_label(k)) for i, k in enumerate(C.decay_keys("0, 0.999, 0.99990"))], "place int, label string")


@query("SELECT final_id, list_transform(range(0, 96), lambda i: CASE WHEN i < len(condition_input_ids) + 16 THEN 1 ELSE 0 END) AS valid, list_transform(range(0, 96), lambda i: 1) AS whole, list_transform(input_ids, lambda x, i: CASE WHEN final_id % 10 = 0 AND i <= 4 THEN 0 WHEN i <= 4 THEN 1 ELSE 2 END) AS kept FROM final_rows")
def validity_and_drop_masks(spark, t):
    n = F.size("condition_input_ids")
    mask = F.transform("input_ids", lambda x, i: F.when(i < 4, 1).otherwise(2))
    return t("final_rows").select("final_id", K.valid_mask(n, 16, 96).alias("valid"), K.valid_mask(n, None, 96).alias("whole"), K.drop_condition(mask, F.col("final_id") % 10 == 0).alias("kept"))


@query("SELECT g.generation_id, f.final_id, f.gold_answer AS reference FROM generations g LEFT JOIN final_rows f ON f.split = 'test' AND f.row_index = g.example_id")
def reference_lookup(spark, t):
    """The reference row of every generation by its example id; one without a row has nulls."""
    refs = t("final_rows").where("split = 'test'").select(F.col("row_index").alias("example_id"), "final_id", F.col("gold_answer").alias("reference"))
    return t("generations").select("generation_id", "example_id").join(refs, "example_id", "left").select("generation_id", "final_id", "reference")


@query("SELECT final_id FROM final_rows WHERE split = 'train' AND row_index IN (SELECT row_index FROM final_rows WHERE split = 'test')")
def positional_select(spark, t):
    """The training rows at the places that a table of indices names: a semi-join."""
    wanted = t("final_rows").where("split = 'test'").select("row_index").distinct()
    return t("final_rows").where("split = 'train'").join(wanted, "row_index", "left_semi").select("final_id")


@query("SELECT event_type, round(avg(m), 6) AS mean FROM (SELECT event_type, user_id % 4 AS rank, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def rank_averages(spark, t):
    """The mean over ranks of each rank's mean over its steps."""
    by_rank = t("events").groupBy("event_type", (F.col("user_id") % 4).alias("rank")).agg(F.avg("value").alias("m"))
    return by_rank.groupBy("event_type").agg(F.round(F.avg("m"), 6).alias("mean"))


@query("WITH RECURSIVE x AS (SELECT run_id, seed_no, example_id, CAST(response_length AS DOUBLE) AS v, row_number() OVER (PARTITION BY run_id, seed_no ORDER BY generation_id) AS i FROM generations WHERE response_length IS NOT NULL), e(run_id, seed_no, i, a) AS (SELECT run_id, seed_no, i, v FROM x WHERE i = 1 UNION ALL SELECT x.run_id, x.seed_no, x.i, 0.9::DOUBLE * e.a + 0.1::DOUBLE * x.v FROM e JOIN x ON x.run_id = e.run_id AND x.seed_no = e.seed_no AND x.i = e.i + 1) SELECT run_id, seed_no, round(arg_max(a, i), 6) AS average FROM e GROUP BY ALL")
def exponential_average(spark, t):
    """The exponential average of the response lengths of a run, in the order they were written."""
    g = t("generations").where("response_length is not null").groupBy("run_id", "seed_no").agg(F.array_sort(F.collect_list(F.struct("generation_id", "response_length"))).alias("x"))
    return g.select("run_id", "seed_no", F.round(K.averaged(F.transform("x", lambda s: s["response_length"].cast("double")), 0.9), 6).alias("average"))


_VOCABULARIES = """u AS (SELECT source_subtype AS token, count(*) AS id FROM prepared_rows WHERE source_subtype IS NOT NULL GROUP BY 1), v AS (SELECT source_subtype AS token, count(*) AS id FROM final_rows WHERE source_subtype IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {_VOCABULARIES}, j AS (SELECT u.token AS a, v.token AS b, u.id AS x, v.id AS y FROM u FULL JOIN v ON u.token = v.token)
SELECT count(*) FILTER (x IS DISTINCT FROM y) = 0 AS exact_mapping, list_sort(coalesce(list(x) FILTER (a IS NOT NULL AND x IS DISTINCT FROM y), [])) AS incompatible_ids, coalesce(max(y), -1) < 1000000 AS consumer_ids_fit, coalesce(max(x) FILTER (x = y), -1) < 1000000 AS shared_ids_fit, count(a) AS own_entries, count(b) AS consumer_entries FROM j""")
def vocabulary_compatibility(spark, t):
    """Whether one vocabulary can read the ids of another: one full outer join over both sides and the sizes of the embedding."""
    u, v = (t(n).where("source_subtype is not null").groupBy(F.col("source_subtype").alias(a)).agg(F.count("*").alias(x)) for n, a, x in (("prepared_rows", "a", "x"), ("final_rows", "b", "y")))
    j = u.join(v, F.col("a") == F.col("b"), "full").withColumn("same", F.col("x").eqNullSafe(F.col("y")))
    return j.agg(
        (F.count_if(~F.col("same")) == 0).alias("exact_mapping"), F.array_sort(F.collect_list(F.when(F.col("a").isNotNull() & ~F.col("same"), F.col("x")))).alias("incompatible_ids"),
        (F.coalesce(F.max("y"), F.lit(-1)) < 1000000).alias("consumer_ids_fit"), (F.coalesce(F.max(F.when(F.col("same"), F.col("x"))), F.lit(-1)) < 1000000).alias("shared_ids_fit"), F.count("a").alias("own_entries"), F.count("b").alias("consumer_entries"),
    )


_BOXED = r"trim(regexp_replace(replace(replace(regexp_extract(target, '\\boxed\{([^{}]*)\}[^{}]*$', 1), '\!', ''), '\,', ''), '\s+', ' ', 'g'))"


@query(rf"SELECT row_id, nullif({_BOXED}, '') AS boxed, coalesce(nullif({_BOXED}, '') = trim(gold_answer), false) AS equal FROM prepared_rows WHERE target LIKE '%\boxed{{%'")
def boxed_equality(spark, t):
    """Equality of the last boxed text with the answer as normalised strings; no algebra."""
    last = F.regexp_extract("target", r"\\boxed\{([^{}]*)\}[^{}]*\z", 1)
    boxed = F.nullif(F.trim(F.regexp_replace(F.replace(F.replace(last, F.lit("\\!"), F.lit("")), F.lit("\\,"), F.lit("")), r"\s+", " ")), F.lit(""))
    return t("prepared_rows").where(F.contains("target", F.lit("\\boxed{"))).select("row_id", boxed.alias("boxed"), F.coalesce(boxed == F.trim("gold_answer"), F.lit(False)).alias("equal"))


@query("SELECT run_id, count(*) AS n, round(100.0 * count(*) FILTER (strict_correct) / count(*), 6) AS strict, round(100.0 * count(*) FILTER (strict_final_answer IS NULL) / count(*), 6) AS invalid, round(100.0 * count(*) FILTER (eos_emitted) / count(*), 6) AS eos, round(avg(response_length), 6) AS mean_length, round(quantile_cont(response_length, 0.5), 6) AS median_length, round(quantile_cont(response_length, 0.95), 6) AS p95_length, list(DISTINCT seed_no ORDER BY seed_no) AS seeds, count(DISTINCT example_id) AS examples FROM generations GROUP BY run_id")
def evaluation_record(spark, t):
    """One record for each run: shares, lengths, seeds and the examples that it covers."""
    share = lambda c: F.round(100 * M.rate(F.count_if(F.coalesce(c, F.lit(False))), F.count("*")), 6)
    q = lambda p: F.round(F.percentile("response_length", F.lit(p)), 6)
    return t("generations").groupBy("run_id").agg(
        F.count("*").alias("n"), share(F.col("strict_correct")).alias("strict"), share(F.col("strict_final_answer").isNull()).alias("invalid"), share(F.col("eos_emitted")).alias("eos"),
        F.round(F.avg("response_length"), 6).alias("mean_length"), q(0.5).alias("median_length"), q(0.95).alias("p95_length"), F.array_sort(F.collect_set("seed_no")).alias("seeds"), F.countDistinct("example_id").alias("examples"),
    )


@query("SELECT run_id, seed_no, count(*) AS n, count(*) FILTER (strict_final_answer IS NULL) AS invalid, bool_and(response_length >= 0 AND (strict_correct IS NOT TRUE OR strict_final_answer IS NOT NULL)) AS consistent, sha256(string_agg(example_id || ':' || coalesce(strict_final_answer, '-'), ',' ORDER BY example_id, generation_id)) AS digest FROM generations GROUP BY ALL")
def generation_digests(spark, t):
    """A digest of each run and seed in the order of its ids, with checks that hold on every row."""
    line = F.concat(F.col("example_id").cast("string"), F.lit(":"), F.coalesce("strict_final_answer", F.lit("-")))
    fine = (F.col("response_length") >= 0) & (~F.coalesce("strict_correct", F.lit(False)) | F.col("strict_final_answer").isNotNull())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("example_id", "generation_id", line.alias("line")))), lambda x: x["line"])  # a run's examples
    return t("generations").groupBy("run_id", "seed_no").agg(F.count("*").alias("n"), F.count_if(F.col("strict_final_answer").isNull()).alias("invalid"), F.bool_and(fine).alias("consistent"), F.sha2(F.array_join(ordered, ","), 256).alias("digest"))


@query("SELECT suite, seed_no, count(*) AS n, round(100.0 * count(*) FILTER (strict_correct) / count(*), 6) AS accuracy FROM (SELECT regexp_extract(problem_group_id, '^([a-z0-9]+)_', 1) AS suite, seed_no, strict_correct FROM generations WHERE problem_group_id IS NOT NULL) GROUP BY ALL")
def suite_report(spark, t):
    g = t("generations").where("problem_group_id is not null").withColumn("suite", F.regexp_extract("problem_group_id", "^([a-z0-9]+)_", 1))
    return g.groupBy("suite", "seed_no").agg(F.count("*").alias("n"), F.round(100 * M.rate(F.count_if(F.coalesce("strict_correct", F.lit(False))), F.count("*")), 6).alias("accuracy"))


_CHOICE = "SELECT event_id, upper(chr(CAST(65 + event_id % 4 AS INT))) AS gold, CASE event_id % 3 WHEN 0 THEN 'because' || chr(10) || 'Final answer: ' || chr(CAST(65 + user_id % 4 AS INT)) WHEN 1 THEN 'so the final answer: ' || chr(CAST(97 + user_id % 4 AS INT)) || ' then' ELSE ' ' || chr(CAST(65 + user_id % 4 AS INT)) END AS v FROM events"


@query(rf"SELECT count(*) AS n, count(*) FILTER (upper(regexp_extract(v, '^\s*([A-Da-d])\s*$', 1)) = gold) AS letters, count(*) FILTER (regexp_extract(v, '(?m)^Final answer: ([A-D])$', 1) = gold) AS exact, count(*) FILTER (upper(regexp_extract(v, '(?i)final answer: ([A-D])', 1)) = gold) AS permissive FROM ({_CHOICE})")
def choice_accuracy(spark, t):
    """Right letters by three readings of an answer: the whole text, its exact last line, its last mention."""
    v = F.expr("CASE event_id % 3 WHEN 0 THEN 'because' || chr(10) || 'Final answer: ' || chr(65 + user_id % 4) WHEN 1 THEN 'so the final answer: ' || chr(97 + user_id % 4) || ' then' ELSE ' ' || chr(65 + user_id % 4) END")
    gold = F.expr("chr(65 + event_id % 4)")
    right = lambda c: F.count_if(F.coalesce(c == gold, F.lit(False)))
    return t("events").agg(F.count("*").alias("n"), right(A.choice_letter(v)).alias("letters"), right(A.rationale_choice(v, True)).alias("exact"), right(A.rationale_choice(v, False)).alias("permissive"))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN i <= vec_id % 70 THEN CAST(embedding[i] AS DOUBLE) ELSE 0 END)) / greatest(1, least(64, vec_id % 70)), 6) AS mean, round(least(64, vec_id % 70) / 64.0, 6) AS valid FROM embeddings")
def masked_means(spark, t):
    mask = F.transform("embedding", lambda x, i: F.when(i < F.col("vec_id") % 70, 1.0).otherwise(0.0))
    r = t("embeddings").select("vec_id", K.masked_mean(F.col("embedding").cast("array<double>"), mask).alias("r"))
    return r.select("vec_id", F.round("r.mean", 6).alias("mean"), F.round("r.valid", 6).alias("valid"))


@query("SELECT d.doc_id, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM documents d JOIN embeddings e ON d.doc_id % 500 = e.vec_id")
def attached_vectors(spark, t):
    """The vectors themselves beside their rows; vectors of several sizes would fail the query."""
    sizes = t("embeddings").agg(F.countDistinct(F.size("embedding")).alias("n")).first().n
    if sizes > 1:
        raise ValueError("vectors of different sizes")
    vectors = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return t("documents").select("doc_id", (F.col("doc_id") % 500).alias("vec_id")).join(vectors, "vec_id").select("doc_id", "vector")


@query("WITH c AS (SELECT vec_id, embedding AS v, 8 + vec_id % 50 AS n FROM embeddings), o AS (SELECT *, sum(n) OVER (ORDER BY vec_id) - n AS start_at FROM c) SELECT vec_id, CAST(start_at AS BIGINT) AS start_at, round(list_sum(list_transform(v[1:n], lambda x: CAST(x AS DOUBLE))), 5) AS total FROM o")
def ragged_rows(spark, t):
    """Rows of varying length in one flat table of values, cut out again by their offsets."""
    from corpusops.operators.ranking import running_total

    rows = t("embeddings").select("vec_id", F.slice("embedding", F.lit(1), (8 + F.col("vec_id") % 50).cast("int")).alias("v")).withColumn("all", F.lit(0))
    placed = running_total(rows, ["all"], ["vec_id"], F.size("v"), "start_at", 16, key=F.floor(F.col("vec_id") / 1000000))
    flat = placed.select("start_at", F.posexplode("v").alias("i", "x")).select((F.col("start_at") + F.col("i")).alias("at"), "x")
    offsets = placed.select("vec_id", "start_at", F.size("v").alias("n"))
    cut = U.range_lookup(flat, "at", offsets.withColumn("stop_at", F.col("start_at") + F.col("n")), "start_at", "stop_at", 64)
    return cut.groupBy("vec_id", "start_at").agg(F.round(F.sum(F.col("x").cast("double")), 5).alias("total"))


@query("SELECT field FROM (SELECT unnest(['dims', 'ids', 'rows', 'status']) AS field, unnest([64, (SELECT count(*) FROM embeddings), (SELECT count(*) FROM embeddings) + 1, 1]) AS expected, unnest([max(len(embedding)), count(DISTINCT vec_id), count(*), 1]) AS found FROM embeddings) WHERE expected <> found")
def cache_identity(spark, t):
    """Fields in which a cache differs from its manifest, by one row of each compared field by field; here a row is missing."""
    found = t("embeddings").agg(F.max(F.size("embedding")).cast("bigint").alias("dims"), F.countDistinct("vec_id").alias("ids"), F.count("*").alias("rows"), F.lit(1).cast("bigint").alias("status"))
    expected = found.select(F.lit(64).cast("bigint").alias("dims"), "ids", (F.col("rows") + 1).alias("rows"), "status")
    fields = found.columns
    long = lambda d, name: d.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias(name)) for f in fields))).alias("x")).select("x.*")
    return long(expected, "expected").join(long(found, "found"), "field").where(~F.col("expected").eqNullSafe(F.col("found"))).select("field")


@query("SELECT item_id, row_number() OVER (ORDER BY item_id) AS place FROM eval_items")
def ordered_tasks(spark, t):
    """Tasks whose ids must run without a gap in their order; a gap, a repeat or a foreign task id fails the scan."""
    tasks = t("eval_items").select("item_id", "task_id")
    least, most, n, ids, named = tasks.agg(F.min("item_id"), F.max("item_id"), F.count("*"), F.countDistinct("item_id"), F.count("task_id")).first()
    if n and (most - least + 1 != n or ids != n or named != n):
        raise ValueError("task ids do not run in order")
    return tasks.select("item_id", (F.col("item_id") - F.lit(least) + 1).alias("place"))


@query("SELECT generation_id, example_id FROM generations WHERE generated_text IS NOT NULL AND eos_emitted IS NOT NULL")
def strict_log(spark, t):
    """A generation log written and read again under its contract: no blank lines, every field of its type; else the read fails."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/strict-{uuid.uuid4().hex}"
    rows = t("generations").where("generated_text is not null and eos_emitted is not null").select("generation_id", "example_id", "generated_text", "eos_emitted")
    jsonl.write_staged(rows, path, "json")
    return jsonl.read_strict(spark, path, {"generation_id": "bigint", "example_id": "bigint", "generated_text": "string", "eos_emitted": "boolean"}).select("generation_id", F.col("example_id").cast("int").alias("example_id"))


_WORD_SETS = rf"SELECT item_id, suite, list_distinct(regexp_extract_all(lower({nfkc_sql('question')}), '[a-z0-9]+(?:\.[0-9]+)?')) AS w FROM eval_items"


@query(f"WITH g AS ({_WORD_SETS}) SELECT a.item_id AS candidate, b.item_id AS reference, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM g a JOIN g b ON a.suite = 'grade_school' AND b.suite = 'competition' WHERE len(list_intersect(a.w, b.w)) >= 0.1 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))")
def exhaustive_contamination(spark, t):
    """Candidates against references one by one, for at most PAIR_LIMIT pairs: the grade-school items against the competition items of the fixed benchmark."""
    g = t("eval_items").select("item_id", "suite", F.array_distinct(T.key_words(F.col("question"))).alias("w"))
    a, b = (g.where(F.col("suite") == s).select(F.col("item_id").alias(n), F.col("w").alias(c)) for s, n, c in (("grade_school", "candidate", "x"), ("competition", "reference", "y")))
    both = U.exhaustive_pairs(a, b, F.lit(True)).withColumn("j", T.jaccard(F.col("x"), F.col("y"))).where("j >= 0.1")
    return both.select("candidate", "reference", F.round("j", 6).alias("jaccard"))


@query("SELECT row_id, source, row_number() OVER (ORDER BY source, source_index, row_id) - 1 AS position FROM prepared_rows WHERE filter_reason = '' AND source IS NOT NULL")
def ordered_concat(spark, t):
    """Sources one after the other, each in its own order, with one running index over all."""
    from corpusops.operators.ranking import ordered_index

    return ordered_index(t("prepared_rows").where("filter_reason = '' and source is not null"), ["source", "source_index", "row_id"], "position").select("row_id", "source", "position")


@query(r"SELECT lower(trim(source)) AS corpus, count(*) AS n, count(*) FILTER (filter_reason = '') AS accepted FROM prepared_rows WHERE lower(trim(source)) LIKE 'metamath%' GROUP BY 1 UNION ALL SELECT 'benchmark', count(*), count(*) FILTER (answer IS NOT NULL) FROM eval_items WHERE suite <> 'code'")
def prepared_corpora(spark, t):
    """Corpora of different shapes, each put into the prepared form by its own selection, then united."""
    form = lambda source, question, target, answer: [source.alias("corpus"), question.alias("question"), target.alias("target"), answer.alias("answer")]
    a = t("prepared_rows").where(F.lower(F.trim("source")).startswith("metamath")).select(*form(F.lower(F.trim("source")), T.question_of(F.col("input")), F.col("target"), F.when(F.col("filter_reason") == "", F.lit("ok"))))
    b = t("eval_items").where("suite <> 'code'").select(*form(F.lit("benchmark"), F.col("question"), F.col("solution"), F.col("answer")))
    return a.unionByName(b).groupBy("corpus").agg(F.count("*").alias("n"), F.count("answer").alias("accepted"))


@query()
def code_ast_lookup(spark, t):
    """Code rows whose program has the syntax tree of a benchmark solution, with the least item."""
    digest = lambda c: F.nullif(F.md5(P.canonical_ast(c)), F.md5(F.lit("")))
    refs = t("eval_items").where("suite = 'code'").select("item_id", digest(F.col("solution")).alias("tree")).where("tree is not null")
    rows = t("code_rows").select("id", digest(P.unfenced(F.col("output"))).alias("tree")).where("tree is not null")
    return rows.join(refs, "tree").groupBy("id").agg(F.min("item_id").alias("item_id"))


@query()
def syntax_rates(spark, t):
    """Shares of programs that parse as they stand and after the cleaner, and of those that it changed."""
    rows = t("code_rows").where("output is not null").select("output", P.unfenced(F.col("output")).alias("code"), P.transformer("sanitize")(F.col("output"), F.lit("")).alias("r"))
    parses = lambda c: F.round(F.avg((P.canonical_ast(c) != "").cast("int")), 6)
    return rows.agg(F.count("*").alias("n"), parses(F.col("output")).alias("as_is"), parses(F.col("code")).alias("unfenced"), parses(F.col("r.code")).alias("cleaned"), F.round(F.avg((F.col("r.code") != F.col("output")).cast("int")), 6).alias("changed"))


@query("SELECT f.final_id, g.n IS NOT DISTINCT FROM len(f.input_ids) AS aligned FROM final_rows f LEFT JOIN (SELECT split, row_index, len(input_ids) + CAST(row_index % 10 = 0 AS INT) AS n FROM final_rows WHERE row_index % 7 <> 0) g ON f.split = g.split AND f.row_index = g.row_index")
def cache_alignment(spark, t):
    """Rows beside a cache in which a seventh of them is missing and a tenth has another length: the check by row that require_aligned asserts."""
    f = t("final_rows").select("split", "row_index", "final_id", F.size("input_ids").alias("n"))
    cache = f.where("row_index % 7 <> 0").select("split", "row_index", (F.col("n") + (F.col("row_index") % 10 == 0).cast("int")).alias("m"))
    return f.join(cache, ["split", "row_index"], "left").select("final_id", F.col("n").eqNullSafe(F.col("m")).alias("aligned"))


@query("SELECT final_id, list_transform(range(0, len(condition_input_ids)), lambda i: CAST(2 + i AS INT)) AS condition, list_transform(range(0, len(input_ids)), lambda i: CAST(3 + len(condition_input_ids) + i AS INT)) AS response FROM final_rows")
def chat_positions(spark, t):
    r = K.chat_positions(2, F.col("condition_input_ids"), 1, F.col("input_ids"))
    return t("final_rows").select("final_id", r.alias("r")).select("final_id", "r.condition", "r.response")


@query("WITH c AS (SELECT x, count(*) AS n FROM (SELECT unnest(input_ids) AS x FROM final_rows) GROUP BY x), bad AS (SELECT x FROM c WHERE n < 3) SELECT final_id, count(*) AS incompatible FROM (SELECT final_id, unnest(input_ids) AS x FROM final_rows) JOIN bad USING (x) GROUP BY final_id")
def incompatible_ids(spark, t):
    """Rows that hold ids which another vocabulary does not share; here the ids that occur less than three times."""
    x = t("final_rows").select("final_id", F.explode("input_ids").alias("x"))
    bad = x.groupBy("x").agg(F.count("*").alias("n")).where("n < 3").select("x")
    return x.join(bad, "x").groupBy("final_id").agg(F.count("*").alias("incompatible"))


@query("SELECT question_key AS key FROM prepared_rows WHERE question_key <> '' UNION SELECT source_question_key FROM prepared_rows WHERE source_question_key <> ''")
def key_union(spark, t):
    p = t("prepared_rows")
    return p.select(F.col("question_key").alias("key")).union(p.select("source_question_key")).where("key <> ''").distinct()


@query("SELECT run_id, seed_no, round(100.0 * avg(CAST(coalesce(strict_correct, false) AS INT)), 9) AS base, round(100.0 * avg(CAST(coalesce(strict_correct, false) AND coalesce(strict_final_answer = trim(gold_answer), false) AS INT)), 9) AS plus FROM generations GROUP BY ALL")
def outcome_rates(spark, t):
    """Pass rates of both levels from outcomes in words; an unknown outcome, a plus without its base, or a rate that a second way of counting does not confirm fails the query."""
    right = F.coalesce("strict_correct", F.lit(False))
    words = t("generations").select("run_id", "seed_no", F.when(right, "pass").otherwise("fail").alias("base"), F.when(right & F.coalesce(F.col("strict_final_answer") == F.trim("gold_answer"), F.lit(False)), "pass").otherwise("fail").alias("plus"))
    known = F.col("base").isin("pass", "fail") & F.col("plus").isin("pass", "fail") & ((F.col("plus") == "fail") | (F.col("base") == "pass"))
    checked = words.withColumn("base", F.when(known, F.col("base")).otherwise(F.raise_error(F.lit("unknown outcome")).cast("string")))
    share = lambda c: 100 * F.avg((F.col(c) == "pass").cast("int"))
    again = lambda c: 100.0 * F.count_if(F.col(c) == "pass") / F.count("*")
    rates = checked.groupBy("run_id", "seed_no").agg(*(f(c).alias(f"{n}{c}") for c in ("base", "plus") for n, f in (("", share), ("second_", again))))
    sure = lambda c: F.when(F.abs(F.col(c) - F.col(f"second_{c}")) <= 1e-12 * 100, F.round(c, 9)).otherwise(F.raise_error(F.lit("rates differ")).cast("double"))
    return rates.select("run_id", "seed_no", sure("base").alias("base"), sure("plus").alias("plus"))


@query("SELECT run_id, seed_no, count(*) AS rows FROM (SELECT DISTINCT run_id, seed_no, example_id FROM generations) GROUP BY ALL HAVING count(*) = max(example_id) + 1 AND min(example_id) = 0")
def complete_merges(spark, t):
    """Runs whose merged shards hold the ids 0, 1, 2 and so on without a gap; the merge of exactly these passes require_sequence."""
    once = t("generations").select("run_id", "seed_no", "example_id").distinct()
    whole = once.groupBy("run_id", "seed_no").agg(F.count("*").alias("rows"), F.max("example_id").alias("last"), F.min("example_id").alias("first")).where("rows = last + 1 and first = 0")
    R.require_sequence(once.join(whole, ["run_id", "seed_no"], "left_semi"), ["run_id", "seed_no"], "example_id")
    return whole.select("run_id", "seed_no", "rows")


@query("SELECT collection_id AS path, min(doc_id) AS first_seen, bool_and(collected_at IS NOT NULL) AS complete FROM documents WHERE collection_id IS NOT NULL GROUP BY 1")
def staging_completeness(spark, t):
    """Referenced folders by first mention, and whether all that they hold has arrived."""
    d = t("documents").where("collection_id is not null").groupBy(F.col("collection_id").alias("path"))
    return d.agg(F.min("doc_id").alias("first_seen"), F.bool_and(F.col("collected_at").isNotNull()).alias("complete"))


@query("SELECT item_id FROM eval_items WHERE suite = 'code'")
def validated_release(spark, t):
    """The code tasks as a release: their number, unique ids with their prefix and complete columns are checked before a row is read."""
    tasks = t("eval_items").where("suite = 'code'")
    prefix = tasks.agg(F.min("task_id")).first()[0] or ""
    common = prefix[: next((i for i, c in enumerate(prefix) if not c.isalpha()), len(prefix))]
    return U.require_release(tasks, tasks.count(), "task_id", common, ["question", "solution"]).select("item_id")
