"""Queries of the evaluation statistics, code operators and run checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusops.functions import answers as A
from corpusops.functions import code as P
from corpusops.functions.stem import stems
from corpusops.operators import metrics as M
from corpusops.operators import runs as R
from corpusops.plans.registry import query
from corpusops.runtime import ensure_checkpoint_dir
from corpusops.sources import jsonl

_STRICT = rf"CASE WHEN regexp_extract(list_extract(string_split(generated_text, '####'), -1), '^ ({A.NUMBER})', 1) <> '' AND contains(generated_text, '####') AND NOT regexp_matches(substr(list_extract(string_split(generated_text, '####'), -1), length(regexp_extract(list_extract(string_split(generated_text, '####'), -1), '^ ({A.NUMBER})', 1)) + 2), '^[0-9,./]') THEN replace(regexp_extract(list_extract(string_split(generated_text, '####'), -1), '^ ({A.NUMBER})', 1), ',', '') END"


@query(f"""
SELECT run_id, count(*) AS n, count(*) FILTER (s = trim(gold_answer)) AS correct, count(*) FILTER (s IS NULL) AS invalid, round(100.0 * count(*) FILTER (s = trim(gold_answer)) / count(*), 6) AS accuracy,
round(avg(CAST(eos_emitted AS INT)), 6) AS eos_rate, round(avg(response_length), 6) AS mean_length, round(quantile_cont(response_length, 0.5), 6) AS median_length, round(quantile_cont(response_length, 0.95), 6) AS p95_length FROM (SELECT *, {_STRICT} AS s FROM generations) GROUP BY run_id""")
def answer_accuracy(spark, t):
    g = t("generations").withColumn("s", A.strict_answer(F.col("generated_text")))
    right = F.coalesce(A.same_number(F.col("s"), F.col("gold_answer")), F.lit(False))
    return g.groupBy("run_id").agg(
        F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if(F.col("s").isNull()).alias("invalid"), F.round(100 * M.rate(F.count_if(right), F.count("*")), 6).alias("accuracy"),
        F.round(F.avg(F.col("eos_emitted").cast("int")), 6).alias("eos_rate"), F.round(F.avg("response_length"), 6).alias("mean_length"), F.round(F.percentile("response_length", F.lit(0.5)), 6).alias("median_length"), F.round(F.percentile("response_length", F.lit(0.95)), 6).alias("p95_length"),
    )


@query("SELECT count(*) AS seeds, round(avg(p), 6) AS pass_at_1, round(stddev_samp(p), 6) AS sd FROM (SELECT seed_no, 100.0 * avg(CAST(coalesce(strict_correct, false) AS INT)) AS p FROM generations GROUP BY seed_no)")
def pass_at_1_by_seed(spark, t):
    return M.pass_at_1(t("generations"), [], "seed_no", "strict_correct").select("seeds", F.round("pass_at_1", 6).alias("pass_at_1"), F.round("sd", 6).alias("sd"))


@query("""
WITH p AS (SELECT example_id, count(*) AS n, count(*) FILTER (strict_correct) AS c FROM generations GROUP BY 1), e AS (SELECT *, unnest(range(1, n + 1)) AS k FROM p)
SELECT CAST(k AS INT) AS k, count(*) AS questions, round(100 * avg(1 - CASE WHEN k > n - c THEN 0.0 ELSE list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i)) END), 6) AS pass_at_k FROM (SELECT k, n, c FROM e) GROUP BY k""".replace("list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i))", "coalesce(list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(n - c + 1, n + 1), lambda i: 1 - k / i)), lambda a, b: a * b), 1.0)"))
def subset_pass_at_k(spark, t):
    return M.subset_pass_at_k(t("generations"), [], "example_id", "strict_correct").select("k", "questions", F.round("pass_at_k", 6).alias("pass_at_k"))


@query("SELECT run_id, seed_no, count(*) AS n, round(100.0 * count(*) FILTER (strict_correct) / count(*), 6) AS strict, count(*) FILTER (strict_correct IS NULL) AS unjudged FROM generations GROUP BY ALL")
def accuracy_report(spark, t):
    g = t("generations").groupBy("run_id", "seed_no")
    return g.agg(F.count("*").alias("n"), F.round(100 * M.rate(F.count_if(F.coalesce("strict_correct", F.lit(False))), F.count("*")), 6).alias("strict"), F.count_if(F.col("strict_correct").isNull()).alias("unjudged"))


@query("SELECT generation_id, base, base AND extra AS plus FROM (SELECT generation_id, coalesce(strict_correct, false) AS base, coalesce(eos_emitted, false) AS extra FROM generations)")
def outcomes_base_plus(spark, t):
    base = F.coalesce("strict_correct", F.lit(False))
    return t("generations").select("generation_id", base.alias("base"), (base & F.coalesce("eos_emitted", F.lit(False))).alias("plus"))


@query("SELECT run_id, count(*) AS n, count(DISTINCT example_id) AS examples, min(example_id) AS first_id, max(example_id) AS last_id, count(DISTINCT seed_no) = 1 AS one_seed, count(*) = count(DISTINCT example_id) AND max(example_id) = count(*) - 1 AS complete FROM generations GROUP BY run_id")
def generation_integrity(spark, t):
    n, d = F.count("*"), F.countDistinct("example_id")
    return t("generations").groupBy("run_id").agg(
        n.alias("n"), d.alias("examples"), F.min("example_id").alias("first_id"), F.max("example_id").alias("last_id"), (F.countDistinct("seed_no") == 1).alias("one_seed"), ((n == d) & (F.max("example_id") == n - 1)).alias("complete")
    )


@query("SELECT run_id, seed_no, example_id, count(*) AS n FROM generations GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, t):
    return t("generations").groupBy("run_id", "seed_no", "example_id").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT example_id AS id, 'left' AS side FROM (SELECT example_id FROM generations EXCEPT SELECT row_index FROM final_rows WHERE split = 'test') UNION ALL SELECT row_index, 'right' FROM (SELECT row_index FROM final_rows WHERE split = 'test' EXCEPT SELECT example_id FROM generations)")
def benchmark_inference(spark, t):
    return R.set_difference(t("generations").select(F.col("example_id").alias("id")), t("final_rows").where("split = 'test'").select(F.col("row_index").alias("id")), "id")


@query("SELECT user_id, \"after\", event_id AS found FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS \"after\" FROM events) WHERE \"after\" IS NOT NULL AND event_id <> \"after\" + 1")
def sequence_gaps(spark, t):
    return R.sequence_gaps(t("events"), ["user_id"], "event_id")


@query("SELECT run_id, seed_no, min(example_id) AS example_id FROM generations WHERE (run_id, seed_no) NOT IN (SELECT run_id, seed_no FROM generations WHERE example_id % 5 = 0) GROUP BY ALL")
def metrics_append_once(spark, t):
    g = t("generations").groupBy("run_id", "seed_no").agg(F.min("example_id").alias("example_id"))
    return R.append_once(t("generations").where("example_id % 5 = 0"), g, ["run_id", "seed_no"])


@query("SELECT generation_id, example_id, generated_text FROM generations WHERE generated_text IS NOT NULL")
def jsonl_roundtrip(spark, t):
    """Writes an evaluation log of several shards into the shared folder and reads it by physical lines."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    rows = t("generations").where("generated_text is not null").select("generation_id", "example_id", "generated_text")
    jsonl.write_new(rows.repartition(3, "generation_id"), path, "json")
    return jsonl.read_log(spark, path, "generation_id bigint, example_id int, generated_text string")


def _words_sql(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


_PAIRS = f"""p AS (SELECT source, source_index, arg_max_null(target, row_id) AS target FROM prepared_rows GROUP BY ALL),
x AS (SELECT final_id, {_words_sql('f.target')} AS r, {_words_sql("regexp_replace(p.target, '[aeiou]t', '', 'g')")} AS h FROM final_rows f JOIN p USING (source, source_index))"""


def _pairs(t):
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    f = t("final_rows").select("source", "source_index", "final_id", words(F.col("target")).alias("r"))
    p = t("prepared_rows").groupBy("source", "source_index").agg(F.max_by("target", "row_id").alias("target"))
    return f.join(p, ["source", "source_index"]).select("final_id", "r", words(F.regexp_replace("target", "[aeiou]t", "")).alias("h"))


@query(f"""WITH {_PAIRS}, o AS (SELECT unnest(range(1, 5)) AS n),
hg AS (SELECT final_id, n, g, count(*) AS m FROM (SELECT final_id, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i+n-1], ' '))) AS g FROM x, o WHERE len(h) >= n) GROUP BY ALL),
rg AS (SELECT final_id, n, g, count(*) AS m FROM (SELECT final_id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i+n-1], ' '))) AS g FROM x, o WHERE len(r) >= n) GROUP BY ALL),
s AS (SELECT n, sum(least(hg.m, coalesce(rg.m, 0))) AS hit, sum(hg.m) AS total FROM hg LEFT JOIN rg USING (final_id, n, g) GROUP BY n), l AS (SELECT sum(len(h)) AS h, sum(len(r)) AS r FROM x), b AS (SELECT CASE WHEN h >= r THEN 1.0 ELSE exp(1 - r / h) END AS brevity FROM l)
SELECT round(CASE WHEN (SELECT min(hit) FROM s) > 0 THEN 100 * brevity * (SELECT exp(avg(ln(hit / total))) FROM s) ELSE 0.0 END, 4) AS bleu, round(brevity, 6) AS brevity FROM b""")
def corpus_bleu(spark, t):
    return M.corpus_bleu(_pairs(t), "final_id", "h", "r").select(F.round("bleu", 4).alias("bleu"), F.round("brevity", 6).alias("brevity"))


def _rouge(p):
    one, two = (M.rouge_n(p, "final_id", "h", "r", n).withColumnRenamed("f1", f"rouge{n}") for n in (1, 2))
    return p.select("final_id", M.rouge_l(F.col("h"), F.col("r")).alias("rougeL")).join(one, "final_id").join(two, "final_id")


@query(f"""WITH {_PAIRS}, hg AS (SELECT final_id, g, count(*) AS m FROM (SELECT final_id, unnest(h) AS g FROM x) GROUP BY ALL), rg AS (SELECT final_id, g, count(*) AS m FROM (SELECT final_id, unnest(r) AS g FROM x) GROUP BY ALL),
s AS (SELECT final_id, sum(least(hg.m, rg.m)) AS hit FROM hg JOIN rg USING (final_id, g) GROUP BY final_id)
SELECT final_id, round(CASE WHEN len(h) + len(r) > 0 THEN 200.0 * coalesce(hit, 0) / (len(h) + len(r)) ELSE 0.0 END, 6) AS rouge1 FROM x LEFT JOIN s USING (final_id)""")
def rouge_unstemmed(spark, t):
    """ROUGE-1 of the words as they stand, which SQL can repeat."""
    return M.rouge_n(_pairs(t), "final_id", "h", "r", 1).select("final_id", F.round("f1", 6).alias("rouge1"))


@query()
def rouge_scores(spark, t):
    """ROUGE-1, -2 and -L of stemmed words."""
    scored = _rouge(_pairs(t).select("final_id", stems("h").alias("h"), stems("r").alias("r")))
    return scored.select("final_id", *(F.round(c, 6).alias(c) for c in ("rouge1", "rouge2", "rougeL")))


@query()
def rouge_summary(spark, t):
    """Mean, deviation and standard error of the scores over all pairs."""
    scored = _rouge(_pairs(t).select("final_id", stems("h").alias("h"), stems("r").alias("r")))
    long = scored.select(F.explode(F.array(*(F.struct(F.lit(c).alias("score"), F.col(c).alias("x")) for c in ("rouge1", "rouge2", "rougeL")))).alias("s")).select("s.*")
    return long.groupBy("score").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"), F.round(F.stddev_pop("x") / F.sqrt(F.count("*")), 6).alias("sem"))


@query("WITH c AS (SELECT final_id, x, count(*) AS m FROM (SELECT final_id, unnest(input_ids) AS x FROM final_rows) GROUP BY ALL), p AS (SELECT final_id, m / sum(m) OVER (PARTITION BY final_id) AS p FROM c) SELECT final_id, round(sum(-p * ln(p + 1e-10)), 6) AS entropy FROM p GROUP BY final_id")
def token_entropy(spark, t):
    return M.token_entropy(t("final_rows"), "final_id", "input_ids").select("final_id", F.round("entropy", 6).alias("entropy"))


@query("SELECT event_type, round(exp(sum(abs(value) * (1 + event_id % 3) / 100.0) / sum(1 + event_id % 3)), 6) AS perplexity FROM events GROUP BY event_type")
def weighted_perplexity(spark, t):
    w = 1 + F.col("event_id") % 3
    return M.weighted_perplexity(t("events"), ["event_type"], F.abs("value") * w / 100.0, w).select("event_type", F.round("perplexity", 6).alias("perplexity"))


@query("SELECT label, CAST(i AS INT) AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(stddev_pop(x) / sqrt(count(*)), 6) AS sem, round(quantile_cont(x, 0.5), 6) AS median FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings) GROUP BY ALL")
def mean_sd_sem(spark, t):
    x = t("embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    return x.groupBy("label", "dim").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"), F.round(F.stddev_pop("x") / F.sqrt(F.count("*")), 6).alias("sem"), F.round(F.percentile("x", F.lit(0.5)), 6).alias("median"))


@query("SELECT coalesce(u.token, v.token) AS token, u.id AS left_id, v.id AS right_id FROM (SELECT source_subtype AS token, count(*) AS id FROM prepared_rows WHERE source_subtype IS NOT NULL GROUP BY 1) u FULL JOIN (SELECT source_subtype AS token, count(*) AS id FROM final_rows WHERE source_subtype IS NOT NULL GROUP BY 1) v ON u.token = v.token WHERE u.id IS DISTINCT FROM v.id ORDER BY token LIMIT 10")
def vocabulary_mismatches(spark, t):
    """The first ten entries that one of two dictionaries lacks or has with another value."""
    u, v = (t(n).where("source_subtype is not null").groupBy(F.col("source_subtype").alias("token")).agg(F.count("*").alias(c)) for n, c in (("prepared_rows", "left_id"), ("final_rows", "right_id")))
    return u.join(v, "token", "full").where(~F.col("left_id").eqNullSafe(F.col("right_id"))).orderBy("token").limit(10)


@query("SELECT id, sha256(coalesce(output, '')) AS digest FROM code_rows")
def text_digests(spark, t):
    return t("code_rows").select("id", F.sha2(F.coalesce("output", F.lit("")), 256).alias("digest"))


@query()
def code_syntax(spark, t):
    code = t("code_rows").select("id", "output", P.unfenced(F.col("output")).alias("code"))
    return code.select("id", P.code_problem(F.col("code"), F.col("output")).alias("problem"), F.md5(P.canonical_ast(F.col("code"))).alias("ast_digest"), F.size(P.module_bindings(F.col("code"))).alias("bindings"))


@query()
def code_entry_points(spark, t):
    code = t("code_rows").select("id", P.unfenced(F.col("output")).alias("code"), F.try_element_at(F.from_json("unit_tests", "array<string>"), F.lit(1)).alias("call"))
    named = code.select("id", "code", P.entry_point(F.col("code"), F.col("call")).alias("entry"), F.size(P.text_variants(F.col("code"))).alias("variants"))
    return named.select("id", "entry", "variants", P.with_alias(F.col("code"), F.lit("solution")).alias("a")).select("id", "entry", "variants", F.col("a.changed").alias("aliased"))


@query()
def tex_alignment_and_seeds(spark, t):
    """Alignment faults of whole solutions of the benchmark and of targets, with a seed from each row's key."""
    both = t("eval_items").select(F.concat(F.lit("item|"), F.col("item_id").cast("string")).alias("key"), F.col("solution").alias("v")).unionByName(
        t("prepared_rows").select(F.concat(F.lit("row|"), F.col("row_id").cast("string")).alias("key"), F.col("target").alias("v"))
    )
    return both.select("key", P.tex_alignment(F.col("v")).alias("fault"), P.stable_seed(F.col("key")).alias("seed"))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def json_value_counts(spark, t):
    return t("events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))
