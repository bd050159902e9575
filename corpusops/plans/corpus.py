"""Queries of the curation operators: preparation, counts, deduplication, similarity, groups, splits, batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusops.functions import answers as A
from corpusops.functions import text as T
from corpusops.operators import curate as U
from corpusops.operators import similarity as S
from corpusops.operators.graph import connected_components
from corpusops.operators.ranking import ordered_index
from corpusops.plans.registry import nfkc_sql, query
from corpusops.runtime import written

_PREPARED = """
WITH b AS (SELECT row_id, source, CASE WHEN question_key = '' THEN NULL ELSE question_key END AS k, target, gold_answer, input FROM prepared_rows),
p AS (SELECT *, CASE WHEN k IS NULL THEN 'missing_question' WHEN target IS NULL THEN 'missing_solution' WHEN trim(coalesce(gold_answer, '')) = '' THEN 'missing_answer'
 WHEN regexp_full_match(gold_answer, '[+-]?(?:(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\\.[0-9]+)?|\\.[0-9]+)') THEN '' WHEN regexp_full_match(gold_answer, '[+-]?[0-9]+\\s*/\\s*0+') THEN 'zero_fraction_denominator'
 WHEN regexp_full_match(gold_answer, '[+-]?[0-9]+\\s*/\\s*[0-9]+') THEN '' ELSE 'unsupported_answer' END AS reason FROM b)
"""


def _prepared(t):
    rows = t("prepared_rows").select("row_id", "source", F.nullif("question_key", F.lit("")).alias("k"), "target", "gold_answer", "input")
    reason = U.first_reason(
        F.when(F.col("k").isNull(), "missing_question"), F.when(F.col("target").isNull(), "missing_solution"), F.nullif(A.numeric_answer(F.coalesce("gold_answer", F.lit("")))["reason"], F.lit(""))
    )
    return rows.withColumn("reason", reason)


@query(_PREPARED + "SELECT row_id, reason, CASE WHEN reason = 'missing_question' THEN '' ELSE input END AS prompt, CASE WHEN reason = '' THEN target ELSE '' END AS target FROM p")
def prepare_with_reasons(spark, t):
    p = _prepared(t)
    return p.select("row_id", "reason", F.when(F.col("reason") == "missing_question", "").otherwise(F.col("input")).alias("prompt"), F.when(F.col("reason") == "", F.col("target")).otherwise("").alias("target"))


@query(_PREPARED + "SELECT reason, count(*) AS n FROM p GROUP BY reason")
def reason_counts(spark, t):
    return _prepared(t).groupBy("reason").agg(F.count("*").alias("n"))


@query(_PREPARED + "SELECT row_id, source, reason, 'structure' AS stage FROM p WHERE reason <> '' UNION ALL SELECT row_id, source, 'response_too_long', 'length' FROM p WHERE reason = '' AND length(target) > 400")
def rejected_rows(spark, t):
    p = _prepared(t)
    return U.rejections(p.where("reason <> ''").select("row_id", "source", "reason"), "structure").unionByName(
        U.rejections(p.where("reason = '' and length(target) > 400").select("row_id", "source", F.lit("response_too_long").alias("reason")), "length")
    )


@query("SELECT row_id FROM prepared_rows WHERE source_subtype IN ('gsm8k', 'augmented_gsm8k') OR starts_with(source_subtype, 'GSM')")
def source_filters(spark, t):
    s = F.col("source_subtype")
    return t("prepared_rows").where(s.isin("gsm8k", "augmented_gsm8k") | s.startswith("GSM")).select("row_id")


@query("SELECT row_id, coalesce(nullif(source_question_key, ''), nullif(question_key, '')) AS source_key FROM prepared_rows")
def source_question_fallback(spark, t):
    return t("prepared_rows").select("row_id", F.coalesce(F.nullif("source_question_key", F.lit("")), F.nullif("question_key", F.lit(""))).alias("source_key"))


@query("SELECT source_subtype, count(*) AS n FROM prepared_rows GROUP BY 1")
def value_counts(spark, t):
    return t("prepared_rows").groupBy("source_subtype").agg(F.count("*").alias("n"))


@query("SELECT lower(trim(source)) AS source, count(*) AS n, count(*) FILTER (filter_reason = '') AS accepted, count(*) FILTER (filter_reason <> '') AS rejected, count(DISTINCT nullif(filter_reason, '')) AS reasons FROM prepared_rows GROUP BY 1")
def source_summary(spark, t):
    by_source = t("prepared_rows").groupBy(F.lower(F.trim("source")).alias("source"))
    return by_source.agg(
        F.count("*").alias("n"), F.count_if(F.col("filter_reason") == "").alias("accepted"), F.count_if(F.col("filter_reason") != "").alias("rejected"), F.countDistinct(F.nullif("filter_reason", F.lit(""))).alias("reasons")
    )


@query("""
WITH p AS (SELECT lower(trim(source)) AS source, count(*) AS n, count(DISTINCT question_key) AS q, count(DISTINCT source_question_key) AS sq FROM prepared_rows GROUP BY 1)
SELECT source, n, q AS questions, sq AS source_questions, round(n / sum(n) OVER (), 9) AS row_share, round(q / sum(q) OVER (), 9) AS question_share, round(sq / sum(sq) OVER (), 9) AS source_question_share FROM p""")
def source_composition(spark, t):
    return U.composition(t("prepared_rows").withColumn("source", F.lower(F.trim("source"))), "source", "question_key", "source_question_key")


@query("SELECT question_key, list(DISTINCT gold_answer ORDER BY gold_answer) AS answers, count(*) AS n FROM prepared_rows WHERE filter_reason = '' AND question_key IS NOT NULL AND gold_answer IS NOT NULL GROUP BY 1 HAVING count(DISTINCT gold_answer) > 1")
def conflicting_answers(spark, t):
    return U.conflicts(t("prepared_rows").where("filter_reason = ''"), "question_key", "gold_answer")


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY question_key ORDER BY row_id) AS rn FROM prepared_rows WHERE filter_reason = '' AND question_key IS NOT NULL) WHERE rn = 1")
def dedup_keep_first(spark, t):
    return U.keep_first(t("prepared_rows").where("filter_reason = ''"), ["question_key"], ["row_id"]).select("row_id")


@query("SELECT source, n, kept, n - kept AS removed FROM (SELECT lower(trim(source)) AS source, count(*) AS n, count(*) FILTER (rn = 1) AS kept FROM (SELECT source, row_number() OVER (PARTITION BY source_index, lower(trim(source)) ORDER BY ingested_at DESC, row_id) AS rn FROM prepared_rows) GROUP BY 1)")
def latest_arrivals(spark, t):
    df = t("prepared_rows").withColumn("src", F.lower(F.trim("source")))
    kept = df.groupBy("src", "source_index").agg(F.max_by("row_id", F.struct("ingested_at", -F.col("row_id"))).alias("row_id"), F.count("*").alias("n"))
    return kept.groupBy(F.col("src").alias("source")).agg(F.sum("n").alias("n"), F.count("*").alias("kept"), (F.sum("n") - F.count("*")).alias("removed"))


@query("SELECT problem_group_id, min(final_id) AS final_id FROM final_rows WHERE split = 'train' AND problem_group_id IS NOT NULL GROUP BY 1")
def one_row_per_group(spark, t):
    return U.keep_first(t("final_rows").where("split = 'train'"), ["problem_group_id"], ["final_id"]).select("problem_group_id", "final_id")


@query("SELECT final_id, row_number() OVER (ORDER BY source, source_index, final_id) - 1 AS position FROM final_rows")
def contiguous_index(spark, t):
    return ordered_index(t("final_rows").select("final_id", "source", "source_index"), ["source", "source_index", "final_id"], "position").select("final_id", "position")


@query("SELECT split, min(len(input_ids)) AS least, max(len(input_ids)) AS most, round(avg(len(input_ids)), 6) AS mean, count(*) FILTER (len(input_ids) > 100) AS long_responses FROM final_rows GROUP BY split")
def token_stats_minmax(spark, t):
    n = F.size("input_ids")
    return t("final_rows").groupBy("split").agg(F.min(n).cast("bigint").alias("least"), F.max(n).cast("bigint").alias("most"), F.round(F.avg(n), 6).alias("mean"), F.count_if(n > 100).alias("long_responses"))


@query("SELECT split, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99, max(x) AS most FROM (SELECT split, len(condition_input_ids) + len(input_ids) AS x FROM final_rows) GROUP BY split")
def token_stats_percentiles(spark, t):
    n = F.size("condition_input_ids") + F.size("input_ids")
    q = {f"p{round(100 * p)}": F.round(F.percentile(n, F.lit(p)), 6) for p in (0.5, 0.9, 0.95, 0.99)}
    return t("final_rows").groupBy("split").agg(F.round(F.avg(n), 6).alias("mean"), *(v.alias(k) for k, v in q.items()), F.max(n).cast("bigint").alias("most"))


_SCORE = "CAST(json_extract(llm_judgement, '$.{}.score') AS INT)"
_FIELDS = ("requirement_conformance", "logical_correctness", "edge_case_consideration")


@query("SELECT array_to_string([" + ", ".join(f"json_extract_string(llm_judgement, '$.{f}.score')" for f in _FIELDS) + "], '/') AS scores, average_test_score AS test_score, count(*) AS n FROM code_rows WHERE llm_judgement IS NOT NULL GROUP BY ALL")
def judge_and_score_histogram(spark, t):
    scores = F.array_join(F.array(*(F.get_json_object("llm_judgement", f"$.{f}.score") for f in _FIELDS)), "/")
    return t("code_rows").where("llm_judgement is not null").groupBy(scores.alias("scores"), F.format_string("%.1f", F.col("average_test_score").cast("float")).alias("test_score")).agg(F.count("*").alias("n"))


@query("""SELECT id, CASE WHEN llm_judgement IS NULL THEN 'missing_metadata' WHEN least(""" + ", ".join(_SCORE.format(f) for f in _FIELDS) + """) < 4 THEN 'judge_score_below_4'
WHEN len(list_filter(CAST(tests_execution_status AS VARCHAR[]), lambda x: x = 'pass')) <> CAST(average_test_score AS DOUBLE) * 10 THEN 'inconsistent_average_test_score' ELSE '' END AS reason FROM code_rows""")
def quality_json_gate(spark, t):
    return t("code_rows").select("id", U.quality_reason("llm_judgement", "unit_tests", "tests_execution_status", "average_test_score").alias("reason"))


_EVAL_KEY = r"array_to_string(regexp_extract_all(lower(question), '[a-z0-9]+(?:\.[0-9]+)?'), ' ')"


def _gram_sql(col: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({col}) - {n - 2}, 1)), lambda i: array_to_string({col}[i:i+{n - 1}], ' ')))"


def _jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


@query(f"""
WITH k AS (SELECT DISTINCT question_key AS key FROM prepared_rows WHERE question_key <> ''),
w AS (SELECT key, string_split(key, ' ') AS w FROM k), g AS (SELECT key, {_gram_sql('w', 5)} AS g5, {_gram_sql('w', 8)} AS g8 FROM w),
e AS (SELECT key, unnest(g5) AS x FROM g), n AS (SELECT DISTINCT least(a.key, b.key) AS l, greatest(a.key, b.key) AS r FROM k a JOIN k b ON contains(b.key, a.key) AND a.key <> b.key AND length(a.key) >= 0.9 * length(b.key)),
c AS (SELECT DISTINCT a.key AS l, b.key AS r FROM e a JOIN e b ON a.x = b.x WHERE a.key < b.key UNION SELECT l, r FROM n),
s AS (SELECT l, r, CASE WHEN contains(r, l) OR contains(l, r) THEN least(length(l), length(r)) / greatest(length(l), length(r)) ELSE 0.0 END AS cover, {_jaccard_sql('p.g5', 'q.g5')} AS j5, {_jaccard_sql('p.g8', 'q.g8')} AS j8 FROM c JOIN g p ON p.key = l JOIN g q ON q.key = r)
SELECT l AS "left", r AS "right", CASE WHEN cover >= 0.9 THEN 'substring' WHEN j5 >= 0.55 THEN 'word_5gram' ELSE 'word_8gram' END AS reason, round(cover, 6) AS coverage, round(j5, 6) AS five, round(j8, 6) AS eight FROM s WHERE cover >= 0.9 OR j5 >= 0.55 OR j8 >= 0.4""")
def similar_question_pairs(spark, t):
    p = S.similar_pairs(t("prepared_rows"), "question_key", 0.90)
    return p.select("left", "right", "reason", F.round("substring_coverage", 6).alias("coverage"), F.round("word_5gram_jaccard", 6).alias("five"), F.round("word_8gram_jaccard", 6).alias("eight"))


@query(f"""
WITH k AS (SELECT item_id, string_split({_EVAL_KEY}, ' ') AS w FROM eval_items), g AS (SELECT item_id, {_gram_sql('w', 5)} AS g5 FROM k)
SELECT a.item_id AS a, b.item_id AS b, round({_jaccard_sql('a.g5', 'b.g5')}, 6) AS five FROM g a JOIN g b ON a.item_id < b.item_id WHERE len(list_intersect(a.g5, b.g5)) > 0""")
def pair_similarity_exhaustive(spark, t):
    """The exhaustive pair mode, for tables of at most PAIR_LIMIT pairs; the benchmark's items are such a stated set."""
    words = t("eval_items").select("item_id", T.key_words(F.col("question")).alias("w"))
    g = words.select("item_id", T.word_ngrams(F.col("w"), 5).alias("g5"))
    a, b = g.select(F.col("item_id").alias("a"), F.col("g5").alias("x")), g.select(F.col("item_id").alias("b"), F.col("g5").alias("y"))
    return U.exhaustive_pairs(a, b, F.col("a") < F.col("b")).where(F.arrays_overlap("x", "y")).select("a", "b", F.round(T.jaccard(F.col("x"), F.col("y")), 6).alias("five"))


def _references(t):
    return t("eval_items").select("item_id", T.question_key(F.col("question")).alias("key"))


_MATCH = f"""
k AS (SELECT DISTINCT question_key AS key FROM prepared_rows WHERE question_key <> ''), r AS (SELECT DISTINCT {_EVAL_KEY} AS key FROM eval_items),
gk AS (SELECT key, {_gram_sql('w', 5)} AS g5, {_gram_sql('w', 8)} AS g8 FROM (SELECT key, string_split(key, ' ') AS w FROM k)), gr AS (SELECT key, {_gram_sql('w', 5)} AS g5, {_gram_sql('w', 8)} AS g8 FROM (SELECT key, string_split(key, ' ') AS w FROM r)),
c AS (SELECT DISTINCT a.key AS l, b.key AS r FROM (SELECT key, unnest(g5) AS x FROM gk) a JOIN (SELECT key, unnest(g5) AS x FROM gr) b USING (x)),
s AS (SELECT l, r, CASE WHEN l = r THEN 1.0 WHEN contains(r, l) OR contains(l, r) THEN least(length(l), length(r)) / greatest(length(l), length(r)) ELSE 0.0 END AS cover, {_jaccard_sql('p.g5', 'q.g5')} AS j5, {_jaccard_sql('p.g8', 'q.g8')} AS j8 FROM c JOIN gk p ON p.key = l JOIN gr q ON q.key = c.r),
m AS (SELECT l AS candidate, r AS reference, CASE WHEN l = r THEN 'exact' WHEN cover >= 0.85 THEN 'substring' WHEN j5 >= 0.55 THEN 'word_5gram' ELSE 'word_8gram' END AS reason FROM s WHERE cover >= 0.85 OR j5 >= 0.55 OR j8 >= 0.4)"""


@query(f"WITH {_MATCH} SELECT * FROM m")
def contamination_matches(spark, t):
    return S.contamination_matches(t("prepared_rows"), "question_key", _references(t), "key", 0.85).select("candidate", "reference", "reason")


_LINES = rf"SELECT DISTINCT array_to_string(regexp_extract_all(lower({nfkc_sql('line')}), '[a-z0-9]+(?:\.[0-9]+)?'), ' ') AS key FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


@query("WITH " + _MATCH.replace("SELECT DISTINCT question_key AS key FROM prepared_rows WHERE question_key <> ''", f"SELECT key FROM ({_LINES}) WHERE key <> ''") + " SELECT * FROM m")
def contamination_document_lines(spark, t):
    """Lines of documents that match a benchmark question; whole documents hardly ever reach a Jaccard threshold."""
    lines = t("documents").where("text is not null").select(F.explode(F.split("text", "\n")).alias("line"))
    keys = lines.select(T.question_key(F.col("line")).alias("key"))
    return S.contamination_matches(keys, "key", _references(t), "key", 0.85).select("candidate", "reference", "reason")


@query(f"WITH {_MATCH} SELECT m.candidate, m.reference, m.reason, count(p.row_id) AS affected_rows FROM m LEFT JOIN prepared_rows p ON p.question_key = m.candidate GROUP BY ALL")
def contamination_enriched(spark, t):
    m = S.contamination_matches(t("prepared_rows"), "question_key", _references(t), "key", 0.85).select("candidate", "reference", "reason")
    n = t("prepared_rows").groupBy(F.col("question_key").alias("candidate")).agg(F.count("*").alias("affected_rows"))
    return m.join(n, "candidate", "left").withColumn("affected_rows", F.coalesce("affected_rows", F.lit(0)).cast("bigint"))


@query(f"""
WITH e AS (SELECT item_id, string_split({_EVAL_KEY}, ' ') AS w FROM eval_items), p AS (SELECT row_id, string_split(question_key, ' ') AS w FROM prepared_rows WHERE question_key <> ''),
ge AS (SELECT item_id, {_gram_sql('w', 8)} AS g FROM e), gp AS (SELECT row_id, {_gram_sql('w', 8)} AS g FROM p),
c AS (SELECT DISTINCT row_id, item_id FROM (SELECT row_id, unnest(g) AS x FROM gp) JOIN (SELECT item_id, unnest(g) AS x FROM ge) USING (x)),
s AS (SELECT row_id, item_id, {_jaccard_sql('gp.g', 'ge.g')} AS j, list_min(list_intersect(gp.g, ge.g)) AS evidence FROM c JOIN gp USING (row_id) JOIN ge USING (item_id))
SELECT row_id, arg_min(item_id, item_id) AS item_id, round(arg_min(j, item_id), 6) AS jaccard, arg_min(evidence, item_id) AS evidence FROM s WHERE j >= 0.5 GROUP BY row_id""")
def contamination_8gram(spark, t):
    rows = t("prepared_rows").where("question_key <> ''").select("row_id", "question_key")
    return S.gram_contamination(rows, "row_id", "question_key", _references(t), "item_id", "key").select(F.col("id").alias("row_id"), F.col("task_id").alias("item_id"), F.round("jaccard", 6).alias("jaccard"), "evidence")


@query(f"SELECT p.row_id, min(e.task_id) AS task_id FROM prepared_rows p JOIN eval_items e ON p.question_key = {_EVAL_KEY} GROUP BY 1")
def contamination_exact_lookup(spark, t):
    refs = t("eval_items").select("task_id", T.question_key(F.col("question")).alias("question_key"))
    return t("prepared_rows").select("row_id", "question_key").join(refs, "question_key").groupBy("row_id").agg(F.min("task_id").alias("task_id"))


_LINKS = "SELECT DISTINCT question_key AS u, source_question_key AS v FROM prepared_rows WHERE source <> '' AND question_key <> '' AND source_question_key <> '' AND filter_reason = ''"


@query(_LINKS)
def linked_pairs(spark, t):
    return U.linked_pairs(t("prepared_rows").where("source <> '' and filter_reason = ''"), "question_key", "source_question_key").select("u", "v")


_GROUPS = f"""
links AS ({_LINKS}), k AS (SELECT u AS key FROM links UNION SELECT v FROM links),
w AS (SELECT key, string_split(key, ' ') AS w FROM k), g AS (SELECT key, {_gram_sql('w', 5)} AS g5, {_gram_sql('w', 8)} AS g8 FROM w), e5 AS (SELECT key, unnest(g5) AS x FROM g),
c AS (SELECT DISTINCT a.key AS l, b.key AS r FROM e5 a JOIN e5 b ON a.x = b.x WHERE a.key < b.key UNION SELECT least(a.key, b.key), greatest(a.key, b.key) FROM k a JOIN k b ON contains(b.key, a.key) AND a.key <> b.key AND length(a.key) >= 0.9 * length(b.key)),
near5 AS (SELECT l, r FROM (SELECT l, r, CASE WHEN contains(r, l) OR contains(l, r) THEN least(length(l), length(r)) / greatest(length(l), length(r)) ELSE 0.0 END AS cover, {_jaccard_sql('p.g5', 'q.g5')} AS j5, {_jaccard_sql('p.g8', 'q.g8')} AS j8 FROM c JOIN g p ON p.key = l JOIN g q ON q.key = r) WHERE cover >= 0.9 OR j5 >= 0.55 OR j8 >= 0.4),
e AS (SELECT u, v FROM links UNION SELECT l, r FROM near5), s AS (SELECT u, v FROM e UNION SELECT v, u FROM e UNION SELECT u, u FROM e UNION SELECT v, v FROM e),
hub AS (SELECT v, min(u) AS m FROM s GROUP BY v), near AS (SELECT s.u, min(hub.m) AS m FROM s JOIN hub USING (v) GROUP BY s.u),
q AS (SELECT DISTINCT near.m AS u, n2.m AS v FROM s JOIN near ON near.u = s.u JOIN near n2 ON n2.u = s.v WHERE near.m <> n2.m),
cc(n, m) AS (SELECT u, v FROM q UNION SELECT v, u FROM q UNION SELECT cc.n, z.v FROM cc JOIN (SELECT u, v FROM q UNION SELECT v, u FROM q) z ON cc.m = z.u),
root AS (SELECT near.u, least(near.m, coalesce(min(cc.m), near.m)) AS root FROM near LEFT JOIN cc ON cc.n = near.m GROUP BY near.u, near.m),
groups AS (SELECT u AS question_key, 'problem_' || lpad(CAST(dense_rank() OVER (ORDER BY root) - 1 AS VARCHAR), 8, '0') AS problem_group_id FROM root)"""


def _groups(t):
    """(node, problem_group_id): questions joined by their source question or by similarity."""
    links = written(U.linked_pairs(t("prepared_rows").where("source <> '' and filter_reason = ''"), "question_key", "source_question_key").select("u", "v"))
    keys = links.select(F.explode(F.array("u", "v")).alias("key"))
    alike = S.similar_pairs(keys, "key", 0.90).select(F.col("left").alias("u"), F.col("right").alias("v"))
    return U.group_ids(connected_components(links.unionByName(alike), "u", "v")).select("node", "problem_group_id")


@query(f"WITH RECURSIVE {_GROUPS} SELECT * FROM groups")
def problem_group_ids(spark, t):
    return _groups(t).withColumnRenamed("node", "question_key")


@query(f"WITH RECURSIVE {_GROUPS} SELECT row_id, problem_group_id FROM prepared_rows JOIN groups USING (question_key) WHERE source <> '' AND filter_reason = '' AND source_question_key <> ''")
def attached_groups(spark, t):
    """Rows with the group of their question; a question without a group would fail the query."""
    rows = t("prepared_rows").where("source <> '' and filter_reason = '' and question_key <> '' and source_question_key <> ''").select("row_id", "question_key")
    return U.attach_groups(rows, "question_key", _groups(t)).select("row_id", "problem_group_id")


@query(f"SELECT lower(trim(source)) AS source, count(*) AS kept FROM prepared_rows WHERE question_key IS NOT NULL AND filter_reason = '' AND question_key NOT IN (SELECT question_key FROM prepared_rows WHERE filter_reason = '' AND question_key IS NOT NULL AND gold_answer IS NOT NULL GROUP BY 1 HAVING count(DISTINCT gold_answer) > 1) GROUP BY 1")
def conflict_free_rows(spark, t):
    """Rows whose question has no two answers: the keys of conflicting answers are dropped by an anti-join."""
    rows = t("prepared_rows").where("filter_reason = '' and question_key is not null")
    return rows.join(U.conflicts(rows, "question_key", "gold_answer").select("question_key"), "question_key", "left_anti").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.count("*").alias("kept"))


@query(f"WITH {_MATCH}, x AS (SELECT DISTINCT source_question_key AS g FROM prepared_rows WHERE question_key IN (SELECT candidate FROM m) AND source_question_key IS NOT NULL) SELECT row_id FROM prepared_rows WHERE source_question_key IS NOT NULL AND source_question_key NOT IN (SELECT g FROM x)")
def drop_contaminated_groups(spark, t):
    """Contamination removes the whole group of a source question, not the matching row alone."""
    rows = t("prepared_rows")
    hit = S.contamination_matches(rows, "question_key", _references(t), "key", 0.85).select(F.col("candidate").alias("question_key")).distinct()
    groups = rows.join(hit, "question_key").select("source_question_key").where("source_question_key is not null").distinct()
    return rows.where("source_question_key is not null").join(groups, "source_question_key", "left_anti").select("row_id")


_PICK = "SELECT source, key, rn FROM (SELECT source, key, row_number() OVER (PARTITION BY source ORDER BY md5('7' || key), key) AS rn, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT lower(trim(source)) AS source, source_question_key AS key FROM prepared_rows WHERE filter_reason = '' AND source_question_key <> '')) WHERE rn <= floor(n * 0.1 + 0.5)"


@query(f"SELECT source, key FROM ({_PICK})")
def select_validation_questions(spark, t):
    return U.sample_keys(t("prepared_rows").where("filter_reason = ''").withColumn("source", F.lower(F.trim("source"))), ["source"], "source_question_key", 0.1, "7").select("source", "key")


@query(f"SELECT row_id, CASE WHEN source_question_key IN (SELECT key FROM ({_PICK})) THEN 'validation' ELSE 'train' END AS split FROM prepared_rows WHERE filter_reason = '' AND source_question_key <> ''")
def split_by_group(spark, t):
    rows = t("prepared_rows").where("filter_reason = '' and source_question_key <> ''")
    picked = U.sample_keys(rows.withColumn("source", F.lower(F.trim("source"))), ["source"], "source_question_key", 0.1, "7").select(F.col("key").alias("source_question_key")).distinct()
    return U.split_by_group(rows, "source_question_key", picked).select("row_id", "split")


@query(f"WITH RECURSIVE {_GROUPS}, r AS (SELECT row_id, lower(trim(source)) AS source, question_key, source_question_key, problem_group_id FROM prepared_rows JOIN groups USING (question_key) WHERE source <> '' AND filter_reason = '' AND source_question_key <> ''), p AS (SELECT key FROM (SELECT source, key, row_number() OVER (PARTITION BY source ORDER BY md5('7' || key), key) AS rn, count(*) OVER (PARTITION BY source) AS n FROM (SELECT DISTINCT source, source_question_key AS key FROM r)) WHERE rn <= floor(n * 0.1 + 0.5)), chosen AS (SELECT DISTINCT problem_group_id FROM r WHERE source_question_key IN (SELECT key FROM p)) SELECT row_id, CASE WHEN problem_group_id IN (SELECT problem_group_id FROM chosen) THEN 'validation' ELSE 'train' END AS split FROM r")
def split_by_whole_groups(spark, t):
    """A tenth of the source questions of each source, taken to their whole groups; both sides must hold rows and no group may lie on both."""
    rows = t("prepared_rows").where("source <> '' and filter_reason = '' and question_key <> '' and source_question_key <> ''").select("row_id", F.lower(F.trim("source")).alias("source"), "question_key", "source_question_key")
    grouped = written(U.attach_groups(rows, "question_key", _groups(t)))
    picked = U.sample_keys(grouped, ["source"], "source_question_key", 0.1, "7")
    split = U.split_by_group(grouped, "problem_group_id", U.whole_groups(grouped, "source_question_key", "problem_group_id", picked))
    return U.require_split(split, "problem_group_id", "split").select("row_id", "split")


@query("SELECT problem_group_id FROM final_rows WHERE split = 'train' AND problem_group_id IS NOT NULL INTERSECT SELECT problem_group_id FROM final_rows WHERE split <> 'train'")
def split_leakage_check(spark, t):
    rows = t("final_rows").where("problem_group_id is not null")
    return rows.where("split = 'train'").select("problem_group_id").intersect(rows.where("split <> 'train'").select("problem_group_id"))


@query("SELECT final_id FROM (SELECT final_id, row_number() OVER (ORDER BY md5('5' || problem_group_id), final_id) AS rn FROM (SELECT problem_group_id, min(final_id) AS final_id FROM final_rows WHERE split = 'validation' AND problem_group_id IS NOT NULL GROUP BY 1)) WHERE rn <= 64")
def validation_subset(spark, t):
    one = U.keep_first(t("final_rows").where("split = 'validation'"), ["problem_group_id"], ["final_id"])
    return U.fixed_subset(one, min(64, one.count()), "5", "problem_group_id", ["final_id"]).select("final_id")


@query("""
WITH o AS (SELECT final_id, row_number() OVER (ORDER BY md5('3' || final_id), final_id) - 1 AS p, len(input_ids) AS n, count(*) OVER () AS total FROM final_rows WHERE split = 'train'),
w AS (SELECT *, p // (5 * 16) AS win FROM o WHERE p < total // 16 * 16), s AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY n DESC, p) - 1 AS q FROM w)
SELECT final_id, row_number() OVER (ORDER BY hb, b) - 1 AS batch, CAST(q % 4 AS INT) AS rank FROM (SELECT *, win * 5 + q // 16 AS b, md5('3b' || (win * 5 + q // 16)) AS hb FROM s)""".replace("row_number() OVER (ORDER BY hb, b) - 1", "dense_rank() OVER (ORDER BY hb, b) - 1"))
def length_grouped_batches(spark, t):
    rows = t("final_rows").where("split = 'train'").select("final_id", F.size("input_ids").alias("n"))
    return U.length_grouped_batches(rows, "final_id", "n", seed="3", batch=16, window=5, world=4)


@query("SELECT event_id, CAST(event_id % 4 AS INT) AS rank, CAST(event_id // 4 AS BIGINT) AS position FROM events WHERE event_id // 4 >= 10")
def stride_shards(spark, t):
    return t("events").where(F.floor(F.col("event_id") / 4) >= 10).select("event_id", F.pmod("event_id", F.lit(4)).cast("int").alias("rank"), F.floor(F.col("event_id") / 4).alias("position"))


@query("SELECT e.vec_id, s.shard, e.vec_id - s.row_start AS offset_in_shard FROM embeddings e JOIN (SELECT b AS shard, b * 37 AS row_start, (b + 1) * 37 AS row_end FROM (SELECT unnest(range(0, (SELECT CAST(max(vec_id) // 37 + 1 AS BIGINT) FROM embeddings))) AS b)) s ON e.vec_id >= s.row_start AND e.vec_id < s.row_end")
def shard_range_lookup(spark, t):
    last = t("embeddings").agg(F.max("vec_id")).first()[0]
    shards = spark.range(0 if last is None else last // 37 + 1).select(F.col("id").alias("shard"), (F.col("id") * 37).alias("row_start"), ((F.col("id") + 1) * 37).alias("row_end"))
    return U.range_lookup(t("embeddings").select("vec_id"), "vec_id", shards, "row_start", "row_end", 37).select("vec_id", "shard", (F.col("vec_id") - F.col("row_start")).alias("offset_in_shard"))


@query("SELECT f.final_id, len(f.input_ids) = len(g.input_ids) AS aligned FROM final_rows f JOIN final_rows g ON f.split = g.split AND f.row_index = g.row_index")
def aligned_join(spark, t):
    f = t("final_rows").select("split", "row_index", "final_id", F.size("input_ids").alias("n"))
    cache = f.select("split", "row_index", F.col("n").alias("m"))
    return f.join(cache, ["split", "row_index"]).select("final_id", (F.col("n") == F.col("m")).alias("aligned"))


@query()
def minhash_candidates(spark, t):
    return S.minhash_candidates(t("prepared_rows"), "question_key")


@query(f"""
WITH {_MATCH}, x AS (SELECT DISTINCT source_question_key AS g FROM prepared_rows WHERE question_key IN (SELECT candidate FROM m) AND source_question_key IS NOT NULL),
d AS (SELECT p.row_id, lower(trim(p.source)) AS source, p.filter_reason <> '' AS rejected, row_number() OVER (PARTITION BY lower(trim(p.source)), p.source_index ORDER BY p.ingested_at DESC, p.row_id) > 1 AS repeated, coalesce(p.source_question_key IN (SELECT g FROM x), false) AS contaminated FROM prepared_rows p)
SELECT source, count(*) AS n, count(*) FILTER (rejected) AS rejected, count(*) FILTER (NOT rejected AND repeated) AS repeated, count(*) FILTER (NOT rejected AND NOT repeated AND contaminated) AS contaminated, count(*) FILTER (NOT rejected AND NOT repeated AND NOT contaminated) AS kept FROM d GROUP BY source""")
def flagship_curation_accounting(spark, t):
    """What curation does to each source: rejected, repeated and contaminated rows, and those kept."""
    rows = t("prepared_rows").select("row_id", F.lower(F.trim("source")).alias("source"), "source_index", "question_key", "source_question_key", "filter_reason", "ingested_at")
    hit = written(S.contamination_matches(rows, "question_key", _references(t), "key", 0.85).select(F.col("candidate").alias("question_key")).distinct())
    groups = rows.join(hit, "question_key").select("source_question_key").where("source_question_key is not null").distinct().withColumn("contaminated", F.lit(True))
    latest = Window.partitionBy("source", "source_index").orderBy(F.col("ingested_at").desc_nulls_last(), "row_id")
    d = rows.withColumn("repeated", F.row_number().over(latest) > 1).join(groups, "source_question_key", "left")
    ok, dirty = F.col("filter_reason") == "", F.coalesce("contaminated", F.lit(False))
    return d.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("rejected"), F.count_if(ok & F.col("repeated")).alias("repeated"),
        F.count_if(ok & ~F.col("repeated") & dirty).alias("contaminated"), F.count_if(ok & ~F.col("repeated") & ~dirty).alias("kept"),
    )
