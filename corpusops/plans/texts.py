"""Queries of the text, answer and n-gram functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusops.functions import answers as A
from corpusops.functions import text as T
from corpusops.functions.tokens import pair_tokens
from corpusops.plans.registry import query

WS = r"[\s\x{0b}\x{85}\p{Z}]+"


def stripped(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{WS}', ''), '{WS}$', '')"


NUMBER = A.NUMBER


@query("SELECT row_id, nullif(question_key, '') AS key FROM prepared_rows")
def normalize_question_words(spark, t):
    return t("prepared_rows").select("row_id", T.question_key(T.question_of(F.col("input"))).alias("key"))


@query(rf"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '{WS}', ' ', 'g')) AS key FROM documents")
def normalize_question_math(spark, t):
    return t("documents").select("doc_id", T.math_key(F.col("text")).alias("key"))


@query(rf"SELECT doc_id, nullif(trim(regexp_replace(lower(nfc_normalize(text)), '{WS}', ' ', 'g')), '') AS key FROM documents")
def normalize_match_text(spark, t):
    return t("documents").select("doc_id", T.match_text(F.col("text")).alias("key"))


@query(rf"SELECT item_id, 'Question: ' || {stripped('question')} || chr(10) || 'Answer:' AS grade_school, 'Question: ' || {stripped('question')} || chr(10) || 'Step-by-Step Answer:' AS competition FROM eval_items")
def build_prompts(spark, t):
    q = T.required_text(F.col("question"))
    return t("eval_items").select("item_id", F.concat(F.lit("Question: "), q, F.lit("\nAnswer:")).alias("grade_school"), F.concat(F.lit("Question: "), q, F.lit("\nStep-by-Step Answer:")).alias("competition"))


_BUILT = (
    "CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN '  ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' ' WHEN 1 THEN CAST(o_custkey AS VARCHAR) || ' / ' || CAST(o_orderkey % 5 AS VARCHAR) "
    "WHEN 2 THEN '-.5' WHEN 3 THEN '1,234,' || CAST(100 + o_custkey % 900 AS VARCHAR) WHEN 4 THEN '1234,567' WHEN 5 THEN '5.' WHEN 6 THEN '$' || CAST(o_custkey AS VARCHAR) "
    "WHEN 7 THEN '+' || CAST(o_custkey AS VARCHAR) || '.25' WHEN 8 THEN '' WHEN 9 THEN NULL ELSE '.' || CAST(o_custkey AS VARCHAR) END"
)
_BUILT_SPARK = _BUILT.replace("VARCHAR", "STRING")
_INT = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)"


@query(rf"""
WITH b AS (SELECT o_orderkey, trim({_BUILT}) AS v FROM orders),
c AS (SELECT *, regexp_full_match(v, '[+-]?{_INT}\s*/\s*{_INT}') AS fr, regexp_full_match(v, '[+-]?(?:{_INT}(?:\.[0-9]+)?|\.[0-9]+)') AS de, replace(v, ',', '') AS p FROM b),
d AS (SELECT *, CASE WHEN v IS NULL OR v = '' THEN 'missing_answer' WHEN fr THEN CASE WHEN regexp_extract(p, '([0-9]+)$', 1) SIMILAR TO '0+' THEN 'zero_fraction_denominator' ELSE '' END WHEN de THEN '' ELSE 'unsupported_answer' END AS reason FROM c)
SELECT o_orderkey, CASE WHEN reason <> '' THEN NULL WHEN fr THEN regexp_replace(p, '\s*/\s*', '/') ELSE regexp_replace(p, '^([+-]?)\.', '\10.') END AS value, reason FROM d""")
def numeric_answer_normalize(spark, t):
    df = t("orders").selectExpr("o_orderkey", f"{_BUILT_SPARK} AS v")
    return df.select("o_orderkey", A.numeric_answer(F.col("v")).alias("r")).select("o_orderkey", "r.value", "r.reason")


_PRED = rf"regexp_extract(tail, '^ ({NUMBER})', 1)"


@query(rf"""
WITH g AS (SELECT generation_id, generated_text AS x, CASE WHEN contains(generated_text, '####') THEN list_extract(string_split(generated_text, '####'), -1) END AS tail FROM generations),
m AS (SELECT *, {_PRED} AS n FROM g)
SELECT generation_id, CASE WHEN n <> '' AND NOT regexp_matches(substr(tail, length(n) + 2), '^[0-9,./]') THEN replace(n, ',', '') END AS strict FROM m""")
def strict_answer(spark, t):
    return t("generations").select("generation_id", A.strict_answer(F.col("generated_text")).alias("strict"))


@query(rf"""
WITH s AS (SELECT generation_id, generated_text AS x, string_split_regex(generated_text, '(?i)####|\bthe answer is\b:?|\banswer:|\banswer is\b') AS p FROM generations)
SELECT generation_id, replace(nullif(CASE WHEN len(p) > 1 THEN regexp_extract(p[-1], '{NUMBER}') ELSE list_extract(regexp_extract_all(x, '{NUMBER}'), -1) END, ''), ',', '') AS permissive FROM s""")
def permissive_answer(spark, t):
    return t("generations").select("generation_id", A.permissive_answer(F.col("generated_text")).alias("permissive"))


_NO_LINE = rf"regexp_replace({stripped('x')}, '[\s\x{{0b}}\x{{85}}\p{{Z}}]*####[\s\x{{0b}}\x{{85}}\p{{Z}}]*[^\n]*[\s\x{{0b}}\x{{85}}\p{{Z}}]*$', '')"


@query(rf"""
WITH b AS (SELECT row_id, target AS x FROM prepared_rows),
s AS (SELECT row_id, x, {stripped(_NO_LINE)} AS bare FROM b)
SELECT row_id, CASE WHEN x IS NULL THEN NULL WHEN contains(bare, '####') THEN NULL ELSE bare END AS rationale, CASE WHEN x IS NULL THEN 'missing_solution' WHEN contains(bare, '####') THEN 'answer_marker_in_rationale' ELSE '' END AS reason FROM s""")
def strip_marker_line(spark, t):
    return t("prepared_rows").select("row_id", A.strip_marker_line(F.col("target")).alias("r")).select("row_id", F.col("r.value").alias("rationale"), "r.reason")


@query()
def canonicalize_responses(spark, t):
    g = F.col("generated_text")
    by_hash = A.canonical_response(g, A.HASH, "missing_terminal_hash_answer", False)
    by_words = A.canonical_response(F.concat(A.strip_marker_line(g)["value"], F.lit(" The answer is: "), F.col("gold_answer")), A.SAYS, "missing_terminal_answer_marker", True)
    return t("generations").select("generation_id", by_hash.alias("h"), by_words.alias("w")).select(
        "generation_id", F.col("h.gold").alias("hash_gold"), F.col("h.reason").alias("hash_reason"), F.col("h.target").alias("hash_target"), F.col("w.gold").alias("said_gold"), F.col("w.reason").alias("said_reason")
    )


@query(r"""
WITH b AS (SELECT 'row|' || row_id AS key, gold_answer AS v FROM prepared_rows UNION ALL SELECT 'item|' || item_id, answer FROM eval_items), c AS (SELECT *, regexp_replace(v, '\\.', '', 'gs') AS bare FROM b),
o AS (SELECT *, nullif(coalesce(list_position(string_split(bare, ''), '$'), 0), 0) AS d, nullif(coalesce(list_position(string_split(bare, ''), '%'), 0), 0) AS p, nullif(coalesce(list_position(string_split(bare, ''), '#'), 0), 0) AS h, length(nullif(regexp_extract(bare, '^[^{]*\}'), '')) AS u FROM c)
SELECT key, CASE WHEN v IS NULL THEN 'missing_answer' WHEN u < least(d, p, h) OR (u IS NOT NULL AND least(d, p, h) IS NULL) THEN 'unbalanced_braces' WHEN d = least(d, p, h) THEN 'unescaped_dollar' WHEN p = least(d, p, h) THEN 'unescaped_percent' WHEN h = least(d, p, h) THEN 'unescaped_hash'
WHEN length(bare) - length(replace(bare, '{', '')) <> length(bare) - length(replace(bare, '}', '')) THEN 'unbalanced_braces' ELSE '' END AS fault FROM o""".replace("\\\\", "\\"))
def tex_structure(spark, t):
    """Structural faults of the answers of the corpus and the benchmark."""
    both = t("prepared_rows").select(F.concat(F.lit("row|"), F.col("row_id").cast("string")).alias("key"), F.col("gold_answer").alias("v")).unionByName(t("eval_items").select(F.concat(F.lit("item|"), F.col("item_id").cast("string")).alias("key"), F.col("answer").alias("v")))
    return both.select("key", A.tex_problem(F.col("v")).alias("fault"))


_WORDS = r"regexp_extract_all(lower(question), '[a-z0-9]+(?:\.[0-9]+)?')"


@query(rf"SELECT item_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' ')))) AS gram FROM (SELECT item_id, {_WORDS} AS w FROM eval_items)")
def word_ngrams_5(spark, t):
    words = t("eval_items").select("item_id", T.key_words(F.col("question")).alias("w"))
    return words.select("item_id", F.explode(T.word_ngrams(F.col("w"), 5)).alias("gram"))


@query(rf"SELECT item_id, CAST(greatest(len(w) - 7, 0) AS INT) AS grams, CAST(len(list_distinct(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i+7], ' ')))) AS INT) AS distinct_grams FROM (SELECT item_id, {_WORDS} AS w FROM eval_items)")
def word_8gram_list(spark, t):
    w = F.col("w")
    words = t("eval_items").select("item_id", T.key_words(F.col("question")).alias("w"))
    return words.select("item_id", F.size(T.word_ngrams(w, 8, distinct=False)).alias("grams"), F.size(T.word_ngrams(w, 8)).alias("distinct_grams"))


@query("""
WITH g AS (SELECT item_id, i, substr(task_id || question, i, 4) AS gram FROM (SELECT item_id, task_id, question, unnest(range(1, length(task_id || question) - 2)) AS i FROM eval_items))
SELECT item_id, gram, CAST(row_number() OVER (PARTITION BY item_id, gram ORDER BY i) AS INT) AS occurrence FROM g""")
def char_4gram_occurrences(spark, t):
    key = F.concat("task_id", "question")
    grams = t("eval_items").where(F.length(key) >= 4).select("item_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.length(key) - 3), lambda i: F.substring(key, i, F.lit(4)))).alias("i", "gram"))
    return grams.select("item_id", "gram", F.row_number().over(Window.partitionBy("item_id", "gram").orderBy("i")).alias("occurrence"))


@query("""
SELECT event_id, upper(nullif(regexp_extract(v, '^\\s*([A-Da-d])\\s*$', 1), '')) AS letter, CASE WHEN contains(v, 'Final answer: ') THEN right(v, 1) END AS exact
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ' ' || chr(CAST(65 + event_id % 5 AS INT)) || ' ' WHEN 1 THEN 'because' || chr(10) || 'Final answer: ' || chr(CAST(65 + event_id % 4 AS INT)) WHEN 2 THEN 'b' ELSE event_type END AS v FROM events)""")
def choice_letters(spark, t):
    v = F.expr("CASE event_id % 4 WHEN 0 THEN ' ' || chr(65 + event_id % 5) || ' ' WHEN 1 THEN 'because' || chr(10) || 'Final answer: ' || chr(65 + event_id % 4) WHEN 2 THEN 'b' ELSE event_type END")
    return t("events").select("event_id", A.choice_letter(v).alias("letter"), A.rationale_choice(v, True).alias("exact"))


@query()
def tokenize_pairs(spark, t):
    """Sizes of prompt and response in a public vocabulary, and whether they join without a token across the border."""
    r = pair_tokens(F.col("input"), F.col("target"))
    return t("prepared_rows").where("filter_reason = ''").select("row_id", r.alias("r")).select("row_id", F.size("r.condition_ids").alias("condition"), F.size("r.response_ids").alias("response"), "r.consistent")
