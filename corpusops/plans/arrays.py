"""Queries of the array, vector and schedule kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusops.functions import arrays as K
from corpusops.functions import schedules as S
from corpusops.plans.registry import query

@query("SELECT final_id, CASE WHEN len(condition_input_ids) > 256 THEN 'input_too_long' WHEN len(condition_input_ids) + len(input_ids) > 1024 THEN 'sequence_too_long' ELSE '' END AS grade_school, CASE WHEN len(condition_input_ids) > 96 THEN 'input_too_long' WHEN len(input_ids) > 64 THEN 'response_too_long' WHEN len(condition_input_ids) + len(input_ids) > 150 THEN 'sequence_too_long' ELSE '' END AS competition, CASE WHEN len(condition_input_ids) > 512 THEN 'input_too_long' WHEN len(condition_input_ids) + len(input_ids) > 1024 THEN 'sequence_too_long' ELSE '' END AS code FROM final_rows")
def length_filters(spark, t):
    a, b = F.size(F.col("condition_input_ids")), F.size(F.col("input_ids"))
    school = F.when(a > 256, "input_too_long").when(a + b > 1024, "sequence_too_long").otherwise("")
    competition = F.when(a > 96, "input_too_long").when(b > 64, "response_too_long").when(a + b > 150, "sequence_too_long").otherwise("")
    code = F.when(a > 512, "input_too_long").when(a + b > 1024, "sequence_too_long").otherwise("")
    return t("final_rows").select("final_id", school.alias("grade_school"), competition.alias("competition"), code.alias("code"))


@query("SELECT final_id, condition_input_ids[1:80] AS prompt_ids, len(condition_input_ids) > 80 AS prompt_truncated, list_concat(input_ids, list_transform(range(64), lambda x: 0))[1:64] AS padded, CAST(least(len(input_ids) + least(len(condition_input_ids), 80), 128) AS INT) AS effective FROM final_rows")
def truncate_pad_effective(spark, t):
    return t("final_rows").select("final_id", F.slice(F.col("condition_input_ids"), 1, 80).alias("prompt_ids"), (F.size(F.col("condition_input_ids")) > 80).alias("prompt_truncated"), K.pad_or_cut(F.col("input_ids"), 64, 0).alias("padded"), K.effective_length(F.col("input_ids"), F.col("condition_input_ids"), 80, 128).alias("effective"))


@query("SELECT final_id, list_concat(condition_input_ids[1:32], input_ids) AS ids, list_transform(range(1, 97), lambda i: CASE WHEN i <= least(len(condition_input_ids), 32) THEN 1 WHEN i <= least(len(condition_input_ids), 32) + len(input_ids) THEN 2 ELSE 0 END) AS mask FROM final_rows")
def collate_rows(spark, t):
    return t("final_rows").select("final_id", K.joined(F.col("condition_input_ids"), F.col("input_ids"), 32).alias("ids"), K.condition_mask(F.least(F.size(F.col("condition_input_ids")), F.lit(32)), F.least(F.size(F.col("condition_input_ids")), F.lit(32)) + F.size(F.col("input_ids")), 96).alias("mask"))


@query("""
WITH b AS (SELECT final_id, list_concat(condition_input_ids, input_ids)[len(condition_input_ids)+1:len(condition_input_ids)+40] AS tail FROM final_rows),
p AS (SELECT *, coalesce(list_position(tail, 2), 0) AS pos FROM b)
SELECT final_id, list_concat(CASE WHEN pos > 0 THEN tail[1:pos-1] ELSE tail END, list_transform(range(40), lambda x: 0))[1:40] AS ids, pos > 0 AS eos, CAST(CASE WHEN pos > 0 THEN pos ELSE len(tail) END AS INT) AS length FROM p""")
def extract_response(spark, t):
    r = K.extract_response(F.concat(F.col("condition_input_ids"), F.col("input_ids")), F.size(F.col("condition_input_ids")), 40, 2, 0)
    return t("final_rows").select("final_id", r.alias("r")).select("final_id", "r.ids", "r.eos", "r.length")


@query("SELECT final_id, list_transform(input_ids, lambda x, i: CASE WHEN coalesce(list_position(input_ids, 2), 0) = 0 OR i - 1 < list_position(input_ids, 2) THEN 1 ELSE 0 END) AS mask, list_concat(input_ids[least(row_index % 7, len(input_ids))+1:], list_transform(range(least(row_index % 7, len(input_ids))), lambda x: 0)) AS shifted, list_transform(input_ids, lambda x: CASE WHEN x IN (0, 1, 2) THEN 0 ELSE 1 END) AS content FROM final_rows")
def mask_shift_content(spark, t):
    return t("final_rows").select("final_id", K.before_first(F.col("input_ids"), 2).alias("mask"), K.shift_left(F.col("input_ids"), F.col("row_index") % 7, 0).alias("shifted"), K.content_mask(F.col("input_ids"), [0, 1, 2]).alias("content"))


@query("SELECT final_id, CAST(CASE WHEN len(h) = 1 THEN h[1] END AS INT) AS place FROM (SELECT final_id, list_filter(range(1, len(input_ids) - 1), lambda i: input_ids[i:i+2] = input_ids[2:4]) AS h FROM final_rows WHERE len(input_ids) >= 4)")
def unique_subsequence(spark, t):
    return t("final_rows").where(F.size(F.col("input_ids")) >= 4).select("final_id", K.find_unique(F.col("input_ids"), F.slice(F.col("input_ids"), 2, 3)).alias("place"))


@query("SELECT final_id, list_concat([7, 8], condition_input_ids, [9], input_ids, [10]) AS chat, CAST(3 + len(condition_input_ids) + 1 AS INT) AS response_at FROM final_rows")
def chat_scaffold(spark, t):
    fixed = lambda *x: F.array(*map(F.lit, x))
    return t("final_rows").select("final_id", F.concat(fixed(7, 8), F.col("condition_input_ids"), fixed(9), F.col("input_ids"), fixed(10)).alias("chat"), (F.size(F.col("condition_input_ids")) + 4).alias("response_at"))


def _mask_sql(cell: str) -> str:
    return f"list_transform(range(1, 7), lambda i: list_transform(range(1, 7), lambda j: CASE WHEN i <= n AND j <= n AND ({cell}) THEN 1 ELSE 0 END))"


@query(f"SELECT final_id, {_mask_sql('true')} AS full_mask, {_mask_sql('j <= i')} AS causal, {_mask_sql('i > c OR j <= c')} AS directional FROM (SELECT final_id, row_index % 3 AS c, row_index % 6 + 1 AS n FROM final_rows)")
def attention_masks(spark, t):
    c, n = F.col("row_index") % 3, F.col("row_index") % 6 + 1
    return t("final_rows").select("final_id", *(K.attention_mask(c, n, 6, k).alias(a) for k, a in (("full", "full_mask"), ("causal", "causal"), ("directional", "directional"))))


@query("SELECT final_id, CAST(sum(CASE WHEN seen = 0 THEN 1 ELSE 0 END) AS BIGINT) AS before_eos, CAST(sum(CASE WHEN seen = 1 THEN 1 ELSE 0 END) AS BIGINT) AS at_or_after FROM (SELECT final_id, sum(CASE WHEN x = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY final_id ORDER BY i) AS seen FROM (SELECT final_id, unnest(input_ids) AS x, unnest(range(1, len(input_ids) + 1)) AS i FROM final_rows)) GROUP BY final_id")
def running_eos_count(spark, t):
    from pyspark.sql import Window

    x = t("final_rows").select("final_id", F.posexplode("input_ids").alias("i", "x"))
    seen = x.withColumn("seen", F.sum(F.when(F.col("x") == 2, 1).otherwise(0)).over(Window.partitionBy("final_id").orderBy("i")))
    return seen.groupBy("final_id").agg(F.count_if(F.col("seen") == 0).alias("before_eos"), F.count_if(F.col("seen") == 1).alias("at_or_after"))


_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


def _vectors(t):
    return t("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.reverse("embedding").cast("array<double>").alias("w"))


@query(f"""
WITH e AS (SELECT vec_id, {_V} AS v FROM embeddings), m AS (SELECT *, list_sum(v) / len(v) AS mu FROM e), c AS (SELECT *, list_transform(v, lambda x: x - mu) AS d FROM m)
SELECT vec_id, list_transform(d, lambda x: round(x / sqrt(list_sum(list_transform(d, lambda y: y * y)) / (len(d) - 1) + 1e-6), 6)) AS z FROM c""")
def feature_standardize(spark, t):
    return _vectors(t).select("vec_id", F.transform(K.standardise(F.col("v")), lambda x: F.round(x, 6)).alias("z"))


@query(f"""
WITH e AS (SELECT vec_id, {_V} AS v, list_reverse({_V}) AS w FROM embeddings)
SELECT vec_id, round(greatest(0, 1 - list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))), 6) AS distance,
round(list_avg(list_transform(list_zip(v, w), lambda p: CASE WHEN abs(p[1] - p[2]) < 0.05 THEN 0.5 * (p[1] - p[2]) * (p[1] - p[2]) / 0.05 ELSE abs(p[1] - p[2]) - 0.025 END)), 6) AS smooth FROM e""")
def vector_distances(spark, t):
    return _vectors(t).select("vec_id", F.round(K.cosine_distance(F.col("v"), F.col("w")), 6).alias("distance"), F.round(K.smooth_l1(F.col("v"), F.col("w")), 6).alias("smooth"))


@query("SELECT label, CAST(i AS INT) AS dim, round(avg(x), 6) AS mean, round(CAST(max_by(x, vec_id) AS DOUBLE), 6) AS last FROM (SELECT label, vec_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def pool_mean_last(spark, t):
    x = t("embeddings").select("label", "vec_id", F.posexplode("embedding").alias("dim", "x"))
    return x.groupBy("label", "dim").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.max_by("x", "vec_id").cast("double"), 6).alias("last"))


@query(f"""
WITH e AS (SELECT vec_id, {_V} AS v, list_reverse({_V}) AS w, CAST((vec_id % 10) / 10.0 AS DOUBLE) AS u FROM embeddings), x AS (SELECT vec_id, u, unnest(range(0, len(v))) AS dim, unnest(v) AS v, unnest(w) AS w FROM e)
SELECT vec_id, CAST(dim AS INT) AS dim, u * v + (1 - u) * w * 2 AS z, (v - (u * v + (1 - u) * w * 2)) / greatest(1 - u, 0.05::DOUBLE) AS velocity FROM x""")
def interpolate_velocity(spark, t):
    """One row for each dimension, so that values compare as numbers."""
    u = ((F.col("vec_id") % 10) / 10.0).cast("double")
    z = _vectors(t).select("vec_id", "v", u.alias("u"), K.interpolate(F.col("v"), F.col("w"), u, 2.0).alias("z"))
    both = z.select("vec_id", F.posexplode(F.arrays_zip("z", K.velocity(F.col("v"), F.col("z"), F.col("u"), 0.05).alias("velocity"))).alias("dim", "x"))
    return both.select("vec_id", "dim", "x.z", "x.velocity")


@query("SELECT s AS step, round(CASE WHEN s < 100 THEN 0.001 * s / 100 ELSE 0.0001 + 0.00045 * (1 + cos(pi() * least(1.0, (s - 100) / 900.0))) END, 12) AS cosine, round(CASE WHEN s < 100 THEN 0.001 * s / 100 ELSE 0.001 END, 12) AS constant, round(CASE WHEN s >= 1000 THEN 0.999 ELSE pow(0.5, 1 / greatest(ln(0.5) / ln(0.999) * s / 1000.0, 1e-9)) END, 10) AS decay, s >= 200 AND s < 700 AS open FROM (SELECT unnest(range(0, 1200)) AS s)")
def schedules(spark, t):
    s = F.col("id")
    return spark.range(1200).select(
        s.alias("step"), F.round(S.learning_rate(s, 0.001, 0.0001, 100, 1000, True), 12).alias("cosine"), F.round(S.learning_rate(s, 0.001, 0.0001, 100, 1000, False), 12).alias("constant"),
        F.round(S.ema_decay(s, 0.999, 1000), 10).alias("decay"), S.window_open(s, 200, 700).alias("open"),
    )


@query("SELECT s AS step, floor(s / 2.5) > floor((s - 1) / 2.5) AS evaluate, CAST(floor(s * 64 / 9984) AS BIGINT) AS epoch, CAST(floor(((s * 64) % 9984) / 48) AS BIGINT) AS skip_batches FROM (SELECT unnest(range(1, 500)) AS s)")
def boundaries_and_resume(spark, t):
    s = F.col("id")
    return spark.range(1, 500).select(s.alias("step"), S.boundaries(s, 2.5).alias("evaluate"), S.resume_position(s, 8, 8, 6, 10000).alias("r")).select("step", "evaluate", "r.epoch", "r.skip_batches")


@query("SELECT CAST(r * n AS BIGINT) AS master, CAST(count(*) AS BIGINT) AS exits, list(n - 1 ORDER BY n) AS steps, CAST(max(n - 1) AS BIGINT) AS denoiser_evaluations FROM (SELECT unnest([1, 2, 4]) AS r) CROSS JOIN (SELECT unnest([16, 32, 64, 128]) AS n) GROUP BY 1")
def exit_grouping(spark, t):
    exits = spark.range(12).selectExpr("element_at(array(1, 2, 4), int(id div 4) + 1) AS r", "element_at(array(16, 32, 64, 128), int(id % 4) + 1) AS n")
    return exits.groupBy((F.col("r") * F.col("n")).cast("bigint").alias("master")).agg(F.count("*").alias("exits"), F.array_sort(F.collect_list(F.col("n") - 1)).alias("steps"), F.max(F.col("n") - 1).cast("bigint").alias("denoiser_evaluations"))


@query("SELECT f.split, r.rank, least(f.n, r.rank * CAST(ceil(f.n / 4.0) AS BIGINT)) AS start_row, least(f.n, (r.rank + 1) * CAST(ceil(f.n / 4.0) AS BIGINT)) AS end_row FROM (SELECT split, count(*) AS n FROM final_rows GROUP BY split) f CROSS JOIN (SELECT unnest(range(0, 4)) AS rank) r")
def rank_ranges(spark, t):
    n = t("final_rows").groupBy("split").agg(F.count("*").alias("n"))
    ranks = n.select("split", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("rank"))
    return ranks.select("split", "rank", S.rank_ranges(F.col("n"), 4, F.col("rank")).alias("r")).select("split", "rank", F.col("r.start").alias("start_row"), F.col("r.end").alias("end_row"))


@query()
def keyed_draws(spark, t):
    """Bernoulli, uniform, log-uniform, normal and logit-normal draws that depend on the key alone, summarised."""
    u, z = K.uniform(F.col("event_id"), seed=3), K.normal(F.col("event_id"), seed=5)
    d = t("events").select(u.alias("u"), (u < 0.1).alias("b"), F.exp(F.log(F.lit(0.01)) + u * (F.log(F.lit(1.0)) - F.log(F.lit(0.01)))).alias("lu"), z.alias("z"), (1 / (1 + F.exp(-z))).alias("ln"))
    return d.agg(F.round(F.avg("u"), 4).alias("uniform_mean"), F.round(F.avg(F.col("b").cast("int")), 4).alias("bernoulli_rate"), F.round(F.avg("lu"), 4).alias("log_uniform_mean"), F.round(F.stddev("z"), 4).alias("normal_sd"), F.round(F.avg("ln"), 4).alias("logit_normal_mean"))
