"""Operators against brute force and on awkward tables: nulls, ties, repeats, nothing at all."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusops.functions import text as T
from corpusops.operators import curate as U
from corpusops.operators import metrics as M
from corpusops.operators import runs as R
from corpusops.operators import similarity as S
from corpusops.operators.graph import connected_components
from corpusops.operators.ranking import running_total
from corpusops.plans import registry
from corpusops.sources import jsonl
from corpusops.streaming import curation as stream
from tests.conftest import rows


def test_connected_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 1), (7, 7)]
    parent = {x: x for e in edges for x in e if None not in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b")
    assert rows(got, "node", "component") == sorted(((x, root(x)) for x in parent), key=str)
    assert rows(connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b")) == []


def test_group_ids(spark):
    c = connected_components(spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e")], "u string, v string"), "u", "v")
    assert rows(U.group_ids(c), "node", "problem_group_id") == [("a", "problem_00000000"), ("b", "problem_00000000"), ("c", "problem_00000000"), ("d", "problem_00000001"), ("e", "problem_00000001")]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_running_total(spark, parts):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", None]), i, rng.randrange(5) or None) for i in range(200)]
    got = running_total(spark.createDataFrame(data, "g string, i int, v int"), ["g"], ["i"], F.col("v"), "t", parts, key=F.floor(F.col("i") * parts / 200)).collect()
    for r in got:
        assert r.t == sum(v or 0 for g, i, v in data if g == r.g and i < r.i)


def test_keep_first_and_conflicts(spark):
    d = spark.createDataFrame([("x", 2, "1"), ("x", 1, "2"), (None, 0, "9"), ("y", 5, "1"), ("x", 3, "1")], "k string, i int, a string")
    assert rows(U.keep_first(d, ["k"], ["i"]), "k", "i") == [("x", 1), ("y", 5)]
    assert rows(U.conflicts(d, "k", "a")) == [("x", ["1", "2"], 3)]
    assert rows(U.keep_first(d.limit(0), ["k"], ["i"])) == []


def near_texts(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 6, 9, 14, 25]))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            other = list(base)
            for _ in range(rng.randrange(3)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            out.append(" ".join(other[rng.randrange(2) : len(other) - rng.randrange(2)] or other))
    return out


def grams(key, n):
    w = key.split(" ")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def similar(a, b, coverage):
    j = lambda n: (lambda x, y: len(x & y) / len(x | y) if x and y else 0.0)(grams(a, n), grams(b, n))
    short, long = sorted((a, b), key=len)
    return a == b or (short in long and len(short) / len(long) >= coverage) or j(5) >= S.FIVE or j(8) >= S.EIGHT


def test_similarity_join_is_exact(spark):
    keys = sorted(set(near_texts(60, 7)))
    got = S.similar_pairs(spark.createDataFrame([(k,) for k in [*keys, None, "", keys[0]]], "k string"), "k", 0.9)
    want = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if similar(a, b, 0.9)]
    assert rows(got, "left", "right") == sorted(want, key=str) and len(want) > 10


def test_few_long_words_within_many_and_repeated_grams(spark):
    """Five words of 60 letters within 15 words, and a key that repeats one gram all over."""
    long = " ".join(c * 60 for c in "abcde")
    again = "z " * 9 + "z"
    pairs = [(long, long + " i j k l m n o p q r"), (again, again + " z"), ("a b", "xa b")]
    got = S.similar_pairs(spark.createDataFrame([(k,) for p in pairs for k in p], "k string"), "k", 0.6)
    found = {(r.left, r.right) for r in got.collect()}
    assert {tuple(sorted(p)) for p in pairs} <= found
    cross = S.contamination_matches(spark.createDataFrame([(p[0],) for p in pairs], "k string"), "k", spark.createDataFrame([(p[1],) for p in pairs], "k string"), "k", 0.6)
    assert {tuple(p) for p in pairs} <= {(r.candidate, r.reference) for r in cross.collect()}


def test_minhash_recall_against_the_exact_join(spark):
    d = spark.createDataFrame([(k,) for k in near_texts(150, 3)], "k string")
    exact = {(r.left, r.right) for r in S.similar_pairs(d, "k", 0.9).where("word_5gram_jaccard >= 0.55").collect()}
    found = {tuple(r) for r in S.minhash_candidates(d, "k").collect()}
    assert len(exact) > 20 and len(exact & found) >= 0.98 * len(exact)


def test_minhash_pairs_are_whole_and_never_shuffled(spark):
    """A family of which every two keys pair, cut into blocks; its shuffle files stay in proportion to the keys, not to the 79,800 pairs."""
    family = [f"a b c d e f g h i j k l m n o p {i}" for i in range(400)]
    d = spark.createDataFrame([(k,) for k in [*family, family[0], "u v w", "w v u", "alone", "", " ", None]], "k string")
    want = {tuple(sorted((x, y))) for i, x in enumerate(family) for y in family[i + 1 :]} | {("u v w", "w v u")}
    shuffled = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before = shuffled()
    pairs = S.minhash_candidates(d, "k")
    assert rows(pairs) == sorted(want, key=str)
    assert sum(os.path.getsize(f) for f in shuffled() - before) < 10 * sum(map(len, family))
    for block in (7, 300):
        assert rows(S.minhash_candidates(d, "k", block=block)) == sorted(want, key=str)
    with pytest.raises(ValueError):
        S.minhash_candidates(d, "k", block=1 << 17)


def test_minhash_pairs_of_a_bucket_are_written_together(spark, tmp_path):
    """The result grows with the square of the keys, so its size counts: 30 families of 100 long texts, alike in the middle only, that lie far apart in the order of texts."""
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    middles = [" ".join(word() for _ in range(40)) for _ in range(30)]
    texts = [f"{' '.join(word() for _ in range(20))} {m} {' '.join(word() for _ in range(20))}" for m in middles for _ in range(100)]
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)  # one block, of more texts than a dictionary of the file holds
    S.minhash_candidates(spark.createDataFrame([(k,) for k in texts], "k string"), "k").write.parquet(str(tmp_path / "pairs"))
    spark.conf.set("spark.sql.shuffle.partitions", given)
    pairs = {tuple(r) for r in spark.read.parquet(str(tmp_path / "pairs")).collect()}
    n = spark.read.parquet(str(tmp_path / "pairs")).count()
    assert len(pairs) == n > 0.95 * 30 * 4950 and all(x < y and x.split()[20:60] == y.split()[20:60] for x, y in pairs)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").rglob("*.parquet")) < 115 * n


def test_contamination_join_is_exact(spark):
    a, b = sorted(set(near_texts(40, 1))), sorted(set(near_texts(40, 1)[::3] + near_texts(10, 2)))
    frame = lambda x: spark.createDataFrame([(k,) for k in x], "k string")
    got = S.contamination_matches(frame(a), "k", frame(b), "k", 0.85)
    assert rows(got, "candidate", "reference") == sorted(((x, y) for x in a for y in b if similar(x, y, 0.85)), key=str)
    assert rows(S.contamination_matches(frame([]), "k", frame(b), "k")) == []


def test_document_lines_are_keyed_like_questions(spark, tmp_path):
    """Full-width letters, ligatures and decomposed accents; the keys are written out by hand."""
    question = "A caf\u00e9 sells five fine office chairs for 12.5 dollars each day of the week"
    key = "a caf sells five fine office chairs for 12.5 dollars each day of the week"
    lines = [question.replace("\u00e9", "e\u0301"), question.replace("fi", "\ufb01"), "".join(chr(ord(c) + 0xFEE0) if "a" <= c.lower() <= "z" else c for c in question), "nothing of it"]
    spark.createDataFrame([(1, "\n".join(lines[:2])), (2, lines[2] + "\n\n" + lines[3]), (3, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, question)], "item_id bigint, question string").write.parquet(str(tmp_path / "eval_items.parquet"))
    got = registry.QUERIES["contamination_document_lines"](spark, str(tmp_path))
    assert rows(got) == [(key, key, "exact")]
    for k, line in enumerate(lines[:3]):
        spark.createDataFrame([(1, line)], "doc_id bigint, text string").write.parquet(str(tmp_path / str(k) / "documents.parquet"))
        spark.createDataFrame([(1, question)], "item_id bigint, question string").write.parquet(str(tmp_path / str(k) / "eval_items.parquet"))
        assert rows(registry.QUERIES["contamination_document_lines"](spark, str(tmp_path / str(k)))) == [(key, key, "exact")]


def test_range_lookup(spark):
    r = spark.createDataFrame([(0, 0, 3), (1, 3, 3), (2, 3, 200)], "s int, a bigint, b bigint")
    got = U.range_lookup(spark.range(0, 210), "id", r, "a", "b", 64)
    assert rows(got, "id", "s") == sorted([(i, 0 if i < 3 else 2) for i in range(200)], key=str)


def test_shards_cover_a_table_of_any_size(spark, tmp_path):
    for n in (0, 1, 37, 38, 5000):
        spark.range(n).withColumnRenamed("id", "vec_id").write.parquet(str(tmp_path / str(n) / "embeddings.parquet"))
        got = registry.QUERIES["shard_range_lookup"](spark, str(tmp_path / str(n)))
        assert rows(got) == sorted([(i, i // 37, i % 37) for i in range(n)], key=str)


def test_sampling_and_split(spark):
    d = spark.createDataFrame([("s", f"k{i % 25}") for i in range(60)] + [("t", "z"), ("t", None)], "s string, k string")
    picked = U.sample_keys(d, ["s"], "k", 0.10, "1")
    assert picked.groupBy("s").count().collect()[0]["count"] == 3 and picked.count() == 3
    split = U.split_by_group(d, "k", picked.select(F.col("key").alias("k")))
    assert split.count() == d.count() and {r[0] for r in split.where("split = 'validation'").select("k").collect()} == {r.key for r in picked.collect()}


def test_quality_reasons(spark):
    item = {f: {"score": 5, "justification": "x"} for f in U.JUDGED}
    tests, states = json.dumps(["t"] * 10), json.dumps(["pass"] * 10)
    low = {**item, U.JUDGED[0]: {"score": 3, "justification": "x"}}
    frame = lambda *data: spark.createDataFrame(list(data), "a string, b string, c string, d string").select(U.quality_reason("a", "b", "c", "d"))
    data = [(json.dumps(item), tests, states, "1.0"), (json.dumps(low), tests, states, "1.0"), (None, tests, states, "1.0"), (json.dumps(item), tests, states, "0.9")]
    assert [r[0] for r in frame(*data).collect()] == ["", "judge_score_below_4", "missing_metadata", "inconsistent_average_test_score"]
    real = {**item, U.JUDGED[0]: {"score": 4.0, "justification": "x"}}
    for bad, name in (((json.dumps(real), tests, states, "1.0"), "score"), ((json.dumps(item), "[]", states, "1.0"), "unit_tests"), (("{", tests, states, "1.0"), "serialized")):
        with pytest.raises(Exception, match=name):
            frame(bad).collect()


def test_groups_are_attached_and_splits_are_checked(spark):
    groups = spark.createDataFrame([("a", "g0"), ("b", "g1")], "node string, problem_group_id string")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, i int")
    assert rows(U.attach_groups(df, "k", groups), "i", "problem_group_id") == [(1, "g0"), (2, "g1")]
    with pytest.raises(Exception, match="no group for the key c"):
        U.attach_groups(spark.createDataFrame([("c", 1)], "k string, i int"), "k", groups).collect()
    with pytest.raises(ValueError):
        U.require_split(spark.createDataFrame([("g", "train")], "g string, split string"), "g", "split")
    with pytest.raises(ValueError):
        U.require_split(spark.createDataFrame([("g", "train"), ("g", "validation")], "g string, split string"), "g", "split")


def test_pass_at_k(spark):
    d = spark.createDataFrame([(1, i, i < 2) for i in range(4)], "q int, s int, c boolean")
    assert [round(r.pass_at_k, 6) for r in M.subset_pass_at_k(d, [], "q", "c").orderBy("k").collect()] == [50.0, 83.333333, 100.0, 100.0]
    assert M.pass_at_1(d.where("s = 0"), [], "s", "c").first().sd is None


def test_text_overlap(spark):
    d = spark.createDataFrame([(1, "a b c d e".split(), "a b c d f".split()), (2, ["a"], [])], "k int, h array<string>, r array<string>")
    assert [r[0] for r in d.select(M.rouge_l("h", "r")).collect()] == [80.0, 0.0]
    assert rows(M.rouge_n(d, "k", "h", "r", 2), "k", "f1") == [(1, 75.0), (2, 0.0)]
    same = spark.createDataFrame([(1, "a b c d e".split(), "a b c d e".split())], "k int, h array<string>, r array<string>")
    assert M.corpus_bleu(same, "k", "h", "r").first().bleu == pytest.approx(100.0)
    assert M.token_entropy(spark.createDataFrame([(1, [1, 2])], "k int, x array<int>"), "k", "x").first().entropy == pytest.approx(math.log(2))


def test_runs(spark):
    d = spark.createDataFrame([("a", 0), ("a", 1), ("a", 3)], "g string, i int")
    assert rows(R.sequence_gaps(d, ["g"], "i")) == [("a", 1, 3)]
    new = spark.createDataFrame([("a", 1), ("b", 1), ("b", 1), (None, 2)], "g string, i int")
    assert rows(R.append_once(d, new, ["g", "i"])) == [("b", 1), (None, 2)]
    assert R.manifest_mismatches({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": 0}, ignored=("c",)) == ["b"]


def test_jsonl(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"id": 1}\n\n{"id": 2}\n{"id": 3')
    assert rows(jsonl.read_log(spark, str(p), "id int")) == [(1,), (2,)]
    p.write_text('{"id": 1}\n{"id": \n{"id": 3}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_log(spark, str(p), "id int").collect()
    p.write_text('{"id": 1}\n\n{"id": 3}\n')
    assert rows(jsonl.read_positions(spark, str(p), "id int").select("line_no", "row.id")) == [(0, 1), (2, 3)]
    jsonl.write_new(spark.range(2), str(tmp_path / "out"))
    with pytest.raises(Exception):
        jsonl.write_new(spark.range(2), str(tmp_path / "out"))
    jsonl.write_manifest(spark, {"b": 1, "a": 2}, str(tmp_path / "m.json"))
    assert list(json.loads((tmp_path / "m.json").read_text())) == ["a", "b"]


def test_columns(spark):
    with pytest.raises(ValueError):
        U.require_columns(spark.range(1), ["id", "x"])
    with pytest.raises(ValueError):
        U.require_empty(spark.range(1), "not empty")
    assert U.require_columns(spark.range(1), ["id"], exact=True).count() == 1


def test_streaming(spark, tmp_path):
    src = spark.createDataFrame([("Question: A b\nAnswer:", 1), ("Question: c\nAnswer:", 2), (None, 3)], "prompt string, id int")
    src.withColumn("at", F.lit("2024-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    refs = spark.createDataFrame([("a b",)], "k string")
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    kept = stream.drop_repeats(stream.drop_contaminated(s, "prompt", refs, "k"), ["id"], "at", "1 hour")
    q = kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("id")) == [(2,), (3,)]


def test_normalisers_are_idempotent(spark):
    d = spark.createDataFrame([(k,) for k in near_texts(10, 4) + ["A  B", "é x"]], "k string")
    for fn in (T.question_key, T.math_key, T.match_text):
        once = d.select(fn(F.col("k")).alias("k"))
        assert rows(once) == rows(once.select(fn(F.col("k"))))
