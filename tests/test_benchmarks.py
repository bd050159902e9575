"""Benchmark building, program modes, settings, strict logs and ordered indexes."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from corpusops.functions import arrays as K
from corpusops.functions import code as P
from corpusops.functions import settings as C
from corpusops.functions.tokens import encoding, token_count
from corpusops.operators import curate as U
from corpusops.operators import runs as R
from corpusops.operators.ranking import ordered_index
from corpusops.sources import jsonl
from tests.conftest import rows


def test_program_modes():
    two = "def a(x):\n    return x\n\ndef b(x):\n    return a(x)"
    one, broken, none = "def a(x):\n    return x", "Here it is:\n```python\ndef w(x):\n    return x\n```\nDone it is", "x = 1"
    names = lambda code: P._bindings(code)
    assert P.transformed(two, "w", "raw") == (two, dict.fromkeys(P.COUNTERS, 0))
    assert "w" in names(P.transformed(one, "w", "alias_single")[0]) and P.transformed(two, "w", "alias_single")[1]["ambiguous"] == 1
    code, done = P.transformed(two, "w", "alias_last")
    assert code.endswith("w = b\n") and done["applied"] == 1
    assert P.transformed(none, "w", "alias_last")[1]["no_function"] == 1 and P.transformed(one, "a", "alias_single")[1]["existing_binding"] == 1
    assert P.transformed(broken, "w", "alias_single")[1]["invalid_source"] == 1
    for mode in ("valid_first", "sanitize", "valid_first_alias_single"):
        code, done = P.transformed(broken, "w", mode)
        assert names(code) == ["w"] and done["cleaned"] == 1
    code, done = P.transformed(one, "w", "sanitize_alias_single")
    assert set(names(code)) == {"a", "w"}
    assert done["cleaned"] == 2 and done["applied"] == 1
    with pytest.raises(ValueError):
        P.transformer("other")


def test_transformer_keeps_nulls(spark):
    d = spark.createDataFrame([("def a(): pass", "w"), (None, "w"), ("x", None)], "c string, w string")
    got = [r[0] for r in d.select(P.transformer("alias_single")("c", "w")).collect()]
    assert got[0].applied == 1 and got[1:] == [None, None]


def test_settings(monkeypatch):
    @dataclasses.dataclass
    class Inner:
        rate: float = 0.1
        sizes: list[int] = dataclasses.field(default_factory=list)

    @dataclasses.dataclass
    class Outer:
        name: str
        inner: Inner
        cap: int | None = None
        on: bool = False

    globals().update(Inner=Inner, Outer=Outer)
    got = C.parsed(Outer, {"name": "x", "inner": {"rate": 2.0}}, overrides={"inner.sizes": "[1, 2]", "cap": "none", "on": "yes", "inner.rate": "3"})
    assert got == Outer("x", Inner(3.0, [1, 2]), None, True)
    for values, removed in (({"name": "x", "inner": {}, "old": 1}, ()), ({"name": "x", "inner": {"rate": 1}, "cap": 1}, ("cap",)), ({"name": "x", "inner": {"no": 1}}, ())):
        with pytest.raises(ValueError):
            C.parsed(Outer, values, removed)
    assert C.optional_count("7", "n") == 7 and C.optional_count(" None ", "n") is None
    for bad in (0, "1.5", True, -2):
        with pytest.raises(ValueError):
            C.optional_count(bad, "n")
    assert C.beneath("a/./b/../c", "p") == "a/c"
    for bad in ("/a", "..", "a/../../b", " ", None):
        with pytest.raises(ValueError):
            C.beneath(bad, "p")
    assert C.decay_keys("0, 0.9990") == [None, "0.999"] and C.decay_label("0.999") == "ema0p999" and C.decay_label(None) == "raw" and C.decay_keys(None) is None
    assert C.pad_id(None, 2, True) == 2
    with pytest.raises(ValueError):
        C.pad_id(None, 2, False)
    monkeypatch.setenv("SOME_ROOT", "/shared")
    assert C.cache_root("/own", "SOME_ROOT") == "/shared" and C.cache_root("/own", "OTHER_ROOT") == "/own"


def test_tables_by_name(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "a"))
    listed = [{"name": "a", "path": str(tmp_path / "a")}]
    assert C.tables_of(spark, listed)["a"].count() == 2
    with pytest.raises(ValueError):
        C.tables_of(spark, listed * 2)


def test_strict_log_and_staged_writes(spark, tmp_path):
    fields = {"task_id": "string", "ok": "boolean"}
    p = tmp_path / "log.jsonl"
    p.write_text('{"task_id": "a", "ok": true, "more": 1}\n{"task_id": "b", "ok": false}\n')
    assert rows(jsonl.read_strict(spark, str(p), fields)) == [("a", True), ("b", False)]
    for line in ("", '{"task_id": 1, "ok": true}', '["a"]', '{"task_id": "a"}', '{"task_id": "a", "ok": tr'):
        p.write_text(f'{{"task_id": "a", "ok": true}}\n{line}\n{{"task_id": "b", "ok": true}}\n')
        with pytest.raises(Exception, match="contract"):
            jsonl.read_strict(spark, str(p), fields).collect()
    jsonl.write_staged(spark.range(3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3 and [x.name for x in tmp_path.iterdir() if "staged" in x.name] == []
    with pytest.raises(FileExistsError):
        jsonl.write_staged(spark.range(3), str(tmp_path / "out"))


def test_long_log_is_numbered_over_its_blocks(spark, tmp_path):
    p = tmp_path / "long.jsonl"
    p.write_text("\n".join(json.dumps({"id": i}) if i % 7 else "" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = jsonl.read_positions(spark, str(p), "id int").select("line_no", "row.id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 4000 - 572 and all(r.line_no == r.id for r in got)


def test_ordered_index(spark):
    d = spark.createDataFrame([("b", 2), ("a", 5), (None, 1), ("a", 1), ("c", 0)], "s string, i int")
    assert rows(ordered_index(d, ["s", "i"], "at"), "at", "s") == sorted([(0, None), (1, "a"), (2, "a"), (3, "b"), (4, "c")], key=str)
    assert rows(ordered_index(d.limit(0), ["s", "i"], "at")) == []


def test_finalize_refuses_open_targets(spark):
    frame = lambda *t: spark.createDataFrame([(x, "5", i) for i, x in enumerate(t)], "target string, gold string, i int")
    good = U.finalize(frame("x\n#### 5", "y\nFinal answer: $\\boxed{5}$"), ["i"], "target", "gold")
    assert rows(good, "index", "i") == [(0, 0), (1, 1)]
    for bad in ("x\n#### 6", None):
        with pytest.raises(Exception, match="without its answer"):
            U.finalize(frame("x\n#### 5", bad), ["i"], "target", "gold").collect()


def test_masks_and_averages(spark):
    d = spark.createDataFrame([([1.0, 2.0, 4.0], [1.0, 0.0, 1.0]), ([], []), ([3.0], [0.0])], "v array<double>, m array<double>")
    assert [r[0] for r in d.select(K.averaged(F.col("v"), 0.5)).collect()] == [2.75, None, 3.0]
    assert [tuple(r[0]) for r in d.select(K.masked_mean(F.col("v"), F.col("m"))).collect()] == [(2.5, 2 / 3), (0.0, 0.0), (0.0, 0.0)]
    one = spark.range(1)
    assert one.select(K.valid_mask(F.lit(2), 1, 5)).first()[0] == [1, 1, 1, 0, 0] and one.select(K.valid_mask(F.lit(2), None, 3)).first()[0] == [1, 1, 1]
    assert one.select(K.drop_condition(F.array(F.lit(1), F.lit(2), F.lit(0)), F.lit(True))).first()[0] == [0, 2, 0]


def test_token_counts(spark):
    texts = ["", None, "a b", "ж" * 50, "<|endoftext|>"]
    want = [None if t is None else len(encoding().encode_ordinary(t)) for t in texts]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"))).collect()] == want


def test_checks_raise(spark):
    d = spark.createDataFrame([("T/1", "x"), ("T/2", "y")], "task string, v string")
    assert U.require_release(d, 2, "task", "T/", ["v"]).count() == 2
    for bad in (lambda: U.require_release(d, 3, "task", "T/", ["v"]), lambda: U.require_release(d, 2, "task", "U/", ["v"]), lambda: U.require_release(d.union(d), 4, "task", "T/", ["v"]),
                lambda: U.fixed_subset(d, 3, "1", "task", ["task"]), lambda: U.require_sample(d.limit(0), d), lambda: U.require_sample(d, d)):
        with pytest.raises(ValueError):
            bad()
    assert U.fixed_subset(d, 1, "1", "task", ["task"]).count() == 1 and U.require_sample(d.limit(1), d).count() == 1
    s = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "g string, i int")
    assert R.require_sequence(s, ["g"], "i").count() == 3
    for more in ([("a", 3)], [("b", 0)], [("c", 1)]):
        with pytest.raises(ValueError):
            R.require_sequence(s.union(spark.createDataFrame(more, "g string, i int")), ["g"], "i")
    with pytest.raises(Exception, match="aligned"):
        R.require_aligned(spark.createDataFrame([(1, 1), (2, 3)], "a int, b int"), "a", "b").collect()


def test_chat_positions(spark):
    d = spark.createDataFrame([([5, 6], [7]), ([], [8, 9])], "c array<int>, r array<int>")
    got = d.select(K.chat_positions(2, F.col("c"), 1, F.col("r")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [([2, 3], [5]), ([], [3, 4])]
