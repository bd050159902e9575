"""Golden rows of the text, answer, array and schedule functions."""

import pytest
from pyspark.sql import functions as F

from corpusops.functions import answers as A
from corpusops.functions import arrays as K
from corpusops.functions import code as P
from corpusops.functions import schedules as S
from corpusops.functions import text as T
from tests.conftest import rows


def values(spark, data, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*columns).collect()]


def one(spark, texts, fn):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(fn(F.col("x"))).collect()]


def test_question_key(spark):
    assert one(spark, ["Tom's 3.50, APPLES!", "½", "!!!", "", None, "１２ Ａ"], T.question_key) == ["tom s 3.50 apples", "1 2", None, None, None, "12 a"]


def test_math_and_match_keys(spark):
    assert one(spark, ["  A  +\tB ", "a b", None], T.math_key) == ["A + B", "a b", None]
    assert one(spark, ["A\r\n  b", "  ", None, "é"], T.match_text) == ["a b", None, None, "é"]


def test_question_of(spark):
    assert one(spark, ["Question: x\ny\nAnswer:", "x", None, "Question: \nAnswer:"], T.question_of) == ["x\ny", None, None, None]


def test_numeric_answer(spark):
    got = one(spark, [" 1,234 ", ".5", "-.5", "+3", "3 / 4", "-1,000/2", "1/0", "5.", "1,23", "1234,567", "$5", "", None], A.numeric_answer)
    assert [(r.value, r.reason) for r in got] == [
        ("1234", ""), ("0.5", ""), ("-0.5", ""), ("+3", ""), ("3/4", ""), ("-1000/2", ""), (None, "zero_fraction_denominator"), *[(None, "unsupported_answer")] * 4, (None, "missing_answer"), (None, "missing_answer"),
    ]


def test_targets(spark):
    got = values(spark, [("x", "5"), ("", "5"), ("x\n#### 9", "5"), ("#### 1\nmore", "5"), (None, "5"), ("x", None), ("x #### 1 #### 2", "5")], "x string, g string", A.target(F.col("x"), F.col("g")).alias("r"))
    assert [(r[0].value, r[0].reason) for r in got] == [
        ("x\n#### 5", ""), ("#### 5", ""), ("x\n#### 5", ""), (None, "answer_marker_in_rationale"), (None, "missing_solution"), (None, "invalid_target"), ("x\n#### 5", ""),
    ]


def test_canonical_response(spark):
    got = one(spark, ["so\nThe answer is: 7", "none", "x The answer is: 5\n6", None], lambda c: A.canonical_response(c, A.SAYS, "missing_terminal_answer_marker", True))
    assert [(r.gold, r.reason) for r in got] == [("7", ""), (None, "missing_terminal_answer_marker"), (None, "multiline_answer"), (None, "missing_solution")]


def test_strict_and_permissive(spark):
    texts = ["a #### 5", "#### 1,200", "#### 5.", "####5", "x #### 5 #### 6", "#### 3/4", "The answer is: 7 apples, 8 total", "I have 3 and 4", "none", "", None]
    assert one(spark, texts, A.strict_answer) == ["5", "1200", None, None, "6", "3/4", None, None, None, None, None]
    assert one(spark, texts, A.permissive_answer) == ["5", "1200", "5", "5", "6", "3/4", "7", "4", None, None, None]


def test_same_number(spark):
    got = values(spark, [("5.0", "5"), ("3/4", "0.75"), ("x", "x"), ("1/0", "1/0"), ("$1,000.", "1000"), (None, "1")], "a string, b string", A.same_number(F.col("a"), F.col("b")))
    assert [r[0] for r in got] == [True, True, True, True, True, None]


def test_same_number_keeps_all_digits(spark):
    pairs = [("0.33333", "0.33334", False), ("0.12345678901", "0.12345678902", False), ("1/3", "0.3333333333", False), ("2/6", "1/3", True), ("0.500000000000", ".5", True), ("-7/2", "-3.5", True), ("1" * 45, "1" * 44 + "2", False), ("1/", "1/", True), ("1e2", "100", True)]
    got = values(spark, [p[:2] for p in pairs], "a string, b string", A.same_number(F.col("a"), F.col("b")))
    assert [r[0] for r in got] == [p[2] for p in pairs]


def test_choices(spark):
    assert one(spark, [" b ", "E", None], A.choice_letter) == ["B", None, None]
    texts = ["why\nFinal answer: C", "Final answer: A\nFinal answer: B", "final ANSWER : d", None]
    assert one(spark, texts, lambda c: A.rationale_choice(c, True)) == ["C", None, None, None]
    assert one(spark, texts, lambda c: A.rationale_choice(c, False)) == ["C", "B", "D", None]


def test_tex(spark):
    texts = ["\\frac{1}{2}", "{a", "a}", "5\\%", "5%", "\\$5", "$5$", "}%", None]
    assert one(spark, texts, A.tex_problem) == ["", "unbalanced_braces", "unbalanced_braces", "", "unescaped_percent", "", "unescaped_dollar", "unbalanced_braces", "missing_answer"]
    amp = ["a & b", "\\begin{pmatrix}1 & 2\\end{pmatrix}", "\\begin{pmatrix}1 & 2", "\\begin{x}", None]
    assert one(spark, amp, P.tex_alignment) == ["unescaped_ampersand", "", "invalid_alignment_environment", "", None]


def test_ngrams_and_measures(spark):
    d = spark.createDataFrame([(["a", "b", "a", "b"],), (["a"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in d.select(T.word_ngrams(F.col("w"), 2)).collect()] == [["a b", "b a"], [], [], None]
    got = values(spark, [("abcdefghi", "abcdefghij"), ("x", "x"), ("x", "y"), ("", "")], "a string, b string", T.substring_coverage(F.col("a"), F.col("b")))
    assert [r[0] for r in got] == [0.9, 1.0, 0.0, 1.0]


def test_extract_response(spark):
    d = spark.createDataFrame([([7, 7, 1, 2, 9, 3], 2), ([7], 2), ([], 0), (None, 1)], "x array<int>, n int")
    got = [r[0] for r in d.select(K.extract_response(F.col("x"), F.col("n"), 4, 9, 0)).collect()]
    assert [(r.ids, r.eos, r.length) for r in got[:3]] == [([1, 2, 0, 0], True, 3), ([0, 0, 0, 0], False, 0), ([0, 0, 0, 0], False, 0)] and got[3].ids is None


def test_array_kernels(spark):
    d = spark.createDataFrame([([1, 2, 3, 2],)], "x array<int>")
    x = F.col("x")
    r = d.select(K.pad_or_cut(x, 6, 0), K.before_first(x, 2), K.shift_left(x, F.lit(2), 0), K.find_unique(x, F.array(F.lit(2), F.lit(3))), K.find_unique(x, F.array(F.lit(2)))).first()
    assert tuple(r) == ([1, 2, 3, 2, 0, 0], [1, 1, 0, 0], [3, 2, 0, 0], 2, None)
    masks = d.select(K.attention_mask(F.lit(1), F.lit(2), 3, "causal"), K.attention_mask(F.lit(1), F.lit(2), 3, "directional")).first()
    assert masks[0] == [[1, 0, 0], [1, 1, 0], [0, 0, 0]] and masks[1] == [[1, 0, 0], [1, 1, 0], [0, 0, 0]]


def test_vectors(spark):
    d = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = d.select(K.cosine_distance(F.col("a"), F.col("b")), K.smooth_l1(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == 1.0 and got[1][0] is None and got[0][1] == pytest.approx(0.975)


def test_draws_do_not_depend_on_partitions(spark):
    a = spark.range(100).select("id", K.uniform(F.col("id"), seed=1).alias("u"))
    assert rows(a) == rows(spark.range(100).repartition(7).select("id", K.uniform(F.col("id"), seed=1).alias("u")))
    assert all(0 < u < 1 for _, u in rows(a))


def test_schedules(spark):
    assert spark.range(500, 501).select(S.ema_decay(F.col("id"), 0.999, 1000)).first()[0] == pytest.approx(0.998001, abs=1e-6)
    d = spark.createDataFrame([(10, 0), (10, 3), (2, 3)], "n bigint, r bigint").select(S.rank_ranges(F.col("n"), 4, F.col("r")).alias("x"))
    assert [(r.x.start, r.x.end) for r in d.collect()] == [(0, 3), (9, 10), (2, 2)]


def test_code(spark):
    texts = ["```python\nx = 1\n```", "def f(:", "", "def f():\n    return 1", None]
    code = spark.createDataFrame([(t,) for t in texts], "x string").select("x", P.unfenced(F.col("x")).alias("c"))
    assert [r[0] for r in code.select(P.code_problem(F.col("c"), F.col("x"))).collect()] == ["", "invalid_python", "missing_code", "", "output_must_be_string"]
    d = spark.createDataFrame([("def f(x):\n  return x", "assert f(1) == 1"), ("def f(): pass", "g()"), (None, None)], "a string, b string")
    assert [r[0] for r in d.select(P.entry_point(F.col("a"), F.col("b"))).collect()] == ["f", None, None]
    assert [r[0].changed for r in d.select(P.with_alias(F.col("a"), F.lit("solution"))).collect()] == [1, 1, 0]
    assert one(spark, ["import os\nx = [y for y in z]", "bad ("], P.module_bindings) == [["os", "x"], []]


def test_stems_of_the_publication():
    from corpusops.functions.stem import stem

    pairs = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam digitizer:digit operator:oper feudalism:feudal hopefulness:hope formality:formal triplicate:triplic electrical:electr goodness:good revival:reviv allowance:allow adjustment:adjust adoption:adopt effective:effect probate:probat rate:rate cease:ceas controlling:control rolling:roll the:the"
    for word, want in (p.split(":") for p in pairs.split()):
        assert stem(word) == want, word
