"""The training-data operators against brute force, planted cases and awkward tables."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusops.llm import answers, forms, leak, mixing, neardup, overlap, packing
from corpusops.llm import words as W
from tests.conftest import rows


def near_same(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    shared = sum((x & y).values())
    return shared / (sum(x.values()) + sum(y.values()) - shared)


def questions(n, seed, length=(6, 60)):
    """Texts over a small vocabulary with boilerplate, and lightly changed versions with sentences moved."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(*length))] + "how many are left at the end of the day".split()
        out.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            other = list(base)
            for _ in range(max(1, len(other) // 25)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                k = rng.randrange(len(other))
                other = other[k:] + other[:k]
            out.append(" ".join(other))
    rng.shuffle(out)
    return out


def clear(keys, low=0.70, high=0.79):
    """Leaves out texts with a similarity in the gap in which nothing is promised."""
    kept = []
    for k in keys:
        if all(not low <= near_same(k, x) < high for x in kept):
            kept.append(k)
    return kept


def test_windows_do_not_cross_texts():
    h, off = W.word_hashes(pa.array(["a b c", "", "b c a b c"]))
    g, inside = W.windows(h, off, 3)
    assert list(off) == [0, 3, 3, 8] and inside.sum() == 4 and g[0] == g[5]
    assert W.multiset_overlap(pa.array(["a a b"]), pa.array(["a b b"]))[0].tolist() == [2]


def test_cross_split_pairs_against_brute_force(spark):
    keys = clear(questions(45, 5))
    rng = random.Random(2)
    data = [(i, rng.choice(["train", "train", "test", "validation"]), k, "x") for i, k in enumerate(keys)]
    data += [(1000 + i, rng.choice(["train", "test"]), keys[0], "copy") for i in range(40)]  # a hot group of copies
    data += [(2000, "train", None, ""), (2001, "test", "", ""), (2002, None, keys[0], ""), (None, "test", keys[0], "")]
    df = spark.createDataFrame([(a, b, None if k is None else f"Question: {k}\nAnswer:", r) for a, b, k, r in data], "final_id bigint, split string, input string, rep string")
    got = overlap.cross_split_pairs(overlap.keyed_rows(df, "final_id", "split", "input"))
    whole = [(a, b, k) for a, b, k, _ in data if a is not None and b and k]
    want = {(min(x[0], y[0]), max(x[0], y[0])) for x in whole for y in whole if x[1] == "train" != y[1] and near_same(x[2], y[2]) >= 0.75}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == len(want) > 50
    records = overlap.record_overlap(overlap.keyed_rows(df, "final_id", "split", "input"))
    report = overlap.overlap_report(df, records, "final_id", "split", "rep")
    assert sum(r.pairs for r in report.collect()) == 2 * len(want)
    per = {r.id: r for r in records.collect()}
    assert set(per) == {x[0] for x in whole} and all((r.pairs > 0) == any(i in p for p in want) for i, r in per.items())
    assert all(r.coverage == 1.0 for r in per.values() if r.copied)
    assert rows(overlap.record_overlap(overlap.keyed_rows(df.limit(0), "final_id", "split", "input"))) == []
    assert rows(overlap.cross_split_pairs(overlap.keyed_rows(df.limit(0), "final_id", "split", "input"))) == []


def test_large_family_of_variants_is_paired_whole(spark):
    """10 held-out and 40 training variants of one question, against brute force."""
    for words, edits in ((30, 1), (41, 2), (90, 5)):
        rng = random.Random(words)
        base = [f"f{i}" for i in range(words)]
        keys = set()
        while len(keys) < 50:
            other = list(base)
            for k in rng.sample(range(words), edits):
                other[k] = f"x{rng.randrange(10**6)}"
            keys.add(" ".join(other))
        data = [(i, 2 if i < 10 else 1, k) for i, k in enumerate(sorted(keys, key=lambda k: rng.random()))]
        want = {(x[0], y[0]) for x in data for y in data if x[1] == 2 and y[1] == 1 and near_same(x[2], y[2]) >= 0.75}
        found = [tuple(r) for r in overlap.cross_split_pairs(spark.createDataFrame(data, "id bigint, side bigint, key string")).collect()]
        assert set(found) == want and len(found) == len(want) == 400


@pytest.mark.parametrize("held, train", [(20, 20), (60, 20), (1, 1000)])
def test_templated_questions_are_paired_whole(spark, held, train):
    """72 words of one template of which eight numbers differ: every pair has the similarity 0.8."""
    number = iter(range(10**6, 10**7))
    template = [f"t{i % 50}" for i in range(72)]
    data = []
    for i in range(held + train):
        words = list(template)
        for k in range(8):
            words[9 * k] = str(next(number))
        data.append((i, 2 if i < held else 1, " ".join(words)))
    got = overlap.cross_split_pairs(spark.createDataFrame(data, "id bigint, side bigint, key string"))
    assert got.distinct().count() == got.count() == held * train


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    sizes = [30, 1, 25, 0, 40]
    off = np.concatenate([[0], np.cumsum(sizes)])
    x, end = rng.integers(0, 3, off[-1]).astype(np.uint64), np.repeat(off[1:], sizes)
    order, ranks = overlap.suffix_array(x, end)
    assert [tuple(x[i : end[i]]) for i in order] == sorted(tuple(x[i : end[i]]) for i in range(len(x)))
    i, j = rng.integers(0, len(x), 300), rng.integers(0, len(x), 300)
    prefix = [next((k for k in range(min(end[a] - a, end[b] - b)) if x[a + k] != x[b + k]), min(end[a] - a, end[b] - b)) for a, b in zip(i, j)]
    assert overlap.common_prefix(ranks, i, j, end).tolist() == prefix


def test_coverage_is_the_union_over_all_linked_texts(spark):
    words = [f"c{i}" for i in range(40)]
    one, two = words[:36] + ["x1", "x2", "x3", "x4"], ["y1", "y2", "y3", "y4"] + words[4:]
    data = [(1, 2, " ".join(words)), (2, 1, " ".join(one)), (3, 1, " ".join(two))]
    got = {r.id: r for r in overlap.record_overlap(spark.createDataFrame(data, "id bigint, side bigint, key string")).collect()}
    assert (got[1].links, got[1].coverage) == (2, 1.0) and got[2].coverage == got[3].coverage == 0.9


def test_reordered_texts_and_regular_changes_are_paired(spark):
    """No run of five shared words is left in the first, none of ten in the second."""
    rng = random.Random(8)
    data = []
    for k, n in enumerate((60, 70, 80, 100)):
        base = [f"t{k}w{i}" for i in range(n)]
        mixed = list(base)
        rng.shuffle(mixed)
        changed = [f"y{k}n{i}" if i % 8 == 7 else w for i, w in enumerate(base)]
        data += [(10 * k, 2, " ".join(base)), (10 * k + 1, 1, " ".join(mixed)), (10 * k + 2, 1, " ".join(changed))]
    got = overlap.cross_split_pairs(spark.createDataFrame(data, "id bigint, side bigint, key string"))
    assert rows(got) == sorted(((10 * k, 10 * k + j) for k in range(4) for j in (1, 2)), key=str)


def test_bagminhash_estimates_multiset_similarity():
    rng = random.Random(0)
    keys = []
    for _ in range(60):
        base = [f"v{rng.randrange(30)}" for _ in range(rng.randrange(1, 80))]
        keys += [" ".join(base), " ".join(base[: max(1, len(base) * 3 // 4)] + [f"u{rng.randrange(9)}" for _ in range(rng.randrange(6))])]
    keys.append("a " * 500 + "b")
    sig = neardup.signatures(pa.array(keys), 1024)
    errors = [(sig[i] == sig[i + 1]).mean() - near_same(keys[i], keys[i + 1]) for i in range(0, 120, 2)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03
    alone = neardup.signatures(pa.array(keys[:1]), 1024)
    assert (alone == sig[:1]).all()  # a signature does not depend on its batch
    same = neardup.signatures(pa.array(["x y x", "y x x"]), 64)
    assert (same[0] == same[1]).all()


def test_near_duplicate_pairs_against_brute_force(spark):
    keys = clear(questions(45, 9))
    data = [(i, k, "e") for i, k in enumerate(keys)] + [(1000 + i, keys[3], "e") for i in range(30)] + [(2000, None, "n"), (2001, " ", "n"), (None, keys[0], "n")]
    df = spark.createDataFrame(data, "row_id bigint, question_key string, rep string")
    found = [tuple(r) for r in neardup.near_duplicate_pairs(df, "row_id", "question_key").collect()]
    whole = [(i, k) for i, k, _ in data if i is not None and k and k.strip()]
    want = {(a, b) for i, (a, x) in enumerate(whole) for b, y in whole[i + 1 :] if near_same(x, y) >= 0.75}
    assert set(found) == {(min(p), max(p)) for p in want} and len(found) == len(want) > 50
    groups = {r["id"]: r for r in neardup.near_duplicate_groups(df, "row_id", "question_key").collect()}
    assert set(groups) == {i for i, _ in whole} and all(groups[a].group_id == groups[b].group_id for a, b in want)
    assert rows(neardup.near_duplicate_pairs(df.limit(0), "row_id", "question_key")) == []


def test_forms_agree_with_canonical_composition():
    rng = random.Random(1)
    codes = [*range(0xC0, 0x17F), *range(0x300, 0x345), *range(0x1E00, 0x1E95), *range(0xAC00, 0xAC40), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), 0x61, 0x65, 0x9C7, 0x9BE]
    pool = [chr(c) for c in codes if not unicodedata.decomposition(chr(c)).startswith("<")]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(1500)]
    got = forms.consistent_forms(pa.array(texts)).to_pylist()
    assert [t if g is None else g for t, g in zip(texts, got)] == [unicodedata.normalize("NFC", t) for t in texts]


@pytest.mark.parametrize(
    "text, form",
    [("Ｆｕｌｌ １２", "Full 12"), ("Ѕаlе", "Sale"), ("ﬁ ﬂ ﬀ", "fi fl ff"), ("a​b­c﻿", "abc"), ("a b c", "a b c"), ("é", "é"), ("ÅK", "ÅK"), ("x‑y", "x-y"), ("a\r\nb\rc", "a\nb\nc"),
     ("Привет", None), ("Пpивeт", "Привет"), ("ёлка", "ёлка"), ("x² ½ ſ", None), ("օνеr ꓮꓐ Ꭺ", "over AB A"), ("բօլօր", None), ("ı", None), ("Αθήνα νέα", None), ("plain", None), ("", None), ("ё", "ë")],
)
def test_forms(text, form):
    assert forms.consistent_forms(pa.array([text])).to_pylist() == [form]


def test_forms_are_idempotent_and_keep_nulls(spark):
    texts = ["Ѕаlе", None, "", "Пpивeт é", "ź̧"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = [r[0] for r in df.select(forms.consistent_form(F.col("t"))).collect()]
    twice = [r[0] for r in spark.createDataFrame([(t,) for t in once], "t string").select(forms.consistent_form(F.col("t"))).collect()]
    assert once == twice and once[1] is None and once[2] == ""


def test_look_alike_pairs(spark):
    data = [(1, "Sale é", "a"), (2, "Ѕаlе é", "b"), (3, "Sale é", "c"), (4, "Sale é", "d"), (5, "sale é", "e"), (6, None, "f"), (7, "", "g"), (8, "", "h"), (None, "Ѕаlе é", "i")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, form string")
    assert rows(forms.look_alike_pairs(df, "doc_id", "text")) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4)]
    assert rows(forms.look_alike_pairs(df.limit(0), "doc_id", "text")) == []
    assert rows(forms.look_alike_classes(df, "doc_id", "text")) == sorted([(1, 1, 3, 4), (2, 1, 3, 4), (3, 1, 3, 4), (4, 1, 3, 4), (5, 5, 1, 1), (7, 7, 1, 2), (8, 7, 1, 2)], key=str)


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([15, 20, 21, 50])))) for i in range(30)]
    items += [(99, None), (98, ""), (97, items[1][1])]
    docs = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 30, 800]))]
        if i % 2:
            q = rng.choice(items[:30])[1].split()
            k = rng.randrange(len(q))
            part = q[max(0, k - rng.choice([10, 19, 30])) : k + rng.choice([1, 10, 30])]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rng.random() < 0.3 else x for x in part]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(500, None), (501, ""), (502, docs[1][1]), (None, items[1][1]), (503, items[1][1].replace("w", "ｗ"))]
    spark_docs = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, item string")
    spark_items = spark.createDataFrame(items, "item_id bigint, question string")

    def runs_of(text):
        w = re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text or "").lower())
        return {tuple(w[i : i + 20]) for i in range(len(w) - 19)}

    want = {(d, i) for d, text in docs if d is not None for i, q in items if runs_of(text) & runs_of(q)}
    for bits, many in ((24, spark_items), (16, spark_items.repartition(5))):
        got = leak.leaked_items(spark_docs, "doc_id", "text", many, "item_id", "question", most_bits=bits)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 8
    assert rows(leak.leaked_items(spark_docs, "doc_id", "text", spark_items.limit(0), "item_id", "question")) == []


def test_packing(spark):
    rng = random.Random(6)
    sizes = [(i, rng.choice([rng.randrange(1, 90), rng.randrange(1, 400), 40])) for i in range(900)] + [(2000, 0), (2001, None), (2002, 100), (2003, 200)]
    profiles = spark.createDataFrame([("a", 100, 1), ("b", 64, 3), ("c", 1000, None), ("bad", None, 1)], "profile string, capacity_tokens int, separator_tokens int")
    placed, report = packing.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens int"), profiles)
    room = {"a": (100, 1), "b": (64, 3), "c": (1000, 0)}
    bins, texts = {}, {}
    for r in placed.collect():
        texts.setdefault((r.profile, r.doc_id), []).append((r.first_token, r.n_tokens, r.container_id))
        if r.container_id is not None:
            bins.setdefault((r.profile, r.container_id), []).append(r.n_tokens)
    for (p, _), held in bins.items():
        assert sum(held) + room[p][1] * (len(held) - 1) <= room[p][0]
    for p in room:
        for i, n in sizes:
            parts = sorted(texts[p, i])
            assert sum(x[1] for x in parts) == (n or 0) and len(parts) == max(1, -(-(n or 0) // room[p][0]))
            assert [x[0] for x in parts] == [k * room[p][0] for k in range(len(parts))] and all((x[2] is None) == (not n) for x in parts)
    for r in report.collect():
        used = len({k for k in bins if k[0] == r.profile})
        assert r.containers == used and used <= 1.05 * r.least_containers + 2 and r.from_program <= used
    empty, none = packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int"), profiles)
    assert rows(empty) == [] and all(r.containers == 0 for r in none.collect())


def test_lower_bound_holds_and_the_program_packs_most():
    rng = np.random.default_rng(4)
    for capacity, separator in ((60, 0), (257, 1), (5000, 2)):
        lengths, counts = np.arange(1, capacity + 1), rng.integers(1, 60, capacity)
        plan, _ = packing.make_plan(lengths, counts, capacity, separator)
        assert -(-int(((lengths + separator) * counts).sum()) // (capacity + separator)) <= plan.bound <= plan.containers <= 1.025 * plan.bound + 1
        assert plan.from_program > 0.9 * plan.containers
    # nothing fits beside another: the bound counts them all, the volume would not
    plan, _ = packing.make_plan(np.array([51, 70]), np.array([10, 5]), 100, 0)
    assert plan.bound == plan.containers == plan.from_program == 15


def test_knapsack_is_exact():
    rng = np.random.default_rng(0)
    for _ in range(20):
        s, p, room = rng.integers(1, 9, 4), rng.random(4), int(rng.integers(5, 30))
        take = packing.knapsack(s, p, room)
        best = np.zeros(room + 1)
        for c in range(1, room + 1):
            best[c] = max([best[c - 1], *(best[c - x] + y for x, y in zip(s, p) if x <= c)])
        assert (take * s).sum() <= room and (take * p).sum() == pytest.approx(best[room])


def test_mixing(spark):
    rng = random.Random(8)
    data = [(i, rng.choice(["Alpha ", "alpha", "ALPHAS"]), rng.choice(["x", "y", None]), rng.randrange(50, 200)) for i in range(600)] + [(1000 + i, "beta", None, 100) for i in range(30)] + [(5000, None, None, 9), (5001, "beta", "z", None)]
    targets = [("m", "alpha", "x", 0.3, 1), ("m", "alpha", None, 0.3, 2), ("m", "Beta", None, 0.4, 3), ("n", "beta", None, 0.5, 2), ("n", "gone", None, 0.5, 9)]
    df = spark.createDataFrame(data, "id bigint, source string, source_subtype string, tokens int")
    spec = spark.createDataFrame(targets, "mix_name string, source string, source_subtype string, target_share double, max_repeats int")
    placed, report = mixing.mix(df, spec)
    got = {(r.mix_name, r.source, r.source_subtype): r for r in report.collect()}
    assert all(abs(got["m", s, t].reached_share - share) < 0.01 for m, s, t, share, _ in targets if m == "m")
    assert got["n", "gone", None].rows == 0 and got["n", "beta", None].reached_share == 1.0
    taken = Counter((r.mix_name, r.source, r.source_subtype, r.id) for r in placed.collect())
    caps = {(m, s, t): c for m, s, t, _, c in targets}
    assert all(n <= caps[k[:3]] for k, n in taken.items())
    assert len({(r.mix_name, r.slot, r.id, r.repeat_no) for r in placed.collect()}) == placed.count()
    beta = sum(r.tokens or 0 for r in placed.where("mix_name = 'm' and source = 'Beta'").collect())
    assert beta == pytest.approx(3 * 3000, rel=0.03)  # the scarce source is used up to its cap
    first = placed.where("mix_name = 'm'").orderBy("slot").limit(300).groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    assert {r.source: r.n / sum(x.n for x in first) for r in first}["Beta"] == pytest.approx(0.4, abs=0.12)  # shares hold early on
    assert rows(mixing.mix(df.limit(0), spec)[0]) == []


def solution(rng):
    n = rng.randrange(100, 900)
    q, steps = [f"Bel{rng.randrange(99)}a had {n} beads in a tin."], [f"At first there are {n} beads."]
    for _ in range(rng.randrange(2, 5)):
        k = rng.randrange(5, 60)
        q.append(f"Later on, {rng.choice(['Tomir', 'Lunka'])} brought {k} more beads from the shop.")
        steps.append(f"Adding {k} gives {n} + {k} = {n + k}.")
        n += k
    q.append("How many beads are there at the end of the day?")
    if rng.random() < 0.3:
        steps.insert(1, rng.choice(["I'm sorry for Tomir, but the story ends here.", "We can't ignore the shop, yet it plays no role."]))
    return " ".join(q), steps, str(n)


GERMAN = "Zuerst sind es {a} Perlen. Danach kommen noch {b} dazu, also sind es dann {c} Perlen und das ist die Antwort."
RUSSIAN = "Сначала было {a} бусин. Потом добавили {b}, поэтому стало {c} бусин, и это ответ."
GREEK = "Στην αρχή είναι {a} χάντρες. Μετά έρχονται άλλες {b} και τότε γίνονται {c}."


def test_broken_pairs_on_held_out_cases(spark):
    """Refusals share no phrase with the made ones; truncated solutions also break off after a whole sentence."""
    rng = random.Random(12)
    data, want = [], {}
    for i in range(700):
        q, steps, gold = solution(rng)
        target, kind = " ".join(steps) + rng.choice(["", f"\n#### {gold}", f"\nThe answer is: {gold}"]), None
        if i % 12 == 1:
            target, kind = rng.choice([None, "", " ​", "n/a", "####", "[no answer]"]), "empty"
        elif i % 12 == 2:
            body = " ".join(steps)
            cut = rng.choice([body[: rng.randrange(12, len(body) - 8)], " ".join(steps[:-1])])
            target, kind = cut + rng.choice(["", f"\n#### {gold}", "..."]), "truncated"
        elif i % 12 == 3:
            target, kind = rng.choice(["Nothing of that kind is done here, please ask a person you trust.", "You will get no reply to this from me. Have a nice day.", f"Sadly this is something a program should leave alone.\n#### {gold}"]), "refusal"
        elif i % 12 == 4:
            target, kind = rng.choice([q, q.lower(), "Question: " + q, q + f"\n#### {gold}"]), "copied_question"
        elif i % 12 == 5:
            target, kind = rng.choice([GERMAN, RUSSIAN, GREEK]).format(a=1, b=2, c=gold), "other_language"
        elif i % 12 == 6:
            target = f"#### {gold}"
        data.append((i, f"Question: {q}\nAnswer:", target, gold if rng.random() < 0.9 or kind == "truncated" else None, "x"))
        if kind:
            want[i] = kind
    df = spark.createDataFrame(data, "row_id bigint, input string, target string, gold_answer string, defect string")
    got = dict(tuple(r) for r in answers.defective_pairs(df, "row_id", "input", "target", "gold_answer").collect())
    assert sum(got.get(i) == k for i, k in want.items()) >= 0.95 * len(want)
    assert sum(i not in want for i in got) <= 0.02 * len(data)


def test_broken_pairs_on_awkward_rows(spark):
    schema = "row_id bigint, input string, target string, gold_answer string"
    df = spark.createDataFrame([(1, None, None, None), (2, "", "", ""), (None, "q", "t", "1"), (3, "Question: a\nAnswer:", "word " * 20000, None)], schema)
    got = dict(tuple(r) for r in answers.defective_pairs(df, "row_id", "input", "target", "gold_answer").collect())
    assert got[1] == got[2] == "empty" and None not in got
    assert rows(answers.defective_pairs(df.limit(0), "row_id", "input", "target", "gold_answer")) == []
