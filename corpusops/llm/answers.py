"""Problem 3: targets that do not properly answer their question, by tagging clauses with a conditional random field.

Method. A target is cut into clauses at line ends and sentence ends. Each clause gets features read in vector steps from
the code points of a batch: operators and digits, the share of its word triples found in the question, function words and
script of the question's language and of others, how it ends, whether the last number so far is the known answer, and its known
words. A linear-chain conditional random field tags the clauses as answer, refusal, echo, foreign, unfinished or blank (a
stand-in for no answer). Lines that only name the answer ("#### 12") stand outside the chain. The coverage of the tags, counted in
words, decides on the defect; a target is truncated when its last clause is unfinished.

The field is fitted on ``TRAIN_ROWS`` rows at most. Their labels are made, not given: rows whose last number is the known
answer are answers; cut within a clause, or after one before the answer is reached, they end unfinished; sentences of their
question in place of the target are an echo; targets told in another language than the question, as they are, by exchange or
with their letters moved to another script, are foreign; refusals are composed by a small grammar, and refusals of the sample itself (no
number, no words of the question, no clause seen in answers) are added; blank are the marks of missing values in tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusops.functions import text as T
from corpusops.llm import crf, forms
from corpusops.llm import words as W
from corpusops.llm.leak import words_of

ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, BLANK = range(6)
TAGS = 6
TRAIN_ROWS = 3000
VOCABULARY = 3000
SLICE_ROWS = 2000

# Articles, conjunctions, prepositions, forms of "to be" and pronouns by language, as public stop-word lists have them.
FUNCTION_WORDS = {
    "en": "the a an and or but if of at by for with to from in on is are was were be this that it he she they we",
    "de": "der die das den dem ein eine einen und oder aber wenn von mit zu aus in auf ist sind war nicht er sie es wir auch sich",
    "fr": "le la les un une des du de et ou mais si avec pour dans sur par est sont était ne pas il elle nous vous que qui",
    "es": "el la los las un una de del y o pero si con para por en es son era no se ella nosotros lo que como más su",
    "it": "il lo la gli le un una di del e o ma se con per da in è sono era non si egli noi che come più suo",
    "pt": "o a os as um uma de do da e ou mas se com para por em é são era não ele ela nós que como mais seu",
    "nl": "de het een en of maar als van met voor uit in op is zijn was niet hij zij wij ook dat die er aan bij naar nog",
}
# Marks of missing values that table readers know, and two of editors.
MISSING = "NA|N/A|n/a|<NA>|NaN|nan|None|none|NULL|null|nil|undefined|TODO|TBD|?|-|[empty]|(blank)"
# Parts of English sentences that decline a task; a refusal takes one of each. Written for this module from the grammar
# of such sentences: courtesy, subject and modal, verb, object, ground.
COURTESY = "|Sorry, |I'm sorry, but |Unfortunately, |My apologies, |As a language model, "
MODAL = "I cannot|I can't|I could not|I am unable to|I'm not able to|I will not|I won't|I refuse to|I must decline to|I would rather not|We cannot|It is impossible for me to"
VERB = "answer|solve|help with|assist with|respond to|work on|complete|discuss"
OBJECT = "this|that|it|this question|this problem|your request|the task|such exercises"
GROUND = "|because of my rules|as it is beyond my abilities|since I lack the knowledge|for reasons of policy|at this time"
# A second sentence of some: subject, verb, what stands against it.
SECOND = ("Doing so|That|This|Such a reply|A solution", "goes beyond|would conflict with|is outside of|is not part of", "my rules|my abilities|what I can do|the policy that I follow|what I may say")
# First letters of alphabets other than the Latin one, for made examples in another script.
ALPHABETS = (0x0391, 0x0430, 0x0561, 0x05D0, 0x0627, 0x0905, 0x0E01, 0x10D0, 0x3042, 0x4E00, 0xAC00)
#: Cumulative shares of made defects: cut in a clause, echo, refusal, other language, cut after a clause, other script.
SHARES = np.cumsum([0.2, 0.15, 0.15, 0.2, 0.15])
_OPERATORS = np.zeros(forms.TOP, bool)
_OPERATORS[[ord(c) for c in "=+*/×÷−"]] = True
_STOPS = np.zeros(forms.TOP, bool)
_STOPS[[ord(c) for c in ".!?;。！？"]] = True
_CLOSED = np.zeros(forms.TOP, bool)
_CLOSED[[ord(c) for c in ".!?。！？)]}$\"'»”’:"]] = True
_BLANK = np.zeros(forms.TOP, bool)
_BLANK[[9, 11, 12, 32, 0x2028, 0x2029]] = True


def _hash(text: str) -> np.ndarray:
    cps, off = forms.fold_all(*W.utf8(pa.array([text])))
    return words_of(cps, off)[0]


class Reader:
    """Features of batches of (question, target, answer)."""

    def __init__(self, vocabulary: np.ndarray) -> None:
        self.vocabulary = np.sort(vocabulary)
        self.languages = list(FUNCTION_WORDS)
        self.function = [np.sort(_hash(w)) for w in FUNCTION_WORDS.values()]
        self.marks = [_hash(w) for w in ("final answer", "the answer is", "answer")]

    def _words(self, texts: pa.Array):
        cps, off = forms.fold_all(*W.utf8(texts))
        return cps, off, *words_of(cps, off)

    def read(self, questions: pa.Array, targets: pa.Array, answers: pa.Array) -> dict:
        n = len(targets)
        q_cps, q_off, qh, qo, _, _ = self._words(questions)
        _, _, ah, ao, _, _ = self._words(answers)
        cps, off, h, ho, begin, end = self._words(targets)
        row = np.repeat(np.arange(n), np.diff(off))
        # clauses: cut before a character that follows a line end, or a stop and blanks
        line = cps == 10
        blank = _BLANK[cps] | line
        cut = np.zeros(len(cps) + 1, bool)
        cut[off[:-1]] = True
        if len(cps):
            cut[1:-1] |= line[:-1]
            cut[1:-1] |= _STOPS[cps[:-1]] & blank[1:]
        start = np.flatnonzero(cut[: len(cps)])
        clause_row = row[start] if len(start) else np.zeros(0, np.int64)
        stop = np.concatenate([start[1:], [len(cps)]]) if len(start) else start
        at_line = np.ones(len(start), bool)
        if len(start):
            at_line = (start == off[clause_row]) | line[np.maximum(start - 1, 0)]
        # the first and last characters that are not blank
        solid = np.flatnonzero(~blank) if len(cps) else np.zeros(0, np.int64)
        a, b = np.searchsorted(solid, start), np.searchsorted(solid, stop)
        full = b > a
        head = solid[np.minimum(a, max(len(solid) - 1, 0))] if len(solid) else np.zeros(len(start), np.int64)
        tail = solid[np.maximum(b - 1, 0)] if len(solid) else np.zeros(len(start), np.int64)
        start, clause_row, at_line, head, tail = (x[full] for x in (start, clause_row, at_line, head, tail))
        # words of each clause
        word_clause = np.searchsorted(start, begin, "right") - 1
        n_clauses = len(start)
        words = np.bincount(word_clause, minlength=n_clauses)
        w_first = np.searchsorted(word_clause, np.arange(n_clauses))
        size_at = lambda k, i: h[np.minimum(w_first + i, max(len(h) - 1, 0))] == k if len(h) else np.zeros(n_clauses, bool)
        hashes = np.zeros(n_clauses, bool)
        if n_clauses:
            wide = np.concatenate([cps, np.zeros(4, np.uint32)])
            hashes = (wide[head] == 35) & (wide[head + 1] == 35) & (wide[head + 2] == 35) & (wide[head + 3] == 35)
        mark_words = np.where(hashes, 0, -1)
        for m in self.marks[:2]:
            is_mark = at_line & (words >= len(m)) & (words <= len(m) + 12)
            for i, x in enumerate(m):
                is_mark &= size_at(x, i)
            mark_words = np.where(is_mark & ~hashes, len(m), mark_words)
        mark = (mark_words >= 0) & at_line
        named = mark & (words > mark_words)
        # numbers
        digit = (cps >= 48) & (cps <= 57)
        digits_before = np.concatenate([[0], np.cumsum(digit)])
        numeric = digit[begin] if len(begin) else np.zeros(0, bool)
        sums = lambda flag: np.concatenate([[0], np.cumsum(flag)])
        ops = sums(_OPERATORS[cps])
        has_digit = digits_before[tail + 1] - digits_before[head] > 0 if n_clauses else np.zeros(0, bool)
        has_op = ops[tail + 1] - ops[head] > 0 if n_clauses else np.zeros(0, bool)
        # share of word triples of the question
        in_q = self._echo(h, ho, qh, qo)
        echo = np.bincount(word_clause, in_q, n_clauses) / np.maximum(words, 1)
        # languages
        q_lang, q_count = self._language(qh, np.repeat(np.arange(n), np.diff(qo)), n)
        c_count = np.stack([np.bincount(word_clause, np.isin(h, f), n_clauses) for f in self.function], 1) if n_clauses else np.zeros((0, len(self.function)))
        best = c_count.argmax(1) if n_clauses else np.zeros(0, np.int64)
        own = c_count[np.arange(n_clauses), np.maximum(q_lang[clause_row], 0)] * (q_lang[clause_row] >= 0)
        other = c_count[np.arange(n_clauses), best]
        foreign = (other > own) & (best != q_lang[clause_row]) & (q_lang[clause_row] >= 0)
        script = self._script(cps, head, tail)
        q_script = self._script(q_cps, q_off[:-1], np.maximum(q_off[1:] - 1, q_off[:-1]))
        strange = (script != q_script[clause_row]) & (script > 0) & (q_script[clause_row] > 0)
        body = ~mark
        t_lang, t_count = self._language(h[body[word_clause]], np.repeat(np.arange(n), np.diff(ho))[body[word_clause]], n) if len(h) else (np.full(n, -1), None)
        turned = ((t_lang != q_lang) & (t_lang >= 0) & (q_lang >= 0))[clause_row]
        # ends
        last = np.zeros(n_clauses, bool)
        where = np.flatnonzero(body)
        if len(where):
            nxt = np.append(clause_row[where[1:]] != clause_row[where[:-1]], True)
            last[where[nxt]] = True
        firsts = np.zeros(n_clauses, bool)
        if len(where):
            firsts[where[np.append(True, clause_row[where[1:]] != clause_row[where[:-1]])]] = True
        tail_cp = cps[tail] if n_clauses else np.zeros(0, np.uint32)
        dots = np.zeros(n_clauses, bool)
        if n_clauses:
            before = cps[np.maximum(tail - 1, 0)]
            dots = (tail_cp == 0x2026) | ((tail_cp == 46) & (before == 46))
        closed = _CLOSED[tail_cp] & ~dots if n_clauses else np.zeros(0, bool)
        dangling = (_OPERATORS[tail_cp] | (tail_cp == 45) | dots | (tail_cp == 44)) if n_clauses else np.zeros(0, bool)
        w_last = np.maximum(w_first + words - 1, 0)
        answer = np.zeros(n, np.uint64)
        has_answer = np.diff(ao) > 0
        answer[has_answer] = ah[ao[1:][has_answer] - 1]
        # numbers of the body and of the lines that name the answer
        body_word = body[word_clause] if len(h) else np.zeros(0, bool)
        word_row = np.repeat(np.arange(n), np.diff(ho))
        last_number = np.zeros(n, np.uint64)
        at = np.flatnonzero(body_word & numeric)
        last_number[word_row[at]] = h[at]  # the last one stays
        mark_number = np.zeros(n, np.uint64)
        at = np.flatnonzero(~body_word & numeric)
        mark_number[word_row[at]] = h[at]
        expected = np.where(has_answer, answer, mark_number)
        ends_with = (words > 0) & (h[np.minimum(w_last, max(len(h) - 1, 0))] == expected[clause_row]) if len(h) else np.zeros(n_clauses, bool)
        ends_number = (words > 0) & numeric[np.minimum(w_last, max(len(h) - 1, 0))] if len(h) else np.zeros(n_clauses, bool)
        known_at = np.minimum(np.searchsorted(self.vocabulary, h), max(len(self.vocabulary) - 1, 0))
        known = self.vocabulary[known_at] == h if len(self.vocabulary) else np.zeros(len(h), bool)
        rare = 1 - np.bincount(word_clause, known, n_clauses) / np.maximum(words, 1)
        short, met = (expected != 0) & (last_number != expected), (expected != 0) & (last_number == expected)
        dense = np.stack([
            np.ones(n_clauses), has_digit, has_op, echo >= 0.6, (echo >= 0.25) & (echo < 0.6), words < 3, closed, dangling, last, last & ~closed,
            last & ~closed & ends_number & ends_with, foreign & (other >= 2), foreign & (other < 2), (own > 0) & ~foreign, strange, firsts, rare > 0.5, last & dangling, turned,
            last & short[clause_row], last & met[clause_row], firsts & last & (words < 4) & ~has_digit,
        ], 1).astype(np.float64)
        body_words = np.bincount(word_row, body_word, n)
        return {
            "n": n, "body": body, "clause_row": clause_row, "words": words, "dense": dense, "h": h, "word_clause": word_clause, "known": known, "known_at": known_at, "word_row": word_row,
            "body_word": body_word, "body_words": body_words, "named": np.bincount(clause_row, named, n) > 0, "answer": answer, "has_answer": has_answer, "expected": expected, "last_number": last_number, "ops": np.bincount(clause_row[body], has_op[body], n), "q_lang": q_lang, "t_lang": t_lang, "echo": echo, "strange": 2 * np.bincount(clause_row, strange, n) > np.bincount(clause_row, body, n),
        }

    def _language(self, h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        counts = np.stack([np.bincount(row, np.isin(h, f), n) for f in self.function], 1)
        return np.where(counts.max(1) >= 2, counts.argmax(1), -1), counts

    @staticmethod
    def _script(cps: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """1 for texts mostly in Latin letters, 2 for mostly in others, 0 without letters."""
        t = forms.tables()
        letter = t.letter[cps]
        latin = np.concatenate([[0], np.cumsum(letter & (cps < 0x250))])
        every = np.concatenate([[0], np.cumsum(letter)])
        stop = np.minimum(end + 1, len(cps))
        a, b = latin[stop] - latin[np.minimum(begin, len(cps))], every[stop] - every[np.minimum(begin, len(cps))]
        return np.where(b <= 0, 0, np.where(2 * a >= b, 1, 2))

    @staticmethod
    def _echo(h: np.ndarray, ho: np.ndarray, qh: np.ndarray, qo: np.ndarray) -> np.ndarray:
        """Marks the target words that lie in a word triple of their own question."""
        out = np.zeros(len(h), bool)
        if len(h) < 3 or len(qh) < 3:
            return out
        g, inside = W.windows(h, ho, 3)
        qg, q_inside = W.windows(qh, qo, 3)
        with np.errstate(over="ignore"):
            g = W.mix(g + np.repeat(np.arange(len(ho) - 1, dtype=np.uint64), np.diff(ho)) * np.uint64(0x9E3779B97F4A7C15))
            qg = W.mix(qg + np.repeat(np.arange(len(qo) - 1, dtype=np.uint64), np.diff(qo)) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(inside & np.isin(g, qg[q_inside]))
        for k in range(3):
            out[at + k] = True
        return out

    def batch(self, f: dict) -> tuple[crf.Batch, np.ndarray]:
        """The chain of body clauses, and their numbers among all clauses."""
        where = np.flatnonzero(f["body"])
        number = np.full(len(f["body"]), -1, np.int64)
        number[where] = np.arange(len(where))
        use = f["known"] & (number[f["word_clause"]] >= 0) if len(f["h"]) else np.zeros(0, bool)
        lengths = np.bincount(f["clause_row"][where], minlength=f["n"])
        return crf.Batch(lengths, f["dense"][where], number[f["word_clause"][use]], f["known_at"][use]), where


KINDS = np.array(["", "empty", "truncated", "refusal", "copied_question", "other_language"])


def defects(reader: Reader, model: crf.Model, questions: pa.Array, targets: pa.Array, answers: pa.Array) -> np.ndarray:
    """The defect of each target by the coverage of its clause tags; '' for none. No array holds nulls."""
    f = reader.read(questions, targets, answers)
    b, where = reader.batch(f)
    tag = crf.viterbi(model, b)
    row, size, n = f["clause_row"][where], np.maximum(f["words"][where], 1), f["n"]
    cover = np.stack([np.bincount(row[tag == k], size[tag == k], n) for k in range(TAGS)], 1)
    share = cover / np.maximum(cover.sum(1), 1)[:, None]
    out = np.zeros(n, np.int64)
    ends = np.flatnonzero(b.dense[:, 8] > 0) if len(where) else where
    out[row[ends[tag[ends] == UNFINISHED]]] = 2
    for label, least, kind in ((REFUSAL, 0.4, 3), (FOREIGN, 0.5, 5), (ECHO, 0.5, 4), (BLANK, 0.5, 1)):
        out[share[:, label] >= least] = kind
    bare = (f["body_words"] == 0) & (share[:, BLANK] < 0.5)
    out[bare] = np.where(f["named"][bare], 0, 1)
    return KINDS[out]


def fit(rows: list[tuple[str, str, str]], seed: int = 11) -> tuple[Reader, crf.Model]:
    """Reader and field from (question, target, answer) rows without nulls; see the module for how labels are made."""
    rng = np.random.default_rng(seed)
    plain = Reader(np.zeros(0, np.uint64))
    q, t, a = (pa.array([r[i] for r in rows] or [""], pa.string()) for i in range(3))
    f = plain.read(q, t, a)
    good = [i for i in np.flatnonzero((f["last_number"] == f["answer"]) & f["has_answer"] & (f["ops"] > 1)) if i < len(rows)]
    tail = re.compile(r"\n(?:####|Final answer:|The answer is:)[^\n]*\s*$")
    sentences = lambda s: [x for x in re.split(r"(?<=[.!?;])\s+|\n+", s) if x.strip()]
    made: list[tuple[str, str, str, int, bool]] = []  # question, target, answer, label, only the last clause has it
    seen: dict[str, int] = {}
    lang, told = f["q_lang"], f["t_lang"]
    body = {i: tail.sub("", rows[i][1]) for i in good}
    for i in good:
        turned = f["strange"][i] or (told[i] >= 0 and lang[i] >= 0 and told[i] != lang[i])
        made.append((rows[i][0], rows[i][1], rows[i][2], FOREIGN if turned else ANSWER, False))
        for s in sentences(body[i]):
            k = re.sub(r"[A-Z]\w+|\d+", "_", s)
            seen[k] = seen.get(k, 0) + 1
    parts_of = [x.split("|") for x in (COURTESY, MODAL, VERB, OBJECT, GROUND)]
    missing = MISSING.split("|")
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    by_lang: dict[int, list[int]] = {}
    for i in good:
        by_lang.setdefault(int(told[i]), []).append(i)
    for i in good:
        question, answer = rows[i][0], rows[i][2]
        kind = int(np.searchsorted(SHARES, rng.random()))
        if kind == 0 and len(body[i]) > 12:
            stop = int(rng.integers(6, len(body[i]) - 1))
            cut = body[i][:stop].rstrip()
            if cut and cut[-1] not in ".!?;\n" and body[i][stop : stop + 1] not in ("", "\n"):
                cut += ("", "", "...", "…")[rng.integers(0, 4)]
                made.append((question, cut, answer, UNFINISHED, True))
        elif kind == 1:
            parts = sentences(question)
            keep = parts if rng.random() < 0.6 else parts[: max(1, int(len(parts) * rng.uniform(0.6, 1)))]
            text = (" " if rng.random() < 0.7 else "\n").join(keep)
            text = (text.lower(), text, "Question: " + text, text + "\nAnswer:")[rng.integers(0, 4)]
            made.append((question, text, answer, ECHO, False))
        elif kind == 2:
            courtesy, modal, verb, what, ground = (pick(x) for x in parts_of)
            told_off = [f"{courtesy}{modal} {verb} {what}{' ' * bool(ground)}{ground}.", " ".join(pick(x.split("|")) for x in SECOND) + "."]
            told_off = (told_off[:1], told_off[1:], told_off, told_off[::-1])[rng.integers(0, 4)]
            made.append((question, " ".join(told_off), answer, REFUSAL, False))
        elif kind == 4:
            own = sentences(body[i])
            if len(own) > 1:  # whole sentences, but the answer is not reached
                made.append((question, " ".join(own[: int(rng.integers(1, len(own)))]), answer, UNFINISHED, True))
            made.append((question, pick(missing), answer, BLANK, False))
        elif kind == 5:
            first = ALPHABETS[rng.integers(0, len(ALPHABETS))]
            made.append((question, re.sub("[A-Za-z]", lambda m: chr(first + ord(m[0].lower()) - 97), body[i]), answer, FOREIGN, False))
        elif kind == 3:
            others = [x for x in by_lang if x != lang[i] and x >= 0]
            if lang[i] >= 0 and (not others or rng.random() < 0.3):  # languages that the sample does not hold
                pool = FUNCTION_WORDS[plain.languages[(int(lang[i]) + 1 + int(rng.integers(0, len(FUNCTION_WORDS) - 1))) % len(FUNCTION_WORDS)]].split()
                text = ". ".join(" ".join(pool[k] for k in rng.integers(0, len(pool), rng.integers(5, 12))) + f" {rng.integers(2, 999)}" for _ in range(rng.integers(1, 4)))
                made.append((question, f"{text} {answer}.", answer, FOREIGN, False))
            elif others and lang[i] >= 0:
                pool = by_lang[others[rng.integers(0, len(others))]]
                j = pool[rng.integers(0, len(pool))]
                made.append((question, body[j], rows[j][2], FOREIGN, False))
    known = set(good)
    for i in np.flatnonzero((told >= 0) & (lang >= 0) & (told != lang) & (f["last_number"] != 0)):
        if i < len(rows) and i not in known:
            made.append((*rows[i], FOREIGN, False))
    silent = np.flatnonzero((f["last_number"] == 0) & (f["body_words"] > 3))
    for i in silent:
        if i < len(rows):
            own = sentences(rows[i][1])
            if not any(seen.get(re.sub(r"[A-Z]\w+|\d+", "_", s), 0) for s in own):
                made.append((*rows[i], REFUSAL, False))
    q, t, a = (pa.array([m[i] for m in made] or [""], pa.string()) for i in range(3))
    f = plain.read(q, t, a)
    common, times = np.unique(f["h"], return_counts=True)
    reader = Reader(common[np.argsort(-times, kind="stable")][:VOCABULARY][: int((times >= 3).sum())])
    f = reader.read(q, t, a)
    b, where = reader.batch(f)
    label = np.array([m[3] for m in made] or [0])[f["clause_row"][where]]
    only_last = np.array([m[4] for m in made] or [False])[f["clause_row"][where]]
    label = np.where(only_last & (b.dense[:, 8] == 0), ANSWER, label)
    return reader, crf.train(b, label, TAGS, max(len(reader.vocabulary), 1))


def defective_pairs(df: DataFrame, id_col: str, prompt_col: str, target_col: str, answer_col: str, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, defect) of every row whose target is defective: empty, truncated, refusal, copied_question or other_language.

    A null target is empty. A null prompt or answer leaves the tests without the features that need it. The field is
    fitted on the driver from at most ``train_rows`` rows, chosen by the hash of their id; all rows are tagged. Rows
    without an id take no part; an empty table gives an empty result.
    """
    question = F.coalesce(T.question_of(F.col(prompt_col)), F.col(prompt_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), question.alias("q"), F.coalesce(F.col(target_col), F.lit("")).alias("t"), F.coalesce(F.col(answer_col), F.lit("")).alias("a")).where("id is not null")
    full = rows.where("t <> ''")
    n = rows.count()
    if n > 2 * train_rows:  # only about so many rows come into question; no task sends more than its part of them
        full = full.where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1_000_000)) < int(2_000_000 * train_rows / n))
    sample = full.orderBy(F.xxhash64("id"), "id").limit(train_rows).select("q", "t", "a").collect()
    reader, model = fit([tuple(r) for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                kind = defects(reader, model, part.column("q"), part.column("t"), part.column("a"))
                bad = kind != ""
                if bad.any():
                    yield pa.record_batch([part.column("id").filter(pa.array(bad)), pa.array(kind[bad].tolist(), pa.string())], ["id", "defect"])

    return rows.mapInArrow(run, "id bigint, defect string")
