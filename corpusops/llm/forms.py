"""Problem 7: one consistent form for texts that look alike but differ in their characters.

Method. The texts of an Arrow batch are copied into one numpy array of code points. Lookup tables give each code point
its expansion (canonical decomposition, full-width and other typographic variants of the same letter, ligatures, spaces, nothing
for invisible characters, the Latin letter for a look-alike); gathers with expansion offsets apply them. Marks are put
into canonical order and composed with their letters in vector steps, one for each further mark of a letter. Words that
hold a letter found only in another script with look-alikes get the letters of that script back, so foreign text stays itself. No
call is made per row or string. Rows that hold no character of concern are not touched.

Letter case, accents and all visible differences are kept: superscripts, fractions, mathematical alphabets, dashes of other
lengths and quotation marks stay as they are.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusops.llm import words as W
from corpusops.runtime import written

# Letters that common typefaces draw as a Latin one, by script; after the script the code points of its letters.
# The rule: the same strokes at the same height, so that a reader cannot tell them from the Latin letter. Greek alpha, iota or the
# dotless i are told apart and stay.
ALIKE = (
    (range(0x400, 0x530), dict(zip("АВСЕНІЈКМОРЅТХУҮӀԌԚԜасеһіјорѕхуүӏԁԛԝѵ", "ABCEHIJKMOPSTXYYIGQWacehijopsxyyldqwv"))),
    (range(0x370, 0x400), dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνορϲϳ", "ABEZHIKMNOPTYXvopcj"))),
    (range(0x531, 0x590), dict(zip("ՍՏՕհոսօ", "USOhnuo"))),
    (range(0x13A0, 0x1400), dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏎᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZ4RWVSLCPKB"))),
    (range(0xA4D0, 0xA500), dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))),
)
# Hyphens drawn as the ASCII one; invisible characters beside those of category Cf.
HYPHENS = "‐‑"
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
LONG_S = "\u017f"  # the one compatibility letter that readers tell apart
TOP = 0x110000
PIECE_BYTES = 4_000_000


class Tables:
    """Lookup tables over all code points, built from the Unicode data of the interpreter by the rules above."""

    def __init__(self) -> None:
        alike = {ord(a): ord(b) for _, table in ALIKE for a, b in table.items()}
        alike[0x1C3] = 0x21  # the click letter drawn as an exclamation mark
        expansion: dict[int, tuple[int, ...]] = {}
        self.ccc = np.zeros(TOP, np.uint8)
        self.alnum = np.zeros(TOP, bool)
        self.letter = np.zeros(TOP, bool)
        #: Lower case of the compatibility form, where it is one character: for comparisons of words only.
        self.lower = np.arange(TOP, dtype=np.uint32)
        self.script = np.zeros(TOP, np.uint8)
        pairs: dict[int, int] = {}
        known = [*range(0x3400), *range(0xA000, 0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)]
        for lo, hi in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2F800), (0x30000, 0x323B0)):  # ideographs and syllables stay
            self.alnum[lo:hi] = self.letter[lo:hi] = True

        def expand(cp: int) -> tuple[int, ...]:
            if cp in expansion:
                return expansion[cp]
            ch, out = chr(cp), (cp,)
            kind = unicodedata.category(ch)
            if kind == "Cf" or ch in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
                out = ()
            elif kind == "Zs":
                out = (32,)
            elif ch in HYPHENS:
                out = (45,)
            elif cp in alike:
                out = (alike[cp],)
            elif parts := unicodedata.decomposition(ch).split():
                tag = parts.pop(0) if parts[0][0] == "<" else ""
                if tag in ("", "<wide>", "<narrow>", "<noBreak>") or (tag == "<compat>" and kind[0] in "LN" and kind != "No" and ch != LONG_S):
                    out = tuple(x for p in parts for x in expand(int(p, 16)))
            expansion[cp] = out
            return out

        for cp in known:
            ch = chr(cp)
            kind = unicodedata.category(ch)
            if kind in ("Cn", "Co", "Cs"):
                continue
            self.ccc[cp] = unicodedata.combining(ch)
            self.alnum[cp] = kind[0] in "LNM"
            self.letter[cp] = kind[0] in "LM"
            small = unicodedata.normalize("NFKC", ch).lower()
            if len(small) == 1:
                self.lower[cp] = ord(small)
            if cp not in alike and kind[0] == "L":
                for k, (letters, _) in enumerate(ALIKE, 1):
                    if cp in letters or (k == 2 and 0x1F00 <= cp < 0x2000):
                        self.script[cp] = k
            expand(cp)
            own = unicodedata.decomposition(ch)
            if own and own[0] != "<" and len(own.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in own.split())
                pairs[a << 21 | b] = cp
        changed = {cp: e for cp, e in expansion.items() if e != (cp,)}
        self.where = np.full(TOP, -1, np.int32)
        for i, cp in enumerate(changed):
            self.where[cp] = i
        self.size = np.array([len(e) for e in changed.values()] + [1], np.int32)
        self.begin = np.concatenate([[0], np.cumsum(self.size[:-1])])
        self.flat = np.array([x for e in changed.values() for x in e], np.uint32)
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_to = np.array([pairs[k] for k in sorted(pairs)], np.uint32)
        # A row is worked on if it holds a mark, a jamo, a carriage return, a letter of a script with look-alikes, or a
        # character that does not come back as itself.
        self.concern = self.ccc > 0
        self.concern[[13, *range(0x1100, 0x1200)]] = True
        self.concern |= self.script > 0  # words of other scripts may hold Latin letters
        for cp, e in changed.items():
            if unicodedata.normalize("NFC", "".join(map(chr, e))) != chr(cp):
                self.concern[cp] = True
        seconds = np.unique(self.pair_keys & 0x1FFFFF)
        self.concern[seconds] = True
        self.second = np.zeros(TOP, bool)
        self.second[seconds] = True
        self.back = {}
        for s, (_, table) in enumerate(ALIKE, 1):
            back = {ord(b): ord(a) for a, b in reversed(table.items())}  # of two letters for one, the first
            for cp, to in list(back.items()):  # accented letters too
                for mark in (0x300, 0x301, 0x306, 0x308):
                    key, made = cp << 21 | mark, to << 21 | mark
                    if key in pairs and made in pairs:
                        back[pairs[key]] = pairs[made]
            self.back[s] = (np.array(sorted(back), np.uint32), np.array([back[k] for k in sorted(back)], np.uint32))


@cache
def tables() -> Tables:
    return Tables()


def code_points(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, with n+1 offsets."""
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cps) == len(raw):
        return cps, off
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    return cps, heads[off]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def _compose(cps: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = tables()
    ccc = t.ccc[cps]
    mark = ccc > 0
    if mark.any():
        at = np.flatnonzero(mark)
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
        run = np.cumsum(first) - 1
        head = np.flatnonzero(first)
        if len(head) < len(at):  # canonical order within each run of marks
            order = np.lexsort((ccc[at], run))
            cps[at] = cps[at][order]
            ccc[at] = ccc[at][order]
        place = np.arange(len(at)) - head[run]
        base = at[head][run] - 1
        fits = (base >= 0) & (row[np.maximum(base, 0)] == row[at])
        last = np.zeros(len(cps), np.uint8)
        gone = np.zeros(len(cps), bool)
        by_place = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[by_place], np.arange(place.max() + 2))
        for k in range(place.max() + 1):
            which = by_place[bounds[k] : bounds[k + 1]]
            which = which[fits[which]]
            m, b = at[which], base[which]
            made, to = _find(t.pair_keys, t.pair_to, cps[b].astype(np.int64) << 21 | cps[m])
            made &= last[b] < ccc[m]
            cps[b[made]] = to[made]
            gone[m[made]] = True
            last[b[~made]] = ccc[m[~made]]
        cps, row = cps[~gone], row[~gone]
    for _ in range(2):  # pairs of starters: Hangul and some Indic vowels
        if len(cps) < 2:
            break
        a, b, same = cps[:-1].astype(np.int64), cps[1:].astype(np.int64), row[1:] == row[:-1]
        lv = same & (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        lvt = same & (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        cand = np.flatnonzero(same & t.second[cps[1:]] & (t.ccc[cps[1:]] == 0))
        made, to = _find(t.pair_keys, t.pair_to, a[cand] << 21 | b[cand])
        hit = np.zeros(len(a), bool)
        new = cps.copy()
        new[:-1][lv] = (0xAC00 + ((a - 0x1100) * 21 + (b - 0x1161)) * 28)[lv]
        new[:-1][lvt] = (a + b - 0x11A7)[lvt]
        new[cand[made]] = to[made]
        hit[lv | lvt] = True
        hit[cand[made]] = True
        if not hit.any():
            break
        keep = np.ones(len(cps), bool)
        keep[1:] = ~hit
        cps, row = new[keep], row[keep]
    return cps, row


def _scripts(cps: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Gives words with a letter found only in one of the scripts of ALIKE the letters of that script."""
    t = tables()
    script = t.script[cps]
    if not script.any():
        return cps
    letter = t.letter[cps]
    start = letter.copy()
    start[1:] &= ~letter[:-1] | (row[1:] != row[:-1])
    word = np.cumsum(start)
    done = np.zeros(word[-1] + 1, bool)
    for s in t.back:
        mine = np.zeros(word[-1] + 1, bool)
        mine[word[script == s]] = True
        mine &= ~done
        done |= mine
        at = np.flatnonzero(letter & mine[word])
        made, to = _find(*t.back[s], cps[at])
        cps[at[made]] = to[made]
    return cps


def fold(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of concern in their consistent form: their numbers, code points and offsets."""
    t = tables()
    high = np.flatnonzero((cps > 126) | (cps == 13))
    touched = np.zeros(len(off) - 1, bool)
    at = high[t.concern[cps[high]]]
    touched[np.searchsorted(off, at, "right") - 1] = True
    rows = np.flatnonzero(touched)
    if not len(rows):
        return rows, np.zeros(0, np.uint32), np.zeros(1, np.int64)
    size = off[rows + 1] - off[rows]
    x = cps[W.positions_in_runs(off[rows], off[rows + 1])]
    row = np.repeat(np.arange(len(rows)), size)
    cr = np.flatnonzero(x == 13)
    if len(cr):  # line ends
        x = x.copy()
        follows = (cr + 1 < len(x)) & (x[np.minimum(cr + 1, len(x) - 1)] == 10) & (row[np.minimum(cr + 1, len(x) - 1)] == row[cr])
        x[cr] = 10
        keep = np.ones(len(x), bool)
        keep[cr[follows]] = False
        x, row = x[keep], row[keep]
    where = t.where[x]
    own = np.flatnonzero(where >= 0)
    sizes = np.ones(len(x), np.int64)
    sizes[own] = t.size[where[own]]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(begin[-1], np.uint32)
    plain = np.flatnonzero(where < 0)
    out[begin[plain]] = x[plain]
    out[W.positions_in_runs(begin[own], begin[own] + sizes[own])] = t.flat[W.positions_in_runs(t.begin[where[own]], t.begin[where[own]] + sizes[own])]
    out, row = _compose(out, np.repeat(row, sizes))
    out = _scripts(out, row)
    return rows, out, np.searchsorted(row, np.arange(len(rows) + 1))


def pieces(texts: pa.Array):
    """Slices of an array of texts of about PIECE_BYTES each, with their bytes and offsets."""
    raw, off = W.utf8(texts)
    begin = 0
    while begin < len(texts):
        end = max(int(np.searchsorted(off, off[begin] + PIECE_BYTES, "right")) - 1, begin + 1)
        yield begin, end, raw[off[begin] : off[end]], off[begin : end + 1] - off[begin]
        begin = end


def fold_all(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in their consistent form, with n+1 offsets."""
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
    cps, coff = code_points(raw, off)
    rows, out, ooff = fold(cps, coff)
    if not len(rows):
        return cps, coff
    size = np.diff(coff)
    stay = np.ones(len(size), bool)
    stay[rows] = False
    kept = np.repeat(stay, size)
    size[rows] = np.diff(ooff)
    new = np.empty(int(size.sum()), np.uint32)
    place = np.repeat(stay, size)
    new[place] = cps[kept]
    new[~place] = out
    return new, np.concatenate([[0], np.cumsum(size)])


def consistent_forms(texts: pa.Array) -> pa.Array:
    """The consistent form of each text that differs from it; null for the others and for nulls."""
    whole = texts.is_valid().to_numpy(zero_copy_only=False)
    number = np.flatnonzero(whole)
    arrays, place = [], []
    for begin, end, raw, off in pieces(texts.drop_null()):
        if not len(raw):
            continue
        cps, coff = code_points(raw, off)
        rows, out, ooff = fold(cps, coff)
        if not len(rows):
            continue
        differs = np.diff(ooff) != (coff[rows + 1] - coff[rows])
        same = np.flatnonzero(~differs)  # rows of concern of which many stay as they are, most of them in another script
        new, old = out[W.positions_in_runs(ooff[same], ooff[same + 1])], cps[W.positions_in_runs(coff[rows[same]], coff[rows[same] + 1])]
        differs[np.repeat(same, np.diff(ooff)[same])[new != old]] = True
        width = 1 + (out > 0x7F).astype(np.int64) + (out > 0x7FF) + (out > 0xFFFF)
        bytes_at = np.concatenate([[0], np.cumsum(width)])[ooff]
        data = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
        made = pa.StringArray.from_buffers(len(rows), pa.py_buffer(bytes_at.astype(np.int32).tobytes()), pa.py_buffer(data))
        arrays.append(made.filter(pa.array(differs)))
        place.append(number[begin + rows[differs]])
    at = np.full(len(texts), -1, np.int64)
    if arrays:
        place = np.concatenate(place)
        at[place] = np.arange(len(place))
        return pa.concat_arrays(arrays).take(pa.array(at, mask=at < 0))
    return pa.nulls(len(texts), pa.string())


@F.arrow_udf(StringType())
def _forms(texts: pa.Array) -> pa.Array:
    return consistent_forms(texts)


def consistent_form(text: Column) -> Column:
    """The consistent form of a text; null for null, empty for empty. Only texts that change come back from Python."""
    return F.coalesce(_forms(text), text)


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form, own): digests of the consistent form and of the text itself, written once. Null ids and null texts take no part."""
    return written(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
        .where(F.col("id").isNotNull() & F.col("t").isNotNull())
        .withColumn("f", consistent_form(F.col("t")))
        .select("id", F.unhex(F.md5("f")).alias("form"), F.unhex(F.md5("t")).alias("own"))
    )


def look_alike_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, variants, class_size) of every row with a text: the least id of its consistent form, the different strings and the rows of the form."""
    rows = _digests(df, id_col, text_col)
    kinds = rows.groupBy("form", "own").agg(F.min("id").alias("least"), F.count("*").alias("n"))  # copies of a string are one row before forms meet
    classes = kinds.groupBy("form").agg(F.min("least").alias("class_id"), F.count("*").alias("variants"), F.sum("n").alias("class_size"))
    return rows.select("id", "form").join(classes, "form").select("id", "class_id", "variants", "class_size")


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose texts are different strings of one consistent form.

    Only digests are shuffled. Equal strings are one variant, and forms with a single variant are left out before any
    join, so a group of copies of any size costs one row a partition. Null ids and null texts take no part.
    """
    rows = _digests(df, id_col, text_col)
    several = rows.groupBy("form").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").select("form")
    varied = rows.join(several, "form")
    # variants are paired before their rows, so the copies of one string never meet each other
    kinds = varied.select("form", "own").distinct()
    pairs = kinds.withColumnRenamed("own", "own_a").join(kinds.withColumnRenamed("own", "own_b"), "form").where("own_a <> own_b")
    left = varied.select("form", F.col("id").alias("id_a"), F.col("own").alias("own_a"))
    right = varied.select("form", F.col("id").alias("id_b"), F.col("own").alias("own_b"))
    return pairs.join(left, ["form", "own_a"]).join(right, ["form", "own_b"]).where("id_a < id_b").select("id_a", "id_b")
