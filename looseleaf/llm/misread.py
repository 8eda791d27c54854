"""Misread characters of scanned text: candidates from character q-gram indexes, chosen by a boosted ranker.

A place that may be misread holds a character that can't stand there (a digit or sign within a word, a Latin letter among
Thai ones, a doubled mark, a lost character) or a confusable pair (rn, vv, cl, li). Its candidates come from four inverted
indexes of what stands in the corpus between the same neighbours: three letters on both sides, two on both sides, three on
the left and three on the right. Sides that hold another such place are not asked, so of several errors in one word each
is corrected from its sound side. The reading as it stands is a candidate like the others; a gradient-boosted ranker
fitted on corrupted copies of sound text chooses among them by shares, which don't depend on the size of the corpus.

Scale: only the contexts asked for are counted. They pass through a Bloom filter of fixed size (2**BLOOM_BITS bits), the one
thing that is broadcast; the texts are read once against it, counted within Arrow batches, and what passes by chance is
dropped by the join. Equal places are asked once. Models are fitted on SAMPLE rows of each kind at most.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from looseleaf.session import checkpointed

#: Rows of each kind that a classifier is fitted on at most.
SAMPLE = 4000
#: Trees and depth of the boosted models.
TREES, DEPTH = 10, 4
#: A confusable pair isn't taken for rightly read, where models are fitted, if its correction occurs more than so many times as often.
OUTNUMBERED = 20
#: Size of the filter of contexts asked for, as a power of two; independent of the data.
BLOOM_BITS = 26
#: Least probability of a correction where the reading as it stands is possible, and where it is not.
SOFT_LEAST, HARD_LEAST = 0.5, 0.02
#: Letters that scanning confuses, as read and as printed.
CONFUSED_LATIN = [("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("0", "o"), ("1", "l"), ("5", "s"), ("|", "l"), ("!", "i"), ("9", "g"), ("�", "e"), ("6", "b"), ("8", "b")]
CONFUSED_THAI = [("1", "า"), ("0", "อ"), ("n", "ก"), ("u", "ม"), ("l", "เ"), ("J", "ง"), ("s", "ร"), ("\uf70b", "้"), ("\uf70a", "่"), ("\uf701", "ิ"), ("\uf702", "ี")]
SOFT = [y for y, _ in CONFUSED_LATIN if y.isalpha() and y.isascii()]
#: Thai marks that stand above or below a letter, and Thai letters.
MARKS = "ัิ-ฺ็-๎"
THAI = "ก-ฺเ-๎"
_UNITS = "st|nd|rd|th|ml|mg|kg|cm|mm|km|am|pm"
#: Places of characters that can't stand where they are.
_ALIKE = ["[\ue000-\uf8ff�]", "(?<=[A-Za-z])[0-9|!](?=[A-Za-z])", "(?<=[A-Za-z]{2})[0-9|](?![0-9A-Za-z|])", f"(?<![0-9A-Za-z.,/|])[0-9|](?!(?:{_UNITS})(?![a-z]))(?=[a-z]{{2,}})"]
_THAI_ONLY = [
    f"([{MARKS}])\\1+�*|[่-๋]{{2,}}�*",
    f"(?<=[{THAI}])[A-Za-z|!](?=[{THAI}\\s]|$)|(?<![A-Za-z])[A-Za-z|](?=[{THAI}])",
    f"(?<=[{THAI}])[0-9](?![0-9.,/])(?=[{THAI}\\s])|(?<![0-9.,/])[0-9](?=[{THAI}])",
]
#: What such a place begins with, in texts with and without Thai letters; a look at it first saves most of the work.
HARD = f"(?=[0-9A-Za-z|!�\ue000-\uf8ff{MARKS}])(?:{'|'.join([_THAI_ONLY[0], *_ALIKE[:1], *_THAI_ONLY[1:], *_ALIKE[1:]])})"
HARD_LATIN = f"(?=[0-9|!�\ue000-\uf8ff])(?:{'|'.join(_ALIKE)})"
_HARD, _HARD_LATIN, _ANY_THAI, _SOFT = re.compile(HARD), re.compile(HARD_LATIN), re.compile(f"[{THAI}]"), re.compile(f"(?=({'|'.join(SOFT)}))")
_LATIN_WORD = re.compile("[A-Za-z0-9|!�À-ɏ’'-]+")
_BOUNDARY = 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Indexes: three or two letters on both sides, three on the left or right, the rest of the word with the next or previous word.
KINDS = ("a", "b", "l", "r", "n", "p")
KEYS = [f"k{k}" for k in KINDS]
#: Characters that are handled at once in numpy.
PIECE = 500_000
_BASE, _BACK = np.uint64(0x100000001B3), np.uint64(pow(0x100000001B3, -1, 1 << 64))


@lru_cache(1)
def _folded() -> np.ndarray:
    """Code point to the letter that contexts are made of: lower case, anything that is no part of a word as _BOUNDARY."""
    to = np.full(0x10000, _BOUNDARY, np.uint32)
    for cp in range(0x10000):
        kind = unicodedata.category(ch := chr(cp))[0]
        if kind in "LMN" or ch in "|!�" or 0xE000 <= cp <= 0xF8FF:
            low = ch.lower()
            to[cp] = ord(low) if len(low) == 1 else cp
    return to


def _hash(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _contexts(text: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(code points, hashes of the two and three letters before and from each place on); beyond a word's end nothing is seen."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    c = np.full(n + 6, _BOUNDARY, np.uint64)
    c[3 : n + 3] = np.where(codes < 0x10000, _folded()[np.minimum(codes, 0xFFFF)], codes)
    wall = np.uint64(_BOUNDARY)
    l1 = c[2 : n + 3]
    l2 = np.where(l1 == wall, wall, c[1 : n + 2])
    l3 = np.where(l2 == wall, wall, c[0 : n + 1])
    r1 = c[3 : n + 4]
    r2 = np.where(r1 == wall, wall, c[4 : n + 5])
    r3 = np.where(r2 == wall, wall, c[5 : n + 6])
    s, t = np.uint64(21), np.uint64(42)
    # hashes of the rest of the word before and from each place on, and of the words around it
    inner = c[3 : n + 4].copy()
    solid = inner != wall
    at = np.arange(n + 1)
    ends = np.minimum.accumulate(np.where(solid, n, at)[::-1])[::-1]  # the next place that is no part of a word
    starts = np.append(0, np.maximum.accumulate(np.where(solid, -1, at))[:-1] + 1)
    power, back = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE))), np.cumprod(np.append(np.uint64(1), np.full(n, _BACK)))
    sums = np.append(np.uint64(0), np.cumsum(_hash(inner[:n]) * power[:n]))
    piece = lambda a, b: (sums[b] - sums[a]) * back[a]
    onward = np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1]  # the next place that is part of a word
    last = np.maximum.accumulate(np.where(solid, at + 1, 0))
    follow = onward[ends]
    lead = np.where(starts > 0, last[np.maximum(starts - 1, 0)], 0)
    lead_start = np.where(lead > 0, starts[np.maximum(lead - 1, 0)], 0)
    words = {"before": piece(starts, at), "after": piece(at, ends), "next": piece(follow, ends[follow]), "prev": piece(lead_start, lead)}
    return codes, words | {"l2": _hash(l1 + (l2 << s)), "l3": _hash(l1 + (l2 << s) + (l3 << t)), "r2": _hash(r1 + (r2 << s) + np.uint64(7)), "r3": _hash(r1 + (r2 << s) + (r3 << t) + np.uint64(7))}


def _key(h: dict[str, np.ndarray], kind: str, at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Key of the context of characters at..until-1 in an index of a kind."""
    if kind in "np":
        word = _hash(h["before"][at] * np.uint64(3) + h["after"][until] * np.uint64(7) + np.uint64(17))
        return _hash(word + (h["next"][until] if kind == "n" else h["prev"][at] * np.uint64(5)) + np.uint64(ord(kind))).astype(np.int64)
    left, right = h["l2" if kind == "b" else "l3"][at], h["r2" if kind == "b" else "r3"][until]
    parts = {"a": left + np.uint64(3) * right, "b": left + np.uint64(5) * right, "l": left + np.uint64(11), "r": right + np.uint64(13)}
    return _hash(parts[kind]).astype(np.int64)


def _dirty(text: str) -> tuple[list, np.ndarray]:
    """Places of a text, as (at, until, hard), and how many characters of hard places stand before each character."""
    found = [(m.start(), m.end(), True) for m in (_HARD if _ANY_THAI.search(text) else _HARD_LATIN).finditer(text)]
    bad = np.zeros(len(text) + 1, np.int32)
    for a, b, _ in found:
        bad[a + 1 : b + 1] = 1
    bad = np.cumsum(bad)
    return found + [(m.start(), m.start() + 2, False) for m in _SOFT.finditer(text) if bad[m.start() + 2] == bad[m.start()]], bad


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as columns; keys, of which some are None, keep all their bits."""
    columns = list(zip(*rows)) or [()] * len(names)
    return pd.DataFrame({c: pd.array(v, dtype="Int64") if c in KEYS else pd.Series(v, dtype=None if v else object) for c, v in zip(names, columns)})


_PLACES = "src string, row_id bigint, at int, size int, y string, hard boolean, word string, begin int, " + ", ".join(f"{k} bigint" for k in KEYS)


def _words(text: str):
    """The word of two Latin letters or more at a place of a text, as a function; None if there is none."""
    every = list(_LATIN_WORD.finditer(text))
    starts = [m.start() for m in every]

    def at(a: int):
        k = bisect_right(starts, a) - 1
        return every[k] if k >= 0 and a < every[k].end() and len(re.findall("[A-Za-z]", every[k].group())) > 1 else None

    return at


def _places_of(text: str) -> list[tuple]:
    """(at, size, y, hard, word, begin of the word, keys) of the places of a text; keys of sides that hold another hard place are None."""
    found, bad = _dirty(text)
    if not found:
        return []
    _, h = _contexts(text)
    at, until = np.array([a for a, _, _ in found]), np.array([b for _, b, _ in found])
    keys = {k: _key(h, k, at, until) for k in KINDS}
    word_at = _words(text)
    n = len(text)
    out = []
    for j, (a, b, hard) in enumerate(found):
        clean = lambda lo, hi: bad[min(n, hi)] == bad[max(0, lo)]
        left3, right3, left2, right2 = clean(a - 3, a), clean(b, b + 3), clean(a - 2, a), clean(b, b + 2)
        ask = {"a": left3 and right3, "b": left2 and right2, "l": left3, "r": right3, "n": not hard, "p": not hard}
        m = word_at(a)
        if not hard and m is None:
            continue
        word, begin = (m.group(), m.start()) if m and b <= m.end() else (None, a)
        out.append((a, b - a, text[a:b], hard, word, begin, *(int(keys[k][j]) if ask[k] else None for k in KINDS)))
    return out


def places(texts: DataFrame) -> DataFrame:
    """Places of texts (src, row_id, text) that may be misread, with the keys of their contexts."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PLACES.split(", ")]
        for batch in batches:
            rows = [(s, r, *p) for s, r, t in zip(batch["src"], batch["row_id"], batch["text"]) if t for p in _places_of(t)]
            yield _frame(rows, names)

    return texts.select("src", "row_id", "text").mapInPandas(of, _PLACES)


_FAKES = "y string, hard boolean, word string, begin int, right_x string, right_word string, part double, " + ", ".join(f"{k} bigint" for k in KEYS)


def _fakes(texts: DataFrame, each: int) -> DataFrame:
    """Confusions put into sound texts, about one of each kind in `each` places of a letter, and places that are as they should be.

    part: how often the copy occurs for each time that the right word does, from an OUTNUMBERED-th to about a thousandth.
    """
    confusions = [(y, x, False) for y, x in CONFUSED_LATIN] + [(y, x, True) for y, x in CONFUSED_THAI] + [(m, m, True) for m in "ั้่ิีุ"]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _FAKES.split(", ")]
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found, bad = _dirty(text)
                _, h = _contexts(text)
                word_at = _words(text)
                for k, (y, x, thai) in enumerate(confusions):
                    at = np.array([m.start() for m in re.finditer(re.escape(x), text)], np.int64)
                    at = at[_hash(at.astype(np.uint64) * np.uint64(31) + np.uint64(k + 1009 * len(text))) % np.uint64(each) == 0]
                    at = at[bad[np.minimum(len(text), at + len(x) + 3)] == bad[np.maximum(0, at - 3)]]
                    keys = [_key(h, kind, at, at + len(x)).tolist() for kind in KINDS]
                    for a, *own in zip(at.tolist(), *keys):
                        b, m, d = a + len(x), word_at(a), own[0] >> 3
                        if (m is None) != thai or thai and not "ก" <= text[a] <= "๎" or m and (b > m.end() or len(m.group()) < 4):
                            continue
                        read = y if y != x else x + x + ("�" if d % 3 == 0 else "")  # a doubled mark
                        wrong = None if m is None else text[m.start() : a] + read + text[b : m.end()]
                        if hard := thai or re.search("^[a-z]+$", read) is None:
                            # of one in two as if another error stood on one side
                            own = [None, None, own[2] if d % 4 == 1 else None, own[3] if d % 4 == 2 else None, None, None] if d % 4 in (1, 2) else [*own[:4], None, None]
                        rows.append((read, hard, wrong, a - m.start() if m else 0, x, m and m.group(), 10.0 ** -((d >> 20) % 1000 / 400) / OUTNUMBERED, *own))
                at = np.array([a for a, _, hard in found if not hard and word_at(a)], np.int64)
                at = at[_hash((at + 7 * len(text)).astype(np.uint64)) % np.uint64(2) == 0]
                for a, *own in zip(at.tolist(), *(_key(h, kind, at, at + 2).tolist() for kind in KINDS)):
                    m = word_at(a)
                    rows.append((text[a : a + 2], False, m.group(), a - m.start(), text[a : a + 2], m.group(), 0.0, *own))
            yield _frame(rows, names)

    return texts.select("text").mapInPandas(of, _FAKES)


@lru_cache(1)
def _no_reading() -> np.ndarray:
    """Code points that no candidate holds: what isn't a letter or mark of a word."""
    return np.array([unicodedata.category(chr(cp))[0] not in "LM" for cp in range(0x10000)])


def _bits(key: Column) -> list[Column]:
    """The two places of a key, a hash already, in the filter."""
    return [F.shiftrightunsigned(key, 64 - BLOOM_BITS), key.bitwiseAND(F.lit((1 << BLOOM_BITS) - 1))]


def _bloom(keys: DataFrame) -> np.ndarray:
    """Filter of 2**BLOOM_BITS bits over the column `key`, folded in the tasks; what reaches the driver has that size at most."""
    bits = keys.select(F.explode(F.array(*_bits(F.col("key")))).alias("p")).select(F.shiftrightunsigned("p", 5).alias("w"), F.expr("shiftleft(1L, cast(p & 31 as int))").alias("bit"))
    rows = bits.groupBy("w").agg(F.bit_or("bit").alias("v")).toPandas()
    out = np.zeros(1 << (BLOOM_BITS - 5), np.uint32)
    out[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64).astype(np.uint32)
    return out


def _passing(bloom: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Indexes of the keys that the filter lets pass."""
    at = np.arange(len(key))
    for shift in (True, False):
        u = key[at].view(np.uint64)
        p = u >> np.uint64(64 - BLOOM_BITS) if shift else u & np.uint64((1 << BLOOM_BITS) - 1)
        at = at[(bloom[(p >> np.uint64(5)).astype(np.int64)] >> (p & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0]
    return at


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[str]:
    """The texts of batches, some at once, PIECE characters or one text at least."""
    held, size = [], 0
    for batch in batches:
        for t in batch["text"]:
            if t:
                held.append(t)
                size += len(t)
            if size >= PIECE:
                yield "\n".join(held)
                held, size = [], 0
    if held:
        yield "\n".join(held)


def q_gram_index(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, x, nx): how often x, of no, one or two characters, stands in each context of keys, over all texts."""
    sent = texts.sparkSession.sparkContext.broadcast(_bloom(keys))
    soft, printed = [ord(y[0]) + (ord(y[1]) << 21) for y in SOFT], [ord(x) for y, x in CONFUSED_LATIN if y in SOFT]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _pieces(batches):
            codes, h = _contexts(whole)
            n = len(codes)
            bad = np.where(codes < 0x10000, _no_reading()[np.minimum(codes, 0xFFFF)], False)
            one = np.flatnonzero(~bad)
            two = np.flatnonzero(~bad[:-1] & ~bad[1:])
            # readings of confusable pairs
            pair = two[np.isin(codes[two].astype(np.int64) + (codes[two + 1].astype(np.int64) << 21), soft)]
            plain = one[np.isin(codes[one], printed)]
            found = []
            asked = [("a", np.arange(n + 1), 0), ("a", one, 1), ("a", two, 2), ("b", one, 1), ("b", two, 2), ("l", one, 1), ("r", one, 1)]
            for kind, at, width in [*asked, ("l", pair, 2), ("r", pair, 2), ("n", pair, 2), ("p", pair, 2), ("n", plain, 1), ("p", plain, 1)]:
                key = _key(h, kind, at, at + width)
                hit = _passing(sent.value, key)
                key, at = key[hit], at[hit]
                x = sum((codes[at + i].astype(np.int64) << (21 * i) for i in range(width)), np.zeros(len(at), np.int64))
                found.append(pd.DataFrame({"key": key, "x": x}))
            counted = pd.concat(found).groupby(["key", "x"], sort=False).size().reset_index(name="n")
            read = {x: "".join(chr(c) for c in (x & 0x1FFFFF, x >> 21) if c) for x in counted["x"].unique().tolist()}
            yield counted.assign(x=counted["x"].map(read))

    counts = texts.select("text").mapInPandas(of, "key bigint, x string, n bigint").groupBy("key", "x").agg(F.sum("n").alias("nx"))
    return counts.join(keys, "key", "left_semi")


FEATURES = ["sa", "sb", "sl", "sr", "sn", "sp", "ta", "usual", "same", "wider", "hard", "mark", "words"]


def candidates(suspects: DataFrame, index: DataFrame, counts: DataFrame) -> DataFrame:
    """suspects (sid, y, hard, word, begin of the place in the word, n, n_word, keys) with each candidate x and FEATURES.

    Shares (s) are logarithms of the part of a context that a candidate makes up; ta tells whether the context of both
    sides is known at all. Candidates of confusable pairs are their usual correction and the reading as it stands.
    """
    usual = F.create_map(*(F.lit(v) for y, x in CONFUSED_LATIN if y in SOFT for v in (y, x)))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("key")) for k in KINDS)))
    asked = suspects.select("sid", "y", "hard", "n", kinds.alias("k")).select("sid", "y", "hard", "n", "k.kind", "k.key").where("key is not null")
    met = asked.join(index, "key").where(F.col("hard") | (F.col("x") == F.col("y")) | (F.col("x") == usual[F.col("y")]))
    totals = {k: F.sum(F.when(F.col("kind") == k, F.col("nx"))) for k in KINDS}
    each = met.groupBy("sid", "x").agg(*(F.coalesce(totals[k], F.lit(0)).alias(f"n{k}") for k in KINDS))
    # the reading as it stands is a candidate, whether it occurs elsewhere or not; a copy made up counts for itself
    own = suspects.where("not hard").select("sid", F.col("y").alias("x"), *((F.col("made") if k not in "np" else F.least("made", F.lit(1))).alias(f"n{k}") for k in KINDS))
    each = each.unionByName(own).groupBy("sid", "x").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in KINDS))
    whole = Window.partitionBy("sid")
    c = each.select("sid", "x", *(F.col(f"n{k}") for k in KINDS), *(F.sum(f"n{k}").over(whole).alias(f"all_{k}") for k in KINDS))
    c = c.select("sid", "x", (F.col("all_a") > 0).cast("int").alias("ta"), *(F.log((F.col(f"n{k}") + 0.1) / (F.col(f"all_{k}") + 1)).alias(f"s{k}") for k in KINDS))
    c = c.join(suspects.drop(*KEYS), "sid")
    to = F.when(F.col("word").isNotNull(), F.concat(F.expr("substring(word, 1, begin)"), F.col("x"), F.expr("substring(word, begin + 1 + length(y))")))
    c = c.withColumn("to", F.lower(to))
    c = c.join(counts.select(F.col("word").alias("to"), F.col("n").alias("n_to")), "to", "left")
    pairs = F.array(*(F.lit(f"{y}>{x}") for y, x in [*CONFUSED_LATIN, *CONFUSED_THAI]))
    c = c.withColumn("usual", F.array_contains(pairs, F.concat("y", F.lit(">"), "x")).cast("int")).withColumn("same", (F.col("x") == F.col("y")).cast("int"))
    c = c.withColumn("wider", F.length("x") - F.length("y")).withColumn("mark", F.col("x").rlike(f"^[{MARKS}]$").cast("int") + F.expr("cast(substring(y, 1, 1) = x as int)"))
    words = F.when(F.col("word").isNull(), 0.0).otherwise(F.log((F.coalesce("n_to", F.lit(0)) + 0.1) / (F.coalesce("n_word", F.lit(0)) + 1)))
    return c.withColumn("words", F.when(F.col("same") == 1, 0.0).otherwise(words))


def fitted(rows: DataFrame, features: list[str], label: str = "label"):
    """A boosted classifier over the features of a bounded sample, or None if the rows show one class only."""
    data = VectorAssembler(inputCols=features, outputCol="_f").transform(rows.select(*(F.col(c).cast("double").alias(c) for c in [*features, label]))).select("_f", F.col(label).alias("label"))
    data = checkpointed(data.coalesce(2))  # a few thousand rows
    if data.agg(F.countDistinct("label")).first()[0] < 2:
        return None
    return GBTClassifier(featuresCol="_f", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32).fit(data)


def probability(model, rows: DataFrame, features: list[str], to: str) -> DataFrame:
    if model is None:
        return rows.withColumn(to, F.lit(0.0))
    cast = rows.select(*rows.columns, *(F.col(c).cast("double").alias(f"_{c}") for c in features))
    scored = model.transform(VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_f").transform(cast))
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias(to))


def _same_place(df: DataFrame) -> DataFrame:
    """df with sid, one for all places that are alike: characters, word and contexts."""
    return df.withColumn("sid", F.xxhash64("y", F.coalesce("word", F.lit("")), "begin", *(F.coalesce(f"k{k}", F.lit(0)) for k in KINDS)))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of the words in Latin letters of texts, in lower case."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9|!�À-ɏ’'-]+"), F.lit(0)))
    return texts.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def corrections(texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(src, row_id, at, size, x): misread places of texts (src, row_id, text) and what was printed there.

    at counts characters from 0. A place for which no other reading is likely stays as it is. Null texts have no places.
    """
    found = checkpointed(_same_place(places(texts).withColumn("begin", F.col("at") - F.col("begin"))))
    counts = checkpointed(word_counts(texts))
    known = counts.select(F.col("word").alias("_w"), F.col("n").alias("n_word"))
    real = found.groupBy("sid", "y", "hard", "word", "begin", *KEYS).agg(F.count(F.lit(1)).alias("n"))
    real = real.join(known, F.lower("word") == F.col("_w"), "left").drop("_w").withColumn("made", F.lit(0).cast("bigint")).withColumn("right_x", F.lit(None).cast("string"))
    some = texts.where("text is not null").orderBy(F.xxhash64("src", "row_id")).limit(sample // 4).repartition(8)
    fakes = _fakes(some, 6)
    order = F.row_number().over(Window.partitionBy("y", "right_x").orderBy(F.xxhash64("word", "ka", "kl", "kr")))
    fakes = fakes.withColumn("_k", order).where(F.col("_k") <= F.when(F.col("part") > 0, sample // 16).otherwise(sample // 4)).drop("_k")
    right = counts.select(F.col("word").alias("_r"), F.col("n").alias("n_right"))
    fakes = fakes.join(right, F.lower("right_word") == F.col("_r"), "left").drop("_r")
    times = F.greatest(F.lit(1), F.round(F.coalesce("n_right", F.lit(1)) * F.col("part"))).cast("bigint")
    made = F.when(F.col("part") > 0, times).otherwise(0).cast("bigint")
    fakes = fakes.withColumn("made", made).withColumn("n", F.greatest(F.lit(1), F.col("made"))).withColumn("n_word", F.when(F.col("part") > 0, F.col("made")).otherwise(F.col("n_right")))
    fakes = _same_place(fakes).withColumn("sid", F.xxhash64("sid", "right_x", "made", F.lit("made"))).dropDuplicates(["sid"])
    columns = ["sid", "y", "hard", "word", "begin", "n", "n_word", "made", "right_x", *KEYS]
    suspects = checkpointed(real.select(*columns).unionByName(fakes.select(*columns)))
    keys = checkpointed(suspects.select(F.explode(F.array(*KEYS)).alias("key")).where("key is not null").distinct())
    c = checkpointed(candidates(suspects, q_gram_index(texts, keys), counts))
    training = c.where("right_x is not null").withColumn("label", (F.col("x") == F.col("right_x")).cast("int"))
    # a usual correction that occurs far more often: the place may be misread indeed
    training = training.where(~((F.col("made") == 0) & (F.col("same") == 0) & (F.col("words") > F.log(F.lit(float(OUTNUMBERED))))))
    order = F.xxhash64("sid", "x")
    wrong = training.where("hard and label = 0").orderBy(order).limit(sample)
    model = fitted(training.where("not hard or label = 1").orderBy(order).limit(2 * sample).unionByName(wrong), FEATURES)
    scored = probability(model, c.where("right_x is null"), FEATURES, "p")
    best = scored.groupBy("sid").agg(F.max(F.struct("p", "sa", "sb", "x", "same", "hard")).alias("b")).select("sid", "b.*")
    chosen = best.where((F.col("same") == 0) & (F.col("p") >= F.when(F.col("hard"), HARD_LEAST).otherwise(SOFT_LEAST))).select("sid", "x")
    return found.join(chosen, "sid").select("src", "row_id", "at", "size", "x")
