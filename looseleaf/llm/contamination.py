"""Evaluation texts leaking into training text: an FM-index for each training shard.

Texts are reduced to letters, and the letters cut into short phrases where their content says so (a hash of three letters),
so that case, punctuation, spacing and markup make no difference and a changed letter changes one or two phrases only. A
shard is a run of documents of one partition; its phrases are indexed by a suffix array from which the index keeps the
Burrows-Wheeler transform as a wavelet matrix and every eighth suffix position. The phrases of the test items are searched
backwards, all at once, in runs of LEAST; every place of every run is located, once for equal runs, through the sampled
positions, and the places are merged, by document and item, into stretches, whose cover of the item is measured letter by letter.

Scale: the documents are read once and never shuffled; a shard holds SHARD_LETTERS letters (one document at least), so the
memory of a task is bounded. Test items are broadcast in blocks of BLOCK_LETTERS characters,
whatever their number; where there are several blocks, the indexes of the shards are built once and kept as a table.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from looseleaf.session import checkpointed

SHARD_LETTERS = 4_000_000
BLOCK_LETTERS = 8_000_000
#: One phrase boundary in so many places, on average.
PHRASE = 4
#: Bits of a phrase's symbol, and levels of the wavelet matrix; places kept of the suffix array.
BITS, SAMPLE = 16, 8
#: Phrases that are searched at once.
LEAST = 5
#: Places of item phrases that are merged at once, or those of one document.
AT_ONCE = 4_000_000
#: Part of an item that runs of its phrases must cover for the pair to be measured; part that makes a leak.
HINT, LEAK = 0.15, 0.33
#: Letters compared at once when a pair is measured; in a stretch, letters without a match and letters shifted between two
#: matches at most, letters in all and part of them matched at least. Set phrases of one kind of text stay under these.
WINDOW = 16
GAP, SHIFT, SPAN, DENSE = 40, 12, 40, 0.75
#: Letters under which every item with a common run of phrases is measured.
SHORT = 120
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to folded letter, 0 for what isn't a letter or mark; beyond the basic plane letters stay as they are."""
    to = np.zeros(0x10000, np.uint32)
    for cp in range(0x10000):
        if unicodedata.category(ch := chr(cp))[0] in "LM":
            to[cp] = ord(f) if len(f := ch.lower()) == 1 else cp
    return to


def letters_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The letters of a text and their places in it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = np.where(codes < 0x10000, _letters()[np.minimum(codes, 0xFFFF)], codes)
    at = np.flatnonzero(folded)
    return folded[at], at


def _hash(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def phrases(letters: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, starts) of content-defined phrases; bounds are places where a document begins."""
    n = len(letters)
    if not n:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    x = letters.astype(np.uint64)
    tri = x.copy()
    tri[:-1] += x[1:] << np.uint64(17)
    tri[:-2] += x[2:] << np.uint64(34)
    cut = (_hash(tri) >> np.uint64(40)) % np.uint64(PHRASE) == 0
    cut[bounds[bounds < n]] = True
    cut[0] = True
    starts = np.flatnonzero(cut)
    lengths = np.diff(np.append(starts, n))
    place = np.arange(n, dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    sums = np.add.reduceat(_hash(x + (place << np.uint64(32))), starts)
    return (_hash(sums) >> np.uint64(64 - BITS)).astype(np.uint16), starts


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order, by doubling; after the first sort only suffixes that still tie are sorted."""
    n = len(s)
    pad = np.zeros(n + 4, np.int64)
    pad[:n] = s.astype(np.int64) + 1
    key = ((pad[:n] * 65537 + pad[1 : n + 1]) * 65537 + pad[2 : n + 2]) % (1 << 62)
    sa = np.argsort(key, kind="stable")
    depth = 3
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    while True:
        single = np.append(new[1:], True) & new
        tied = np.flatnonzero(~single)
        if not len(tied):
            return sa
        pos = sa[tied]
        after = np.where(pos + depth < n, rank[np.minimum(pos + depth, n - 1)] + 1, 0)
        order = np.lexsort((after, first[tied]))
        pos, after, group = pos[order], after[order], first[tied]
        sa[tied] = pos
        differs = np.ones(len(tied), bool)
        differs[1:] = (after[1:] != after[:-1]) | (group[1:] != group[:-1])
        new[tied] = differs
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[sa[tied]] = first[tied]
        depth *= 2


class FMIndex:
    """Burrows-Wheeler transform as a wavelet matrix, with sampled suffix positions."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        sa = suffix_array(symbols)
        self.n = n
        # row 0 is the empty suffix; the row of the whole text is preceded by no symbol and kept apart
        self.bwt_gap = int(np.flatnonzero(sa == 0)[0]) + 1
        rest = np.append(symbols[n - 1 :], symbols[sa[sa > 0] - 1])  # row 0, then the others without the gap
        counts = np.bincount(symbols, minlength=1 << BITS)
        self.before = np.append(0, np.cumsum(counts))[: 1 << BITS] + 1
        self.levels, cur = [], rest
        for b in range(BITS - 1, -1, -1):
            bit = (cur >> np.uint16(b)) & np.uint16(1)
            ones = np.append(0, np.cumsum(bit, dtype=np.int32)).astype(np.int32)
            self.levels.append((ones, int(n - ones[-1])))
            cur = np.concatenate([cur[bit == 0], cur[bit == 1]])
        rows = np.append(n, sa)
        self.kept = rows % SAMPLE == 0
        self.kept_rank = np.append(0, np.cumsum(self.kept, dtype=np.int32))
        self.samples = rows[self.kept].astype(np.int32)
        self.rest = rest

    def _squeeze(self, rows: np.ndarray) -> np.ndarray:
        return rows - (rows > self.bwt_gap)

    def rank(self, symbol: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often the symbol stands in the transform before each row."""
        lo, hi = np.zeros(len(rows), np.int64), self._squeeze(rows)
        for k, (ones, zeros) in enumerate(self.levels):
            one = (symbol >> (BITS - 1 - k)) & 1
            l1, h1 = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + l1, lo - l1), np.where(one, zeros + h1, hi - h1)
        return hi - lo

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with the symbol and go on as those of rows lo to hi."""
        s = symbol.astype(np.int64)
        return self.before[s] + self.rank(s, lo), self.before[s] + self.rank(s, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes of rows, walking back to the next sampled one."""
        at, rows, todo, walked = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows)), np.zeros(len(rows), np.int64)
        while len(todo):
            done = self.kept[rows[todo]]
            d = todo[done]
            at[d] = self.samples[self.kept_rank[rows[d]]] + walked[d]
            todo = todo[~done]
            if len(todo):
                s = self.rest[self._squeeze(rows[todo])].astype(np.int64)
                rows[todo] = self.before[s] + self.rank(s, rows[todo])
                walked[todo] += 1
        return at


class Items:
    """The test items of a block, as letters and phrases."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.letters = [letters_of(t)[0] for t in texts]
        lengths = np.array([len(x) for x in self.letters])
        offsets = np.append(0, np.cumsum(lengths))
        every = np.concatenate([np.zeros(0, np.uint32), *self.letters])
        self.symbols, starts = phrases(every, offsets[:-1])
        self.owner = np.searchsorted(offsets, starts, "right") - 1
        self.starts = starts - offsets[self.owner] if len(starts) else starts
        self.ends = np.append(starts[1:], len(every)) - offsets[self.owner] if len(starts) else starts
        self.lengths = lengths
        # phrases of the same item before each phrase: how far a search may go to the left
        first = np.searchsorted(self.owner, self.owner, "left")
        self.reach = np.arange(len(self.symbols)) - first + 1
        # phrases searched at once: all of a short item that end as they do in a document, LEAST of others
        sure = (self.starts > 0) & (self.ends <= lengths[self.owner] - 3) if len(starts) else np.zeros(0, bool)
        own = np.bincount(self.owner[sure], minlength=len(ids))
        self.need = np.clip(own, 1, LEAST)[self.owner]
        self.tiny = np.flatnonzero((own == 0) & (lengths > 0))
        self.windows = [_windows(x) for x in self.letters]


def _windows(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of WINDOW letters, in order of hash, where they start, and which last 16 bits they have."""
    h = _rolling(letters)
    order = np.argsort(h, kind="stable")
    seen = np.zeros(1 << 16, bool)
    seen[h & np.uint64(0xFFFF)] = True
    return h[order], order, seen


def _rolling(letters: np.ndarray) -> np.ndarray:
    n = len(letters) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x, h = _hash(letters.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h = h * np.uint64(0x100000001B3) + x[i : i + n]
    return h


def places(index: FMIndex, items: Items, starts: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(last phrase, document) of each run of LEAST item phrases that a document holds, for whole documents at a time.

    starts, offsets: letters at which the phrases of the index and the documents begin. Different runs of one length have
    rows of their own, so no more places are located than the index has.
    """
    for least in range(1, LEAST + 1):
        yield from _places(index, items, starts, offsets, np.flatnonzero((items.need == least) & (items.reach >= least)), least)


def _places(index: FMIndex, items: Items, starts: np.ndarray, offsets: np.ndarray, ends: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), index.n + 1, np.int64)
    for n in range(least):
        lo, hi = index.step(items.symbols[ends - n], lo, hi)
        ok = hi > lo
        ends, lo, hi = ends[ok], lo[ok], hi[ok]
    if not len(ends):
        return
    first, one, run, many = np.unique(lo, return_index=True, return_inverse=True, return_counts=True)
    ends = ends[np.argsort(run, kind="stable")]
    at = index.locate(_ranges(first, (hi - lo)[one]))
    run = np.repeat(np.arange(len(first)), (hi - lo)[one])
    doc = np.searchsorted(offsets, starts[at], "right") - 1
    inside = starts[np.minimum(at + least, len(starts)) - 1] < offsets[doc + 1]
    doc, run = np.divmod(np.unique(doc[inside] * len(first) + run[inside]), len(first))
    if not len(doc):
        return
    heads = np.flatnonzero(np.append(True, np.diff(doc) > 0))
    upto = np.cumsum(np.add.reduceat(many[run], heads))
    tails, done, k = np.append(heads[1:], len(doc)), 0, 0
    while k < len(heads):
        to = max(k + 1, int(np.searchsorted(upto, done + AT_ONCE, "right")))
        r = run[heads[k] : tails[to - 1]]
        yield ends[_ranges((np.cumsum(many) - many)[r], many[r])], np.repeat(doc[heads[k] : tails[to - 1]], many[r])
        done, k = upto[to - 1], to


def _ranges(begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, width of them, one after the other."""
    return np.repeat(begin - np.cumsum(width) + width, width) + np.arange(width.sum())


def _stretches(item: np.ndarray, windows: tuple[np.ndarray, np.ndarray, np.ndarray], h: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item from, to, doc from, to) of stretches that item and document share but for small changes; h: the document's _rolling."""
    hashes, order, seen = windows
    if not len(h) or not len(hashes):
        return []
    d = np.flatnonzero(seen[h & np.uint64(0xFFFF)])
    own = h[d]
    lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
    width = hi - lo
    d = np.repeat(d, width)
    i = order[_ranges(lo, width)]
    if not len(i):
        return []
    diag = d - i
    by = np.lexsort((i, diag))
    band = np.cumsum(np.append(0, np.diff(diag[by]) > 6))
    by = by[np.lexsort((i[by], band))]
    band = np.sort(band)
    i, d = i[by], d[by]
    cut = np.append(True, (np.diff(band) > 0) | (np.diff(i) > GAP) | (np.abs(np.diff(d) - np.diff(i)) > SHIFT))
    at = np.flatnonzero(cut)
    until = np.append(at[1:], len(i))
    wide = i[until - 1] - i[at] + WINDOW >= SPAN
    out = []
    for a, b in zip(at[wide], until[wide]):
        ii = i[a:b]
        span = int(ii[-1] - ii[0]) + WINDOW
        held = int(np.minimum(np.diff(np.append(ii, ii[-1] + WINDOW)), WINDOW).sum())
        if span >= SPAN and held >= DENSE * span:
            out.append((int(ii[0]), int(ii[-1]) + WINDOW, int(d[a:b].min()), int(d[a:b].max()) + WINDOW))
    return out


def whole(item: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Places in the document's letters where all letters of the item stand."""
    text, asked = (x.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass") for x in (doc, item))
    return [(m.start(), m.start() + len(item)) for m in re.finditer(f"(?={re.escape(asked)})", text)] if len(item) else []


def cover(item: np.ndarray, windows: tuple[np.ndarray, np.ndarray, np.ndarray], doc: np.ndarray, rolling: np.ndarray | None = None) -> tuple[float, list[tuple[int, int]]]:
    """Part of the item that the best one or two stretches in order cover, and the places of all stretches in the document's letters.

    Of an item under SPAN letters the one stretch is the whole item, letter for letter.
    """
    if len(item) < SPAN:
        spans = whole(item, doc)
        return float(bool(spans)), spans
    best = 0
    found = sorted(_stretches(item, windows, _rolling(doc) if rolling is None else rolling), key=lambda x: x[0] - x[1])
    if found:
        best = found[0][1] - found[0][0]
    # the later of two by where it begins in the document; of those that end before, by where they end in the item, the longest and the one that begins first
    ended = sorted(found, key=lambda x: x[3])
    longest, earliest, k = np.zeros(len(item) + 1, np.int64), np.full(len(item) + 1, len(item) + 1), 0
    for y in sorted(found, key=lambda x: x[2]):
        while k < len(ended) and ended[k][3] - WINDOW <= y[2]:
            x, k = ended[k], k + 1
            longest[x[1]] = max(longest[x[1]], x[1] - x[0])
            earliest[x[1]] = min(earliest[x[1]], x[0])
        before = int(longest[: y[0] + 1].max())
        best = max(best, before + y[1] - y[0] if before else 0)
        begin = int(earliest[y[0] + 1 : y[1]].min())  # they overlap in the item
        best = max(best, y[1] - begin if begin <= y[0] else 0)
    return best / max(1, len(item)), [x[2:] for x in found]


class Shard:
    """Documents that are searched together: where their letters and phrases begin, and the index of the phrases."""

    def __init__(self, texts: list[str]):
        letters = [letters_of(t)[0] for t in texts]
        self.offsets = np.append(0, np.cumsum([len(x) for x in letters]))
        every = np.concatenate([np.zeros(0, np.uint32), *letters])
        symbols, self.starts = phrases(every, self.offsets[:-1])
        self.index = FMIndex(symbols) if len(symbols) else None

    def leaks(self, texts: list[str], items: Items) -> list[tuple[int, int, float, list[tuple[int, int]]]]:
        """(document of the shard, item of the block, cover, spans of characters) of the leaks in a shard."""
        return _shard_leaks(self, texts, items) if self.index and len(items.symbols) else []


def shard_leaks(texts: list[str], items: Items) -> list[tuple[int, int, float, list[tuple[int, int]]]]:
    return Shard(texts).leaks(texts, items)


def _shard_leaks(shard: Shard, texts: list[str], items: Items) -> list[tuple[int, int, float, list[tuple[int, int]]]]:
    out, held = [], lru_cache(64)(lambda d: letters_of(texts[d]))
    if len(items.tiny):  # no phrase to search for
        for d, text in enumerate(texts):
            letters, at = letters_of(text)
            for i in items.tiny:
                if spans := whole(items.letters[i], letters):
                    out.append((d, int(i), 1.0, [(int(at[a]), int(at[b - 1]) + 1) for a, b in spans]))
    rolled = lru_cache(64)(lambda d: _rolling(held(d)[0]))
    seen = {(d, i) for d, i, *_ in out}
    for last, doc in places(shard.index, items, shard.starts, shard.offsets):
        pair = doc * len(items.ids) + items.owner[last]
        # the item's letters that the places of a pair cover together
        begin, end = items.starts[last - items.need[last] + 1], items.ends[last]
        by = np.lexsort((begin, pair))
        pair, begin, end = pair[by], begin[by], end[by]
        fresh = np.append(True, np.diff(pair) > 0)
        reached = np.maximum.accumulate(end + pair * (1 << 32)) - pair * (1 << 32)
        reached = np.where(fresh, 0, np.append(0, reached[:-1]))
        gain = np.maximum(0, end - np.maximum(begin, reached))
        heads = np.flatnonzero(fresh)
        total = np.add.reduceat(gain, heads)
        long = items.lengths[pair[heads] % len(items.ids)]
        hopeful = pair[heads][(total >= HINT * long) | (long < SHORT)]
        for p in hopeful:
            d, i = divmod(int(p), len(items.ids))
            if (d, i) in seen:
                continue
            seen.add((d, i))
            part, spans = cover(items.letters[i], items.windows[i], held(d)[0], rolled(d))
            if part >= LEAK:
                places_of = held(d)[1]
                out.append((d, i, part, [(int(places_of[a]), int(places_of[b - 1]) + 1) for a, b in spans]))
    return out


def item_blocks(items: DataFrame, letters: int) -> DataFrame:
    """(block, item_id, text) of items with a text: blocks of about so many characters, one item at least."""
    x = items.where("text is not null").select("item_id", "text").withColumn("_h", F.pmod(F.xxhash64("item_id", "text"), F.lit(1024)).cast("int"))
    sums = x.groupBy("_h").agg(F.sum(F.length("text")).alias("_n"))
    before = sums.select("_h", F.coalesce(F.sum("_n").over(Window.orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # 1024 rows at most
    within = F.sum(F.length("text")).over(Window.partitionBy("_h").orderBy("item_id", "text").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_in", within).join(before, "_h").select(F.floor((F.col("_before") + F.col("_in") - 1) / letters).alias("block"), "item_id", "text")


def shard_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_letters: int = SHARD_LETTERS) -> DataFrame:
    """(ids, texts, index) of shards: documents of a partition, and the FM-index of their phrases as bytes.

    Kept as a table, an index serves every later set of items. Null texts are left out.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, texts in _shards(batches, shard_letters):
            yield pd.DataFrame({"ids": [ids], "texts": [texts], "index": [pickle.dumps(Shard(texts), protocol=5)]})

    kind = dict(documents.dtypes)[doc_id]
    return documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).mapInPandas(build, f"ids array<{kind}>, texts array<string>, index binary")


def _shards(batches: Iterator[pd.DataFrame], letters: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch["doc"], batch["text"]):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= letters:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_letters: int = SHARD_LETTERS, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """(doc_id, item_id, cover, spans): documents that hold test items, the part of the item held, and the spans to remove.

    items: (item_id, text). spans are the merged character places (from, to) in the document of every stretch that it
    shares with the item. An item under SPAN letters is held where all its letters stand in order. Null and empty texts
    hold nothing; repeated rows give repeated rows; an item without letters is in no document; an empty side gives no rows.
    """
    spark = documents.sparkSession
    blocks = item_blocks(items, block_letters)
    numbers = [r[0] for r in blocks.select("block").distinct().orderBy("block").collect()]  # one for each BLOCK_LETTERS of items
    columns = ["doc", "item_id", "cover", "spans"]
    kind = dict(documents.dtypes)[doc_id]
    schema = f"doc {kind}, item_id {dict(items.dtypes)['item_id']}, cover double, spans array<struct<from: int, to: int>>"
    one = len(numbers) < 2
    shards = documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("text")) if one else checkpointed(shard_index(documents, doc_id, text, shard_letters))
    out = None
    for number in numbers:
        # a block has a bounded size: it is the one thing that passes through the driver
        rows = blocks.where(F.col("block") == number).select("item_id", "text").toPandas().sort_values("item_id")
        sent = spark.sparkContext.broadcast(Items(rows["item_id"].tolist(), rows["text"].tolist()))

        def leaks(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            if one:
                every = ((ids, texts, Shard(texts)) for ids, texts in _shards(batches, shard_letters))
            else:
                every = ((r.ids, list(r.texts), pickle.loads(r.index)) for b in batches for r in b.itertuples())
            for ids, texts, shard in every:
                found = [(ids[d], sent.value.ids[i], part, _merged(spans)) for d, i, part, spans in shard.leaks(texts, sent.value)]
                if found:
                    yield pd.DataFrame(found, columns=columns)

        part = shards.mapInPandas(leaks, schema)
        out = part if out is None else out.unionByName(part)
    return (spark.createDataFrame([], schema) if out is None else out).withColumnRenamed("doc", doc_id)


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"from": a, "to": b} for a, b in out]
