"""Garbled text from a wrong character encoding: noisy-channel decoding.

A damaged span is read back as bytes, a lattice in which each character gives the byte that it was decoded from and each
lost byte (U+FFFD, or a question mark within a word) is a wildcard. Channels read the bytes anew: UTF-8 that was read as
a one-byte encoding, once or twice, or Thai one-byte text read as a western one or as UTF-8. A Viterbi search over the
words of a text finds the channel of each word that makes the text most likely under the pair frequencies of characters
and the frequencies of words in the whole corpus; wildcards are filled by a second search within the word.

Scale: texts without any sign of damage are passed over by a test of character classes over whole Arrow batches. The others
are written down once with the pairs and words that their readings ask for; only these are looked up in the frequencies,
which are counted in one pass, within tasks first. A damaged word finds the words it can stand for by an equi-join on its
letters within ASCII. Nothing is collected or broadcast but the pairs of Thai letters, a table of fixed size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from looseleaf.session import checkpointed

#: Encodings that damaged text was read in.
WESTERN = ("cp1252", "mac_roman", "cp874")
#: Cost, in log likelihood, of reading a word through a channel, of changing the channel between words, of a pair or word never seen.
CHANNEL, SWITCH, UNSEEN = 5.0, 2.0, 14.0
#: Words with foreign letters count from so many occurrences.
SEEN = 3
#: Words that a task counts before it hands them on.
AT_ONCE = 200_000
LOST = "�"


@lru_cache(8)
def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte; bytes that the encoding leaves open stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
        if b < 160:
            out.setdefault(chr(b), b)
    return out


#: Classes of characters that signs of damage are made of, as bits.
_SURE, _LEAD_W, _TAIL_W, _LEAD_M, _TAIL_M, _LEAD_T, _TAIL_T, _HIGH, _LATIN, _THAI, _ASK, _LETTER, _E, _TN, _PRINT, _FOREIGN = (1 << k for k in range(16))


@lru_cache(1)
def _classes() -> np.ndarray:
    to = np.zeros(0x10000, np.uint16)
    for codec, lead, tail in (("cp1252", _LEAD_W, _TAIL_W), ("mac_roman", _LEAD_M, _TAIL_M), ("cp874", _LEAD_T, _TAIL_T)):
        for c, b in _bytes_of(codec).items():
            to[ord(c)] |= lead if 0xC2 <= b <= 0xF4 else tail if b < 0xC0 else 0
    to[0x80:0xA0] |= _SURE
    to[ord(LOST)] |= _SURE
    to[0xA1:0xFC] |= _HIGH
    to[0x0E01:0x0E5C] |= _THAI
    to[ord("?")] |= _ASK
    to[ord("เ")] |= _E
    to[[ord("ธ"), ord("น")]] |= _TN
    to[0x21:0x7F] |= _PRINT
    for cp in range(0x10000):
        if chr(cp).isalpha():
            to[cp] |= _LETTER
    for lo, hi in ((65, 91), (97, 123)):
        to[lo:hi] |= _LATIN
    to[0x80:] |= _FOREIGN
    to[0x0E01:0x0E5C] &= ~np.uint16(_FOREIGN)
    return to


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, classes, starts) of the texts, a blank after each."""
    starts = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    codes = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, _classes()[np.where(codes < 0x10000, codes, 0x20)], starts


def suspicious(f: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which texts hold a sign of damage; texts without one are sound.

    Signs are lost or control characters, a character that a lead byte of UTF-8 was read as before one that another byte
    was read as, three western letters beyond ASCII in a row, Latin beside Thai letters, Thai letters before western marks, and question marks within words
    or in long runs.
    """
    f = np.append(f, np.zeros(6, np.uint16))
    n = len(f) - 6
    at = lambda k, bit: (f[k : n + k] & np.uint16(bit)) != 0
    blank = f[:n] == 0
    hit = at(0, _SURE) | at(0, _LEAD_W) & at(1, _TAIL_W) | at(0, _LEAD_M) & at(1, _TAIL_M) | at(0, _HIGH) & at(1, _HIGH) & at(2, _HIGH)
    hit |= at(0, _LATIN) & at(1, _THAI) | at(0, _THAI) & at(1, _LATIN) | at(0, _LEAD_T) & at(1, _TAIL_T) & ~at(1, _THAI)
    ask = at(0, _ASK)
    if ask.any():
        hit |= at(0, _LETTER) & at(1, _ASK) & at(2, _LETTER) | ask & at(1, _ASK) & at(2, _ASK)
    hit |= at(0, _E) & at(1, _TN) & at(2, _TAIL_T) & at(3, _E) & at(4, _TN) & at(5, _TAIL_T)
    pair = at(1, _LEAD_T) & at(2, _TAIL_T)
    hit[1:] |= (at(0, _PRINT)[:-1] & (blank & pair & ((f[3 : n + 3] == 0) & at(4, _PRINT) | at(3, _TAIL_T) & (f[4 : n + 4] == 0) & at(5, _PRINT)))[1:])
    return np.add.reduceat(hit, starts[:-1]) > 0 if len(starts) > 1 else np.zeros(0, bool)


#: Valid UTF-8 beyond ASCII, as ranges of the bytes of each sequence.
_SEQUENCES = (((0xC2, 0xDF), (0x80, 0xBF)), ((0xE0, 0xE0), (0xA0, 0xBF), (0x80, 0xBF)), ((0xE1, 0xEC), (0x80, 0xBF), (0x80, 0xBF)), ((0xED, 0xED), (0x80, 0x9F), (0x80, 0xBF)), ((0xEE, 0xEF), (0x80, 0xBF), (0x80, 0xBF)), ((0xF0, 0xF0), (0x90, 0xBF), (0x80, 0xBF), (0x80, 0xBF)))


@lru_cache(8)
def _utf8_read_in(codec: str) -> re.Pattern:
    """A UTF-8 sequence as it reads in codec."""
    table = _bytes_of(codec)
    read = lambda lo, hi: "[" + "".join(c for c, b in table.items() if lo <= b <= hi) + "]"
    return re.compile("|".join("".join(read(*r) for r in ranges) for ranges in _SEQUENCES))


@lru_cache(1 << 16)
def _letter(sequence: str, codec: str) -> str:
    table = _bytes_of(codec)
    return bytes(table[c] for c in sequence).decode()


def read_again(word: str, codec: str) -> str | None:
    """The word with its UTF-8 sequences, which were read in codec, read right; None if it has none."""
    out, changed = _utf8_read_in(codec).subn(lambda m: _letter(m[0], codec), word)
    return out if changed else None


def thai_bytes(word: str) -> list[int] | None:
    """Bytes of a word that was Thai in one byte a letter and was read as UTF-8; -1 for lost bytes; None if it wasn't."""
    if LOST not in word:
        return None
    out: list[int] = []
    for c in word:
        if c == LOST:
            out.append(-1)
        elif c < "\x80":
            out.append(ord(c))
        else:
            try:
                out += c.encode()
            except UnicodeEncodeError:
                return None
    return out


#: A question mark within a word, which may stand for a lost letter.
_ASKED = re.compile(r"[^\W\d_]\?[^\W\d_]")


#: Bytes that were all lost.
_GONE = re.compile(r"\?{3,}")


#: Western letters that bytes of Thai letters were read as.
_HIGH_WESTERN = re.compile("[\xa1-\xfb]")


@lru_cache(1)
def _cp1252() -> tuple[re.Pattern, dict[int, int]]:
    """Words that cp1252 can hold, and what turns them into its bytes."""
    table = _bytes_of("cp1252")
    return re.compile("[\x00-\x7f" + "".join(table) + "]*"), {ord(c): b for c, b in table.items()}


_THAI_WORD = re.compile("[ก-๛]+")


THAI_LETTERS = [0x20, *range(0x0E01, 0x0E5C)]


class _Logs(dict):
    """Log likelihood of pairs of characters; pairs within ASCII count nothing."""

    def __missing__(self, pair: tuple[str, str]) -> float:
        self[pair] = found = 0.0 if pair[0] < "\x80" and pair[1] < "\x80" else -UNSEEN
        return found


class Model:
    """Corpus frequencies: pairs of Thai letters, and the other pairs and the words that one text asks for.

    A model without frequencies (asking) notes what it is asked for, by kind; its scores say nothing.
    """

    def __init__(self, pairs: dict[tuple[int, int], int], totals: dict[int, int], words: dict[str, int] | None = None, all_words: int = 0, fills: dict[str, str] | None = None, step: np.ndarray | None = None, asking: dict[str, set] | None = None):
        self.logs = _Logs({(chr(a), chr(b)): max(math.log(n / (totals.get(a, n) + 50)), -UNSEEN) for (a, b), n in pairs.items()})
        self.words, self.all, self.fills, self.asking = words or {}, all_words + 1, fills or {}, asking
        self.thai = THAI_LETTERS
        self.step = thai_steps(pairs, totals) if step is None else step

    def score(self, word: str) -> float:
        """Log likelihood of a word between blanks, of its pairs that hold a character beyond ASCII."""
        core = word.strip(".,;:!?()[]\"'“”*_#")
        pairs = zip(" " + word, word + " ")
        if self.asking is not None:
            self.asking["word"].add(core)
            self.asking["pair"].update(pairs)
            return 0.0
        if core in self.words:
            return max(math.log(self.words[core] / self.all), -UNSEEN) - 1
        known = sum(map(self.logs.__getitem__, pairs))
        return known - (UNSEEN if _ASKED.search(word) else 0) - 3 * sum(map(len, _GONE.findall(word))) if "?" in word else known

    def fill_word(self, word: str) -> str | None:
        """The most frequent corpus word that a word with wildcards can stand for."""
        m = re.search(rf"[^\W_]*(?:[{LOST}?][^\W_]*)+", word)
        if not m:
            return None
        core = m.group()
        if self.asking is not None:
            self.asking["fill"].add(core)
        return word[: m.start()] + self.fills[core] + word[m.end() :] if core in self.fills else None

    def fill_thai(self, raw: list[int]) -> tuple[str, float]:
        """The most likely Thai text of bytes with wildcards, by Viterbi search over letters."""
        if self.asking is not None:
            return "", 0.0
        n = len(self.thai)
        best, back = np.where(np.arange(n) == 0, 0.0, -1e9), []
        for b in raw:
            move = best[:, None] + self.step
            prev = move.argmax(0)
            best = move[prev, np.arange(n)]
            k = 0 if b == 0x20 else b - 0xA0 if 0xA1 <= b <= 0xFB else None
            if k is not None:
                keep = np.full(n, -1e9)
                keep[k] = best[k]
                best = keep
            elif b == -1:
                best[0] = -1e9
            back.append(prev)
        k = int(best.argmax())
        score, out = float(best[k]), []
        for prev in reversed(back):
            out.append(chr(self.thai[k]))
            k = int(prev[k])
        return "".join(reversed(out)), score


def thai_steps(pairs: dict[tuple[int, int], int], totals: dict[int, int]) -> np.ndarray:
    """Log likelihood of each Thai letter after each, a table of fixed size."""
    logs = {k: math.log(n / (totals.get(k[0], n) + 50)) for k, n in pairs.items()}
    return np.array([[logs.get((a, b), -UNSEEN) for b in THAI_LETTERS] for a in THAI_LETTERS])


def skeleton(word: str) -> str:
    """A word with everything beyond ASCII, and question marks, as `*`: the same for a word and what is left of it."""
    return re.sub(r"[^\x00-\x7f]|\?", "*", word)


def pattern(core: str) -> str:
    """A regular expression of the words that can have been read as core, in which lost characters stand for one each."""
    return "^" + "".join("[^\\x00-\\x7F]" if c in LOST + "?" else c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in core) + "$"


def _readings(word: str, model: Model) -> dict[str, tuple[str, float]]:
    """Channel to (text, log likelihood) of a word."""
    out = {"as is": (word, 0.0)}
    if word.isascii() and "?" not in word or len(word) > 3 and _THAI_WORD.fullmatch(word) and word.count("เธ") + word.count("เน") < 2:
        return out
    for codec in WESTERN:
        if (once := read_again(word, codec)) is not None:
            out[codec] = (once, model.score(once) - CHANNEL)
            if (twice := read_again(once, codec)) is not None:
                out[codec + " twice"] = (twice, model.score(twice) - 2 * CHANNEL)
    western, to_bytes = _cp1252()
    if _HIGH_WESTERN.search(word) and western.fullmatch(word):
        try:
            thai = word.translate(to_bytes).encode("latin-1").decode("cp874")
            out["thai"] = (thai, model.score(thai) - CHANNEL)
        except UnicodeDecodeError:
            pass
    if LOST in word or _ASKED.search(word):
        if filled := model.fill_word(word):
            out["lost letter"] = (filled, model.score(filled) - CHANNEL)
    if (raw := thai_bytes(word)) is not None and len(raw) > 2:
        text, score = model.fill_thai([b for b in raw])
        ascii_free = all(b == -1 or b >= 0xA1 for b in raw)
        if ascii_free:
            out["lost bytes"] = (text, score - CHANNEL)
    if LOST in word or _GONE.search(word):  # a lattice of wildcards only: garbled, and nothing to restore
        out["gone"] = (word, -CHANNEL - 1.2 * UNSEEN * word.count(LOST))
    if len(out) > 1:  # else its likelihood is the same on every path
        out["as is"] = (word, model.score(word))
    return out


def decode(text: str, model: Model) -> tuple[bool, str]:
    """(garbled, restored): whether a stretch was decoded wrongly, and the text with such stretches restored.

    Stretches whose bytes are all lost stay as they are.
    """
    parts = re.split(r"([ \t\r\n]+)", text)
    words = parts[::2]
    of = {word: _readings(word, model) for word in set(words)}
    best: dict[str, tuple[float, tuple]] = {"as is": (0.0, ())}
    for word in words:
        readings = of[word]
        new = {}
        top = max(best.values(), key=lambda x: x[0])
        for channel, (read, score) in readings.items():
            stay = best.get(channel)
            jump = top[0] - (SWITCH if len(readings) > 1 or channel != "as is" else 0)
            from_ = stay if stay and stay[0] >= jump else (jump, top[1])
            new[channel] = (from_[0] + score, (from_[1], channel, read))
        best = new
    state = max(best.values(), key=lambda x: x[0])[1]
    out, channels = [], []
    while state:
        state, channel, read = state
        out.append(read)
        channels.append(channel)
    parts[::2] = reversed(out)
    # question marks can be meant: bytes are gone where there are many of them, or a character that stands for them
    many = LOST in text or len([w for w in words if re.fullmatch(r"[?.,]*\?{3,}[?.,]*", w)]) >= 2 or "????????" in text
    return any(c != "as is" and (c != "gone" or many) for c in channels), "".join(parts)


_WORD = re.compile(r"[^\W\d_]*[^\W\d_\x00-\x7fก-๛][^\W\d_]*(?:[’'][A-Za-z]+)?|[A-Za-z]+’[A-Za-z]+|°C|½", re.U)


def _count(batches: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    thai, pairs, words = np.zeros(128 * 128, np.int64), Counter(), Counter()

    def counted() -> pd.DataFrame:
        k = np.flatnonzero(thai)
        pairs.update({((int(x) >> 7) + 0x0E00 << 21) + (int(x) & 127) + 0x0E00: int(thai[x]) for x in k})
        rows = [("pair", str(key), n) for key, n in pairs.items()] + [("word", w, n) for w, n in words.items()]
        thai[:] = 0
        pairs.clear()
        words.clear()
        return pd.DataFrame(rows, columns=["kind", "key", "n"])

    for batch in batches:
        texts = [t for t in batch[text] if t]
        if not texts:
            continue
        codes, f, starts = _codes(texts)
        sound = ~suspicious(f, starts)
        keep = np.repeat(sound, np.diff(starts))
        foreign = np.add.reduceat((f & np.uint16(_FOREIGN)) != 0, starts[:-1]) > 0
        codes = np.where((codes == 10) | (codes == 13) | (codes == 9), np.uint32(0x20), codes)[keep]
        a, b = codes[:-1], codes[1:]
        pa, pb = a - np.uint32(0x0E00), b - np.uint32(0x0E00)
        ta, tb = pa < 128, pb < 128
        both = ta & tb
        thai += np.bincount((pa[both] << np.uint32(7)) + pb[both], minlength=128 * 128)
        rest = np.flatnonzero(~both & ((a > 127) | (b > 127)))
        keys, counts = np.unique((a[rest].astype(np.int64) << 21) + b[rest], return_counts=True)
        pairs.update(dict(zip(keys.tolist(), counts.tolist())))
        # no word reaches over a blank, and each distinct piece is looked through once
        pieces = Counter(w for k in np.flatnonzero(sound & foreign) for w in texts[k].split() if not w.isascii())
        for piece, n in pieces.items():
            for w in _WORD.findall(piece):
                words[w] += n
        if len(pairs) + len(words) > AT_ONCE:
            yield counted()
    yield counted()


def frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key, n): pairs of characters and words with foreign letters, over all documents that show no sign of damage.

    Garbled text can't vouch for itself. A pair is a number, the code point of the first 21 bits higher than the second.
    """
    return documents.select(text).mapInPandas(lambda b: _count(b, text), "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _wanted(texts: list[str]) -> list[tuple[list[int], list[str], list[dict]]]:
    """What the decoding of each text asks of the frequencies: (pairs, words, fills)."""
    out, step = [], np.zeros((len(THAI_LETTERS), len(THAI_LETTERS)))
    for t in texts:
        asking: dict[str, set] = {"pair": set(), "word": set(), "fill": set()}
        model = Model({}, {}, {}, 0, {}, step, asking)
        for word in set(re.split(r"[ \t\r\n]+", t)):
            _readings(word, model)
        pairs = [(ord(a) << 21) + ord(b) for a, b in asking["pair"] if a > "\x7f" or b > "\x7f"]
        out.append((pairs, list(asking["word"]), [{"key": v, "skeleton": skeleton(v), "pattern": pattern(v)} for v in asking["fill"]]))
    return out


def damaged(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", seen: int = SEEN) -> DataFrame:
    """(doc_id, restored) of the documents that hold a stretch garbled by a wrong encoding.

    restored is the text with every stretch restored for which a reading is likely; where all bytes are lost it stays as
    it is. Null and empty texts are sound; repeated rows give repeated rows; an empty table gives no rows.
    """
    spark, kind = documents.sparkSession, dict(documents.dtypes)[doc_id]
    sums = checkpointed(frequencies(documents, text))
    letters = F.col("key").cast("bigint")
    first, second = F.shiftright(letters, 21), letters.bitwiseAND(F.lit(0x1FFFFF))
    pairs = sums.where("kind = 'pair' and n > 1").select(letters.alias("pair"), first.alias("a"), second.alias("b"), "n")
    totals = pairs.groupBy("a").agg(F.sum("n").alias("total"))
    thai = lambda c: (c == 0x20) | c.between(0x0E01, 0x0E5B)
    # a row for each two Thai letters at most, a fixed number
    t = pairs.where(thai(F.col("a")) & thai(F.col("b"))).join(totals, "a").toPandas()
    step = thai_steps({(int(a), int(b)): int(n) for a, b, n in zip(t["a"], t["b"], t["n"])}, {int(a): int(n) for a, n in zip(t["a"], t["total"])})
    words = sums.where((F.col("kind") == "word") & (F.col("n") >= seen)).select(F.col("key").alias("word"), "n")
    all_words = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            _, f, starts = _codes(list(batch["text"]))
            odd = batch[suspicious(f, starts)]
            if len(odd):
                yield pd.DataFrame({"doc": odd["doc"], "text": odd["text"], "row": [str(uuid4()) for _ in range(len(odd))]} | dict(zip(("pairs", "words", "fills"), zip(*_wanted(list(odd["text"]))))))

    asked = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.length(text) > 0)
    suspects = checkpointed(asked.mapInPandas(ask, f"doc {kind}, text string, row string, pairs array<bigint>, words array<string>, fills array<struct<key: string, skeleton: string, pattern: string>>"))
    wants = {k: suspects.select("row", F.explode(k + "s").alias("key")) for k in ("pair", "word")} | {"fill": suspects.select("row", F.explode("fills").alias("w")).select("row", "w.*")}
    pair_of = pairs.join(totals, "a").select(F.col("pair").alias("key"), F.struct(F.lit("pair").alias("kind"), F.col("pair").cast("string").alias("key"), "n", "total", F.lit("").alias("word")).alias("v"))
    word_of = words.select(F.col("word").alias("key"), F.struct(F.lit("word").alias("kind"), F.col("word").alias("key"), "n", F.lit(0).cast("bigint").alias("total"), F.lit("").alias("word")).alias("v"))
    fills = wants["fill"].select("key", "skeleton", "pattern").distinct()
    bare = F.regexp_replace("word", r"[^\x00-\x7f]|\?", "*")
    # both sides of a fill are alike within ASCII; of the words that fit the most frequent counts
    met = fills.join(words.withColumn("skeleton", bare), "skeleton").where(F.regexp_like("word", F.col("pattern")))
    fill_of = met.groupBy("key").agg(F.max(F.struct("n", "word")).alias("b")).select("key", F.struct(F.lit("fill").alias("kind"), F.col("key"), F.col("b.n").alias("n"), F.lit(0).cast("bigint").alias("total"), F.col("b.word").alias("word")).alias("v"))
    got = None
    for k, side in (("pair", pair_of), ("word", word_of), ("fill", fill_of)):
        one = wants[k].select("row", "key").join(side, "key").select("row", "v")
        got = one if got is None else got.unionByName(one)
    # a filled word is scored like any other
    filled = wants["fill"].select("row", "key").join(fill_of, "key").select("row", F.col("v.word").alias("key")).join(word_of, "key").select("row", "v")
    known = got.unionByName(filled).groupBy("row").agg(F.collect_list("v").alias("known"))

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for d, t, rows in zip(batch["doc"], batch["text"], batch["known"]):
                by: dict[str, list] = {"pair": [], "word": [], "fill": []}
                for r in rows if rows is not None else []:
                    by[r["kind"]].append(r)
                pair = {divmod(int(r["key"]), 1 << 21): int(r["n"]) for r in by["pair"]}
                total = {int(r["key"]) >> 21: int(r["total"]) for r in by["pair"]}
                model = Model(pair, total, {r["key"]: int(r["n"]) for r in by["word"]}, all_words, {r["key"]: r["word"] for r in by["fill"]}, step)
                garbled, restored = decode(t, model)
                if garbled:
                    found.append((d, restored))
            yield pd.DataFrame(found, columns=["doc", "restored"])

    joined = suspects.select("doc", "text", "row").join(known, "row", "left").select("doc", "text", "known")
    return joined.mapInPandas(restore, f"doc {kind}, restored string").withColumnRenamed("doc", doc_id)
