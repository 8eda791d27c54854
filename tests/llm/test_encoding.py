import random
import sys
from collections import Counter

import pandas as pd
import pytest

from looseleaf.llm import encoding
from looseleaf.llm.encoding import damaged

SOUND = ["The café keeps crème and maçã – it isn’t new, 25 °C.", "ใบพรายน้ำค้างใช้ยอด กรองสองครั้ง ลดบวม และบรรเทาปวดศีรษะตื้อ ช่วงเปลี่ยนฤดู", "GRÃOS and the Île, about ½ cup. เนื้อ เธอ", "เมื่อฝ้าขาวหนาจางลงหลังมื้อเย็น แปลว่าธาตุน้ำกลับสู่สมดุล ต้มสามเอาหนึ่ง", "What? plain??"]


def lenient(text, codec):
    return "".join(bytes([b]).decode(codec) if _ok(b, codec) else chr(b) for b in text.encode())


def _ok(b, codec):
    try:
        bytes([b]).decode(codec)
        return True
    except UnicodeDecodeError:
        return False


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, SOUND[i % 5], "x") for i in range(60)]
    odd = {100: lenient(SOUND[0], "cp1252"), 101: lenient(SOUND[1], "cp1252"), 102: lenient(SOUND[1], "mac_roman"), 103: lenient(SOUND[3], "cp874"), 104: lenient(lenient(SOUND[0], "cp1252"), "cp1252"), 105: SOUND[3].encode("cp874").decode("latin-1")}
    odd |= {106: SOUND[1][:20] + " " + lenient(SOUND[3], "cp1252"), 107: SOUND[0].replace("é", "�"), 108: SOUND[1].encode("cp874").decode("utf-8", "replace"), 109: "x ????????????? ???????? y", 110: lenient("25 °C", "cp874") + " " + SOUND[0]}
    rows += [(i, t, "x") for i, t in odd.items()] + [(200, None, "x"), (201, "", "x"), (100, odd[100], "x")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, restored string")
    return odd, [(r["doc_id"], r["restored"]) for r in damaged(df).collect()]


def test_garbled_are_found_and_sound_are_not(found):
    odd, got = found
    assert sorted(i for i, _ in got) == sorted([*odd, 100])


def test_round_trip(found):
    got = dict(found[1])
    for i, t in ((100, SOUND[0]), (101, SOUND[1]), (102, SOUND[1]), (103, SOUND[3]), (104, SOUND[0]), (105, SOUND[3]), (107, SOUND[0])):
        assert got[i] == t
    assert got[106] == SOUND[1][:20] + " " + SOUND[3]


def test_empty(spark):
    assert damaged(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def by_letters(word, codec):
    """read_again, one character after another."""
    table, out, changed, at = encoding._bytes_of(codec), [], False, 0
    while at < len(word):
        for size in (2, 3, 4):
            raw = [table.get(c, 0) for c in word[at : at + size]]
            if len(raw) == size and 0 not in raw:
                try:
                    if len(letter := bytes(raw).decode()) == 1 and (size < 4 or raw[0] == 0xF0):
                        out.append(letter)
                        changed, at = True, at + size
                        break
                except UnicodeDecodeError:
                    pass
        else:
            out.append(word[at])
            at += 1
    return "".join(out) if changed else None


@pytest.mark.parametrize("codec", encoding.WESTERN)
def test_utf8_read_again_as_letter_by_letter(codec):
    dice, letters = random.Random(2), [*encoding._bytes_of(codec), "a", "?", "�", "\ud800", "Ð", "ก", "😀"]
    lead = [c for c, b in encoding._bytes_of(codec).items() if b >= 0xC0]
    tail = [c for c, b in encoding._bytes_of(codec).items() if b < 0xC0]
    for _ in range(20_000):
        word = "".join(dice.choice(dice.choice((lead, tail, tail, letters))) for _ in range(dice.randrange(9)))
        assert encoding.read_again(word, codec) == by_letters(word, codec)
    for b in (0xE0, 0xED, 0xEF, 0xF0, 0xF4):  # overlong forms, surrogates and what lies beyond Unicode stay
        for second in range(0x80, 0xC0):
            word = lenient("x", codec) + "".join(next(c for c, k in encoding._bytes_of(codec).items() if k == n) for n in (b, second, 0x80, 0x80))
            assert encoding.read_again(word, codec) == by_letters(word, codec)


def test_letters_that_are_no_utf8_take_no_step_each():
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        encoding.read_again("éü" * 5000, "cp1252")
    finally:
        sys.setprofile(None)
    assert len(calls) < 1000


def test_a_word_of_a_text_is_read_once(monkeypatch):
    read, real = [], encoding._readings
    monkeypatch.setattr(encoding, "_readings", lambda word, model: read.append(word) or real(word, model))
    assert encoding.decode("cafÃ© x cafÃ© x cafÃ©", encoding.Model({}, {}))[1].count("café") == 3
    assert sorted(read) == ["cafÃ©", "x"]


def test_asking_searches_nothing(monkeypatch):
    monkeypatch.setattr(encoding.np, "arange", lambda *_: pytest.fail("a search over letters whose result nobody reads"))
    lost = SOUND[3].encode("cp874").decode("utf-8", "replace")
    assert encoding._wanted([lost])


def test_words_are_sought_once_in_each_piece(monkeypatch):
    class Seen:
        pieces: list = []

        def findall(self, piece):
            self.pieces.append(piece)
            return real.findall(piece)

    real = encoding._WORD
    texts = ["plain words, and the café crème – isn’t\u2003été 25 °C, ½ cup. เนื้อ"] * 50 + ["GRÃOS plain"] * 7 + [SOUND[1]]
    monkeypatch.setattr(encoding, "_WORD", Seen())
    got = pd.concat(encoding._count(iter([pd.DataFrame({"text": texts})]), "text"))
    whole = Counter(w for t in texts for w in real.findall(t))
    assert {r.key: r.n for r in got.itertuples() if r.kind == "word"} == dict(whole)
    assert len(Seen.pieces) == len(set(Seen.pieces)) and not any(" " in p or p.isascii() for p in Seen.pieces)
