import random

import numpy as np

from looseleaf.llm import contamination
from looseleaf.llm.contamination import FMIndex, Items, cover, find_leaks, letters_of, suffix_array


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randrange(3, 9))) for _ in range(n))


def test_index_against_brute_force():
    rng = np.random.default_rng(0)
    for alphabet in (1, 2, 5):
        s = rng.integers(0, alphabet, 150).astype(np.uint16) * 9001
        assert list(suffix_array(s)) == sorted(range(150), key=lambda i: list(s[i:]))
        index = FMIndex(s)
        for a, n in ((0, 3), (50, 6), (147, 3)):
            pattern, lo, hi = s[a : a + n], np.array([0]), np.array([151])
            for c in pattern[::-1]:
                lo, hi = index.step(np.array([c]), lo, hi)
            want = [i for i in range(151 - n) if list(s[i : i + n]) == list(pattern)]
            assert sorted(index.locate(np.arange(lo[0], hi[0]))) == want


def test_finds_what_brute_force_finds(spark):
    rnd = random.Random(1)
    items = [(i, words(rnd, 60)) for i in range(12)]
    docs, planted = [], set()
    for d in range(80):
        text = words(rnd, 200)
        if d % 4 == 0:
            i, passage = items[d % 12]
            cut = passage[: len(passage) * 2 // 3] if d % 8 else passage
            noisy = "".join(c.upper() if rnd.random() < 0.2 else c for c in cut).replace(" ", "  ", 5)
            at = rnd.randrange(300)
            text = text[:at] + " ... **" + noisy[:150] + "**\n\n" + noisy[150:] + text[at:]
            planted.add((d, i))
        docs.append((d, text, "x"))
    docs += [(900, None, "x"), (901, "", "x"), (902, "12 34", "x")]
    found = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string"), shard_letters=20_000).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    own = Items([i for i, _ in items], [t for _, t in items])
    brute = {(d, i) for d, t, _ in docs if t for i, _ in items if cover(own.letters[i], own.windows[i], letters_of(t)[0])[0] >= 0.33}
    assert planted == got == brute
    texts = {d: t for d, t, _ in docs}
    for r in found:
        for s in r["spans"]:
            assert 0 <= s["from"] < s["to"] <= len(texts[r["doc_id"]])


def test_short_quotes_and_empty_sides(spark):
    rnd = random.Random(2)
    item = words(rnd, 60)
    docs = spark.createDataFrame([(1, words(rnd, 50) + " " + item[:60] + " " + words(rnd, 50)), (2, item), (2, item)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "!!")], "item_id bigint, text string")
    assert [(r["doc_id"], r["item_id"]) for r in find_leaks(docs, items).collect()] == [(2, 7), (2, 7)]
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0


def test_second_part_beside_a_part_repeated_often():
    rnd = random.Random(3)
    item = words(rnd, 60)
    own = Items([0], [item])
    n = len(item)
    doc = " ".join(item[: n // 4] + " " + words(rnd, 12) for _ in range(45)) + " " + item[n // 2 : n // 2 + n // 5]
    part, spans = cover(own.letters[0], own.windows[0], letters_of(doc)[0])
    assert part > 0.4 and len(spans) == 46  # every copy is to be removed


def test_pairs_against_brute_force(monkeypatch):
    rnd = random.Random(4)
    for _ in range(300):
        found = []
        for _ in range(rnd.randrange(1, 30)):
            a, d, size = rnd.randrange(150), rnd.randrange(900), rnd.randrange(40, 60)
            found.append((a, a + size, d, d + size + rnd.randrange(-3, 4)))
        monkeypatch.setattr(contamination, "_stretches", lambda *_: found)
        best = max(x[1] - x[0] for x in found)
        for x in found:
            for y in found:
                if x[0] <= y[0] and x[1] < y[1] and y[2] >= x[3] - contamination.WINDOW:
                    best = max(best, y[1] - max(y[0], x[1]) + x[1] - x[0])
        assert cover(np.zeros(210), None, None, np.zeros(0))[0] == best / 210


def test_parts_that_stand_in_many_documents():
    rnd = random.Random(5)
    item = words(rnd, 55)
    n = len(item)
    parts = [item[k * n // 10 : k * n // 10 + n // 5] for k in (0, 3, 6)]
    docs = [" ".join(words(rnd, 10) + " " + p for p in parts) + " " + words(rnd, 10) for _ in range(150)]
    found = contamination.shard_leaks([*docs, words(rnd, 100)], Items([7], [item]))
    assert sorted(d for d, *_ in found) == list(range(150))


def test_short_items_held_whole():
    rnd = random.Random(6)
    letters = lambda n: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    for size in (3, 8, 12, 24, 36, 41, 60):
        asked = [letters(size) for _ in range(40)]
        docs = [words(rnd, 40) + " " + x[: size // 2] + ", " + x[size // 2 :].upper() + " " + words(rnd, 40) for x in asked]
        found = contamination.shard_leaks(docs, Items(list(range(40)), asked))
        assert {(d, i) for d, i, *_ in found} >= {(d, d) for d in range(40)}, size
        own = Items(list(range(40)), asked)
        if size < contamination.SPAN:
            brute = {(d, i) for d, t in enumerate(docs) for i in range(40) if contamination.whole(own.letters[i], letters_of(t)[0])}
            assert {(d, i) for d, i, *_ in found} == brute


def test_all_stretches_are_to_be_removed(spark):
    rnd = random.Random(7)
    item = words(rnd, 80)
    n = len(item)
    twice = "x" * 50 + item + " " + words(rnd, 30) + " " + item
    thirds = " ".join(words(rnd, 30) + " " + item[k * n // 4 : k * n // 4 + n // 5] for k in range(3))
    docs = spark.createDataFrame([(1, twice), (2, thirds)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, words(rnd, 80)), (9, words(rnd, 80))], "item_id bigint, text string")
    for letters in (contamination.BLOCK_LETTERS, 500):  # one block, and several over a kept index
        spans = {r["doc_id"]: r["spans"] for r in find_leaks(docs, items, block_letters=letters).collect()}
        assert len(spans[1]) == 2 and len(spans[2]) == 3
        assert all(s["to"] - s["from"] > 0.9 * n for s in spans[1])
