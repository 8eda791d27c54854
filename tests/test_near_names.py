"""Near names: results and work on names made of the same syllables, and the similarity itself."""

import difflib
import random

import pandas as pd

from looseleaf.operators import graph


def syllables(rnd, n):
    parts = ["cas", "gal", "pal", "tur", "sen", "ver", "dul", "mer", "ner", "hy", "os", "ตา", "ครั่ง", "😀"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 8))) + rnd.choice(["", " ", "ensis", "osa"]) for _ in range(n)]


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_similarity_is_that_of_difflib():
    rnd = random.Random(5)
    a, b = syllables(rnd, 2000), syllables(rnd, 2000)
    a += ["", "", "a", "aaaa", "abcab" * 60]
    b += ["", "x", "a", "aa", "cabba" * 70]
    b[:1000] = [x[: (i := rnd.randrange(len(x)))] + rnd.choice(["", "q", x[:2]]) + x[i + rnd.randrange(3) :] for x in a[:1000]]
    assert graph.similarity()(pd.Series(a), pd.Series(b)).tolist() == [ratio(x, y) for x, y in zip(a, b)]
    assert graph.similarity()(pd.Series([], dtype=str), pd.Series([], dtype=str)).tolist() == []


def test_near_names_compares_little_more_than_it_finds(spark, monkeypatch):
    compared, made = spark.sparkContext.accumulator(0), graph.similarity

    def counted(*given):
        of = made(*given)

        def counting(a: pd.Series, b: pd.Series) -> pd.Series:
            compared.add(len(a))
            return of(a, b)

        return counting

    monkeypatch.setattr(graph, "similarity", counted)
    rnd = random.Random(6)
    names = sorted({*syllables(rnd, 500), *(x.upper() for x in syllables(rnd, 60))})
    sq = {x: "".join(x.split()).lower() for x in names}
    want = sorted((a, b, round(ratio(sq[a], sq[b]), 6)) for i, a in enumerate(names) for b in names[i + 1 :] if len(sq[a]) > 1 < len(sq[b]) and 2 * min(len(sq[a]), len(sq[b])) >= 0.82 * (len(sq[a]) + len(sq[b])) and ratio(sq[a], sq[b]) >= 0.82)
    got = graph.near_names(spark.createDataFrame([(x,) for x in names], "name string")).collect()
    assert sorted(map(tuple, got)) == want
    assert compared.value <= 3 * len(want)
