import random

import pytest
from pyspark.sql import functions as F

from looseleaf.llm.misread import corrections
from looseleaf.llm.scan_noise import noise_kinds, repaired

SCHEMA = "src string, row_id bigint, book string, first int, last int, titles array<string>, text string, k int"
NOUNS = ["bark", "heartwood", "stomach", "element", "resin", "morning", "fever", "tongue", "warmth", "farmers"]


def sentence(rnd):
    return f"The {rnd.choice(NOUNS)} of the {rnd.choice(NOUNS)} eases the {rnd.choice(NOUNS)}, then follows some {rnd.choice(NOUNS)} with a {rnd.choice(NOUNS)} whole."


@pytest.fixture(scope="module")
def books(spark):
    rnd, rows = random.Random(1), []
    name = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    for b in range(6):
        for p in range(1, 31):
            text = sentence(rnd) + "\n" + sentence(rnd)
            if p % 5 == 0:
                text = f"Chapter of {name[b]} and rest\n" + text
            text += rnd.choice(["", "\nand then rests until evening comes.", "\nthe farmers keep it whole."])
            rows.append(["notes" if b < 3 else "pages", 100 * b + p, f"b{b}", p, p, [f"Title of volume {name[b]}", f"Chapter of {name[b]} and rest" if b < 3 else None], text, 0])
    by = {r[1]: r for r in rows}
    by[301][6] = "TITLE OF VOLUME DELTA | 1\n" + by[301][6]
    by[302][6] += "\n- 2 -"
    by[303][6] = "A topic that stands once\n" + by[303][6]
    by[304][6] = by[304][6].replace("whole", "who-\nle", 1)
    by[306][6] = by[306][6].replace("follows", "fo1lows", 1)
    by[307][6] = by[307][6].replace("warmth", "wannth") + " The wannth. Some artvvood."
    by[308][6] += " eases the heartvvood now"
    by[309][6] += "\n30"
    by[311][6] = "T i t l e   o f   v o l u m e   d e l t a\n" + by[311][6]
    by[312][6] = None
    by[313][6] = ""
    by[314][5] = [None, None]
    by[314][6] = "« Title of volume delta »\n" + by[314][6]
    df = spark.createDataFrame([tuple(r) for r in rows] + [tuple(by[302])], SCHEMA)
    return by, df


def test_kinds(books):
    by, df = books
    got = {}
    for r in noise_kinds(df, known=("notes",)).collect():
        got.setdefault(r["row_id"], set()).add(r["kind"])
    assert got[301] == {"running_header", "page_number"}
    assert got[302] == {"page_number"}
    assert 303 not in got and 309 not in got and 312 not in got and 313 not in got
    assert got[304] == {"hyphenation"}
    assert got[306] == {"misread"} and got[308] == {"misread"}
    assert got[311] == got[314] == {"running_header"}
    # chapters of books without known chapters are found by the classifier
    assert all(got[100 * b + p] == {"running_header"} for b in (4, 5) for p in (5, 10, 30))


def test_corrections_do_not_depend_on_the_size_of_the_corpus(books):
    by, df = books
    texts = df.where("text is not null").select("src", "row_id", "text").distinct()
    often = texts.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(5)))).select("src", (F.col("row_id") + 1000 * F.col("copy")).alias("row_id"), "text")
    found = {(r["row_id"], r["at"], r["size"], r["x"]) for r in corrections(texts).collect()}
    again = {(r["row_id"] % 1000, r["at"], r["size"], r["x"]) for r in corrections(often).collect()}
    assert found == again
    read = {by[i][6][a : a + n] + ">" + x for i, a, n, x in found}
    assert {"1>l", "vv>w"} <= read


def test_planted_originals_come_back(spark):
    rnd, rows, whole = random.Random(5), [], {}
    wrong = {"m": "rn", "w": "vv", "o": "0", "l": "1", "s": "5", "e": "�", "i": "!"}
    for i in range(400):
        text = sentence(rnd) + " " + sentence(rnd)
        whole[i] = text
        if i % 4 == 0:
            spots = [k for k in range(6, len(text) - 6) if text[k] in wrong and text[k - 1].isalpha() and text[k + 1].isalpha() and text[k - 2].isalpha()]
            for k in sorted(rnd.sample(spots, 3), reverse=True):
                text = text[:k] + wrong[text[k]] + text[k + 1 :]
        cut = text.index(" ", 60)
        text = text[:cut] + "\n" + text[cut + 1 :]
        if i % 5 == 0:
            at = max(k for k in range(40) if text[k : k + 4].isalpha()) + 2
            text = text[:at] + "-\n" + text[at:]
        if i % 3 == 0:
            text += f"\n- {i} -"
        rows.append(("pages", i, "b", i, i, [None], text))
    got = {r["row_id"]: r["text"] for r in repaired(spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0])).collect()}
    same = sum(got[i] == whole[i] for i in whole)
    assert same >= 0.95 * len(whole), [(got[i], whole[i]) for i in whole if got[i] != whole[i]][:5]


def test_paragraphs_stay(spark):
    rows = [("pages", 1, "b", 3, 3, [None], "One line\nand its end.\n\nA second para-\ngraph."), ("pages", 2, "b", 4, 4, [None], "\n\n"), ("pages", 3, "b", 4, 4, [None], "a paragraph " * 20000)]
    got = {r["row_id"]: r["text"] for r in repaired(spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0])).collect()}
    assert got[1] == "One line and its end.\n\nA second paragraph." and got[2] == "" and got[3] == ("a paragraph " * 20000).strip()


def test_repair(books):
    by, df = books
    got = {r["row_id"]: r["text"] for r in repaired(df, known=("notes",)).collect()}
    clean = lambda t: " ".join(t.split())
    assert got[302] == clean(by[302][6].replace("\n- 2 -", ""))
    assert got[304] == clean(by[304][6].replace("who-\nle", "whole"))
    assert got[306] == clean(by[306][6].replace("fo1lows", "follows"))
    assert got[308].endswith("heartwood now")
    assert got[313] == "" and 312 not in got


def test_empty(spark, books):
    assert noise_kinds(books[1].limit(0)).count() == 0
    assert repaired(books[1].limit(0)).count() == 0
