"""Boundaries of the core operators on small fixtures."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from looseleaf.functions import text as t
from looseleaf.operators import blocks, budget, corpus, graph, memory, replies, vectors

TURNS = "turn_id bigint, user_id string, role string, text string, ts timestamp"


def turns(spark, *at, user="u"):
    day = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(i, user, "user" if i % 2 == 0 else "advisor", f"t{i}", day + dt.timedelta(hours=h)) for i, h in enumerate(at)], TURNS)


def test_gap_of_exactly_six_hours_closes(spark):
    got = memory.sessions(turns(spark, 0, 6, 11.99, 800)).orderBy("turn_id")
    assert [r["session_no"] for r in got.collect()] == [1, 2, 2, 3]
    s = memory.session_summary(turns(spark, 0, 6, 11.99, 800)).orderBy("session_no").collect()
    assert [r["closed"] for r in s] == [True, True, False]


def test_sessions_of_empty_and_null(spark):
    assert memory.sessions(turns(spark)).count() == 0
    bad = spark.createDataFrame([(1, None, "user", "x", None), (2, "u", "user", None, None)], TURNS)
    assert memory.sessions(bad).count() == 0


def test_history_cap(spark):
    x = turns(spark, *range(5))
    assert [r["turn_id"] for r in memory.last_turns(x, 2).orderBy("nth").collect()] == [4, 3]
    assert memory.last_turns(x, 0).count() == 0


def test_blocks_equal_plain_windows(spark):
    rnd = random.Random(4)
    df = spark.createDataFrame([(rnd.choice("ab"), i, rnd.randrange(9)) for i in range(60)], "k string, i int, v int")
    got = blocks.with_previous(df, ["k"], ["i"], "v", F.floor(F.col("i") / 7), "p")
    got = blocks.with_running_sum(got, ["k"], ["i"], F.col("v"), F.floor(F.col("i") / 7), "s")
    rows = got.orderBy("k", "i").collect()
    for _, g in itertools.groupby(rows, lambda r: r["k"]):
        total, before = 0, None
        for r in g:
            total += r["v"]
            assert (r["p"], r["s"]) == (before, total)
            before = r["v"]


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("q", i, c, f"x{c}") for i, c in enumerate([60, 50, 30, 20])], "q string, i bigint, c int, p string")
    assert [r["p"] for r in budget.keep_within(df, "q", "i", F.col("c"), 100, "p").orderBy("place").collect()] == ["x60", "x30"]


def test_sections_fall_back_to_chunks(spark):
    df = spark.createDataFrame([("q", 1, "a", "n" * 50, "c" * 5), ("q", 2, "b", None, "c" * 5), ("q", 3, "c", "n" * 500, None)], "q string, rank int, name string, note string, chunk string")
    got = [(r["label"], r["whole"]) for r in budget.pack_sections(df, "q", 40).orderBy("place").collect()]
    assert got == [("[1] a", False), ("[2] b", False)]


def test_repair_keeps_what_is_clean(spark):
    cases = [("ที่่�นี่", "ที่นี่"), ("ก�ข", "ก�ข"), ("สะอาด", "สะอาด"), ("", ""), (None, None), ("่่", "่")]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, text string").select("i", t.repair(F.col("text")).alias("r"))
    assert [r["r"] for r in df.orderBy("i").collect()] == [b for _, b in cases]
    assert [r["r"] for r in df.select("i", t.repair(F.col("r")).alias("r")).orderBy("i").collect()] == [b for _, b in cases]


def test_names_and_paths(spark):
    row = spark.createDataFrame([('a/b:c"d', "x/y/001-s-น.1-2.md")], "n string, p string").select(t.safe_name(F.col("n")), t.stem(F.col("p")), t.yaml_scalar(F.col("n")), t.context(F.lit("abcdef"), F.lit(1), 3, 2)).first()
    assert list(row) == ["a_b_c_d", "001-s-น.1-2", '"a/b:c\\"d"', "abc"]


def test_headings_that_restart_are_no_headings(spark):
    numbers = [(1, 1), (1, 2), (1, 1), (2, 1), (2, 3), (3, 1)]
    df = spark.createDataFrame([("b", i, a, m) for i, (a, m) in enumerate(numbers)], "key string, pos int, major int, minor int")
    assert [(r["major"], r["minor"]) for r in corpus.sequence_headings(df).orderBy("pos").collect()] == [(1, 1), (1, 2), (2, 1), (3, 1)]


def test_table_without_rule(spark):
    lines = ["| a | b |", "|---|---|", "| 1 | 2 |", "", "| x |", "| y | z |"]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(lines)], "key string, k int, line string")
    assert [(r["start"], r["rows"], r["separated"], r["widths"]) for r in corpus.table_runs(df).orderBy("start").collect()] == [(0, 3, True, 1), (4, 2, False, 2)]


def test_notes_without_frontmatter(spark):
    files = spark.createDataFrame([("a", "no head"), ("b", "---\nuid: x:y\n---\nbody"), ("c", "---\nuid: z")], "path string, content string")
    got = {r["path"]: (r["fields"], r["body"]) for r in corpus.parse_note(files).collect()}
    assert got == {"a": (None, "no head"), "b": ({"uid": "x:y"}, "body"), "c": (None, "---\nuid: z")}
    assert corpus.missing_fields(corpus.parse_note(files)).where("path = 'a'").first()["field"] == "frontmatter"


def test_near_names_against_all_pairs(spark):
    import difflib

    rnd = random.Random(2)
    names = ["".join(rnd.choice("abcd ") for _ in range(rnd.randrange(3, 12))) for _ in range(60)]
    names += [n[:-1] + "z" for n in names[:20]] + [n.upper() for n in names[20:25]]
    names = sorted(set(names))
    sq = {n: "".join(n.split()).lower() for n in names}
    want = sorted((a, b) for a in names for b in names if a < b and min(len(sq[a]), len(sq[b])) > 1 and difflib.SequenceMatcher(None, sq[a], sq[b], autojunk=False).ratio() >= 0.82)
    got = graph.near_names(spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want


def test_cosine_of_nothing(spark):
    row = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>").select(
        vectors.cosine(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("z")), vectors.cosine(F.col("a"), F.col("s"))
    ).first()
    assert list(row) == [1.0, None, None]


def test_replies(spark):
    x = spark.createDataFrame([("ดี [2][1] [2][99999999999]\n(อ้างอิง: ก น. 1-2)\n",), ("(อ้างอิง: ก)",), ("a\n[หัวข้อ]:\n- b\n1. c\n(อ้างอิง: z)\n" + "d" * 30,), ("[หัวข้อ]\nb",)], "r string")
    got = x.select(replies.cited_ids(F.col("r")).alias("i"), replies.split_citation(F.col("r")).alias("c"), replies.topic_menu(F.col("r")).alias("m")).collect()
    assert got[0]["i"] == [1, 2] and tuple(got[0]["c"]) == ("ดี [2][1] [2][99999999999]", "ก น. 1-2")
    assert tuple(got[1]["c"]) == ("(อ้างอิง: ก)", None)
    assert tuple(got[2]["m"]) == ("a", ["b", "c", "d" * 20])
    assert tuple(got[3]["m"]) == ("[หัวข้อ]\nb", [])
