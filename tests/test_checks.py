"""Checks, interval joins and fallbacks on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from looseleaf.operators import checks as c, evaluation, graph


def test_interval_ends_count_and_days_are_crossed(spark):
    t = lambda d, h: dt.datetime(2025, 1, d, h)
    points = spark.createDataFrame([("u", 1, t(1, 10)), ("u", 2, t(3, 0)), ("u", 3, t(3, 1)), ("v", 4, t(2, 0)), ("u", 5, None)], "k string, p int, at timestamp")
    intervals = spark.createDataFrame([("u", 7, t(1, 10), t(3, 0))], "k string, i int, a timestamp, b timestamp")
    got = c.within_intervals(points, intervals, "k", "at", "a", "b", ["p"], ["i"])
    assert sorted(map(tuple, got.collect())) == [("u", 1, 7), ("u", 2, 7)]


def test_markers(spark):
    body = "a <!-- p.4 --> b <!-- p.4 --> c <!-- p.9 --> <!-- p.3 -->"
    df = spark.createDataFrame([(1, 3, 8, body), (2, 3, 8, "none"), (3, 3, 8, None)], "note_id int, page_first int, page_last int, body string")
    assert sorted(map(tuple, c.marker_violations(df).collect())) == [(1, 3, "order"), (1, 3, "outside"), (1, 4, "order"), (1, 9, "outside")]


def test_first_choice_and_domain(spark):
    a = spark.createDataFrame([("q", 1)], "k string, v int")
    b = spark.createDataFrame([("q", 2), ("r", 3)], "k string, v int")
    assert sorted(map(tuple, c.first_choice([a, b], "k").collect())) == [("q", 1, 0), ("r", 3, 1)]
    assert [tuple(r) for r in c.outside_domain(b, "v", "k", ["q"]).collect()] == [(3, "r")]


def test_reports(spark):
    lines = spark.createDataFrame([("k", i, x) for i, x in enumerate(["t", "|a|", "|---|", "|1|", "|a|", "|---|", "|2|"])], "key string, k int, line string")
    assert c.markdown_table(lines).first()["table"] == "|a|\n|---|\n|1|\n|2|"
    rate = spark.createDataFrame([("color", 0.5)], "axis string, rate double")
    assert c.rate_report(rate).first()["line"] == "color       50.0% " + "█" * 10
    both = spark.createDataFrame([("x ",), ("x",)], "b string").select(c.link(F.lit("u//"), "p", F.col("b")).alias("l"))
    assert [r["l"] for r in both.collect()] == ["u/p/x ", "u/p/x"]


def test_landing_and_recall_edges(spark):
    values = spark.createDataFrame([("a", "B c"), ("a", "xbcx"), ("a", "b"), ("a", "zz"), ("a", " "), ("a", None)], "axis string, value string")
    names = spark.createDataFrame([("bc",), (" ",), (None,)], "name string")
    got = {r["value"]: r["outcome"] for r in graph.landing(values, names).collect()}
    assert got == {"B c": "exact", "xbcx": "substring", "b": "substring", "zz": "miss", " ": "miss"}
    q = spark.createDataFrame([("q1", 2, ["s", "s", "t"]), ("q2", 1, [])], "qid string, hops int, expects array<string>")
    e = spark.createDataFrame([("q1", "mix", "s"), ("q1", "mix", None)], "qid string, mode string, section string")
    rows = {(r["qid"], r["mode"]): (r["found"], r["recall"]) for r in evaluation.section_recall(q, e, ["mix", "naive"]).collect()}
    assert rows == {("q1", "mix"): ("s", 0.5), ("q1", "naive"): ("", 0.0), ("q2", "mix"): ("", None), ("q2", "naive"): ("", None)}
    none = spark.createDataFrame([], "name string, type string, description string")
    edges = spark.createDataFrame([], "source string, target string")
    assert tuple(graph.summary(none, edges).first()) == (0, 0, 0, 0.0)
