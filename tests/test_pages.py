import difflib
import json
import os
import random
import unicodedata

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from looseleaf.operators import blocks, checks as c, corpus, graph as g, vectors as v
from looseleaf.sources import files


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def test_headings_are_parsed_and_followed(spark):
    df = texts(spark, "1.1 One\nbody 3.5 g\n1.2\tTwo  \r\n3.1 no\n2.1 Three", None, "", "12.7 only")
    got = corpus.heading_parse(df, "id", "text").orderBy("id", "line").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 1, "One"), (0, 2, 1, 2, "Two"), (0, 3, 3, 1, "no"), (0, 4, 2, 1, "Three"), (3, 0, 12, 7, "only")]
    kept = corpus.sequence_headings(corpus.heading_parse(df, "id", "text").select(F.col("id").alias("key"), F.col("line").alias("pos"), "major", "minor"))
    assert sorted((r["key"], r["pos"]) for r in kept.collect()) == [(0, 0), (0, 2), (0, 4)]


def test_index(spark):
    got = corpus.index_entries(texts(spark, "1 Group  one\n1.1 a, b  b;\n1.2 ,\n2.1 lone", None), "id", "text").collect()
    assert sorted(map(tuple, got), key=repr) == [(0, 1, "Group one", 1, "a"), (0, 1, "Group one", 1, "b b"), (0, 2, None, 1, "lone")]


def test_captions_and_lines_above(spark):
    df = texts(spark, "**Cap**\n\n| a |\n|---|\ntext\n\n| b |", "| c |", None, "")
    assert sorted(map(tuple, corpus.table_captions(df, "id", "text").collect()), key=repr) == [(0, 2, "Cap"), (0, 6, None), (1, 0, None)]
    assert [tuple(r) for r in corpus.line_above(df, "id", "text", "^text").collect()] == [(0, 4, "|---|")]


def test_furniture(spark):
    df = texts(spark, "one\n- 12 -\ntwo\nTitle\n\n 13 \n", "Title", None, "", "3 g of it")
    got = [r[0] for r in df.orderBy("id").select(corpus.strip_furniture(F.col("text"), F.array(F.lit("Title"), F.lit(None).cast("string")))).collect()]
    assert got == ["one\ntwo", "", None, "", "3 g of it"]


def test_names_not_composed(spark):
    rows = [(1, "b/caf" + unicodedata.normalize("NFD", "é") + ".md"), (2, "b/café.md"), (3, "b/plain.md"), (4, None), (5, "b/น้ำ.md")]
    got = corpus.names_not_composed(spark.createDataFrame(rows, "note_id int, path string")).collect()
    assert [r["note_id"] for r in got] == [1]


def test_parents(spark):
    notes = spark.createDataFrame([(1, "b", "x/b/1.md"), (2, "b", "x/c/1.md"), (3, "d", "x/d/1.md"), (4, None, "x/b/1.md")], "note_id int, book_id string, path string")
    books = spark.createDataFrame([("b",), ("c",)], "book_id string")
    assert sorted(map(tuple, corpus.parent_errors(notes, books).collect())) == [(2, "folder"), (3, "book"), (4, "book"), (4, "folder")]


def test_books_in_blocks_as_in_one(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a", "a", "a", "b"]), rnd.randrange(50), rnd.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "note_id int, book string, at int, value int")
    x = blocks.ranged(df, ["book"], ["at", "note_id"], 7)
    keys, order, b = ["book"], ["at", "note_id"], F.col("_range")
    got = blocks.with_max_before(blocks.with_next(blocks.with_previous(x, keys, order, "value", b, "p"), keys, order, "value", b, "n"), keys, order, F.col("value"), b, "m")
    for book in "ab":
        own = sorted((r for r in rows if r[1] == book), key=lambda r: (r[2], r[0]))
        want = {r[0]: (own[i - 1][3] if i else None, own[i + 1][3] if i + 1 < len(own) else None, max((y[3] for y in own[:i]), default=None)) for i, r in enumerate(own)}
        assert {r["note_id"]: (r["p"], r["n"], r["m"]) for r in got.where(F.col("book") == book).collect()} == want
    place = {r["note_id"]: r["place"] for r in c.in_order(df, ["at", "note_id"]).collect()}
    assert place == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    assert c.in_order(df.limit(0), ["at"]).count() == 0


def test_zipped_strict(spark):
    a, b = (spark.createDataFrame(x, "k string, n int") for x in ([("x", 1), ("x", 2)], [("x", 3)]))
    b = b.withColumnRenamed("n", "m")
    assert sorted(map(tuple, c.zipped(a, b, "k", ["n"], ["m"], ["n"], ["m"]).select("n", "m").collect()), key=repr) == [(1, 3), (2, None)]
    with pytest.raises(PySparkException):
        c.zipped(a, b, "k", ["n"], ["m"], ["n"], ["m"], strict=True).collect()
    assert c.zipped(a.limit(1), b, "k", ["n"], ["m"], ["n"], ["m"], strict=True).count() == 1


def test_stores_events_payloads_counts(spark):
    df = spark.createDataFrame([(1, "a", '{"k": 1}'), (2, "b", "[1]"), (3, None, None), (4, "c", '{"x": 1}'), (5, "a", "{")], "id int, kind string, props string")
    got = c.store_check({"x": ("authoritative", df), "y": ("derived", df.limit(0)), "z": ("authoritative", None), "w": ("derived", None)})
    assert {(r["store"], r["rows"], r["status"]) for r in got.collect()} == {("x", 5, "ok"), ("y", 0, "empty"), ("z", 0, "missing"), ("w", 0, "to rebuild")}
    assert {(r["id"], r["handler"]) for r in c.routed(df, "kind", {"a": "m", "b": "n"}).collect()} == {(1, "m"), (2, "n"), (5, "m")}
    assert {tuple(r) for r in c.payload_errors(df, "id", "props", "k").collect()} == {(2, "malformed"), (3, "malformed"), (4, "incomplete"), (5, "malformed")}
    parts = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    whole = spark.createDataFrame([(1, 2), (2, 2), (3, 0), (4, None)], "id int, n int")
    assert {tuple(r) for r in c.count_mismatches(whole, parts, "id", "n").collect()} == {(2, 2, 1), (4, None, 0)}


def test_relation_lines_and_context(spark):
    nodes = spark.createDataFrame([("a",), ("b/c",), (None,)], "name string")
    rel = spark.createDataFrame([("a", "b/c", "x, y", 2), ("a", "z", None, 1), ("y", "z", None, 1)], "source string, target string, keywords string, weight int")
    assert sorted(map(tuple, g.relation_lines(nodes, rel).collect())) == [("a", "b/c", "- [[b_c]] (x, y; 2)"), ("a", "z", "- z (; 1)"), ("b/c", "a", "- [[a]] (x, y; 2)")]
    lines = lambda *x: spark.createDataFrame(list(x), "q int, line string")
    got = g.graph_context(lines((1, "e2"), (1, "e1"), (1, "e1"), (2, None)), lines((1, "r"), (3, "r")), "q")
    assert {tuple(r) for r in got.collect()} == {(1, "e1\ne2\nr"), (2, None), (3, "r")}


def test_near_variants_against_all_pairs(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcde") for _ in range(n))
    names = [word(rnd.randrange(3, 9)) for _ in range(60)]
    values = [n[:2] + rnd.choice("xyz") + n[3:] for n in names] + [word(6) for _ in range(60)] + ["", "x"]
    vs = spark.createDataFrame([("k", x) for x in values] + [("k", None)], "axis string, value string")
    ns = spark.createDataFrame([(x,) for x in names] + [(None,)], "name string")
    landed = {r["value"] for r in g.landing(vs, ns).where("outcome <> 'miss'").collect()}
    want = {(a, b) for a in set(values) - landed for b in set(names) if len(a) > 1 and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= g.NEAR}
    assert {(r["value"], r["name"]) for r in g.near_variants(vs, ns).collect()} == want
    assert {r["value"] for r in g.landing_with_variants(vs, ns).where("outcome = 'near_variant'").collect()} == {a for a, _ in want}


def test_chunks_and_vectors(spark):
    got = v.token_chunks(texts(spark, "กขค", "", None, "x" * 2300), "id", "text", 1200, 100).orderBy("id", "chunk").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 9), (3, 0, 0, 1200), (3, 1, 1100, 1200)]
    df = texts(spark, "one two", " ", None)
    assert [(r["kind"], r["id"]) for r in v.rebuilt(df, df.limit(0), df).collect()] == [("entity", "0"), ("chunk", "0")]


def test_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.createDataFrame([("a.md", "one\ntwo"), ("b.md", None), (None, "x"), ("c/d.md", "y")], "filename string, content string")
    assert {tuple(r) for r in files.write_files(df, folder).collect()} == {("a.md", 7), ("b.md", 0)}
    assert sorted(os.listdir(folder)) == ["a.md", "b.md"] and (tmp_path / "out" / "a.md").read_text() == "one\ntwo"
    files.overwrite_files(df.limit(1), folder)
    assert sorted(os.listdir(folder)) == ["a.md"]
    files.append_jsonl(df.limit(1), str(tmp_path / "log"))
    files.append_jsonl(df.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    text = df.limit(1).select(files.pretty_json(F.struct("filename", F.lit(None).cast("int").alias("n")))).first()[0]
    assert json.loads(text) == {"filename": "a.md", "n": None} and "\n" in text
    assert files.deleted(df, df.limit(1), ["filename"]).count() == 3
