"""File formats, upserts and streams against their batch forms."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from looseleaf.operators import memory
from looseleaf.operators.change_feed import profile_state
from looseleaf.sources import files
from looseleaf.streaming.profiles import read_profiles, write_profiles
from looseleaf.streaming.sessions import ROCKSDB, closed_sessions

GRAPHML = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="d0" for="node" attr.name="entity_type" attr.type="string"/>
<key id="d1" for="edge" attr.name="weight" attr.type="double"/>
<graph edgedefault="undirected">
<node id="A"><data key="d0">herb</data></node>
<node id="B"/>
<edge source="A" target="B"><data key="d1">2.0</data></edge>
</graph></graphml>"""


def test_formats(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"book_id": "b", "page": 1, "text": "x"}\n\n{"book_id": "b", "page": 1, "text": "y"}\n')
    pages = files.read_pages(spark, str(tmp_path / "p.jsonl")).where("book_id is not null").withColumn("n", F.monotonically_increasing_id())
    assert [tuple(r) for r in files.last_of_page(pages, "n").collect()] == [("b", 1, "y")]
    (tmp_path / "kv.json").write_text(json.dumps({"d1": {"file_path": "f"}, "d2": {"file_path": None}}))
    kv = files.read_keyed(spark, str(tmp_path / "kv.json"), "struct<file_path: string>")
    assert sorted((r["doc_id"], r["value"]["file_path"]) for r in kv.collect()) == [("d1", "f"), ("d2", None)]
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, edges = files.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r["name"]: r["attributes"] for r in nodes.collect()} == {"A": {"entity_type": "herb"}, "B": {}}
    assert [(r["source"], r["target"], r["attributes"]) for r in edges.collect()] == [("A", "B", {"weight": "2.0"})]
    (tmp_path / "books.yaml").write_text("# c\n\nb-1: Title: more\n")
    assert [tuple(r) for r in files.read_books(spark, str(tmp_path / "books.yaml")).collect()] == [("b-1", "Title: more")]
    (tmp_path / "corpus" / "b-1").mkdir(parents=True)
    (tmp_path / "corpus" / "concepts").mkdir()
    (tmp_path / "corpus" / "b-1" / "001-น.1-2.md").write_text("body")
    (tmp_path / "corpus" / "concepts" / "x.md").write_text("no")
    assert [(r["path"].rsplit("/", 1)[1], r["book_id"], r["content"]) for r in files.read_notes(spark, str(tmp_path / "corpus")).collect()] == [("001-น.1-2.md", "b-1", "body")]
    two = spark.createDataFrame([("k", "a\fb\fc")], "k string, t string")
    assert [r["page"] for r in files.split_pages(two, "k", "t", 2).collect()] == [1, 2]
    files.write_files(spark.createDataFrame([("n.md", "one\ntwo")], "filename string, content string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "n.md").read_text() == "one\ntwo"


def test_upsert_and_patch(spark):
    now = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "z")], "k int, v string, w string")
    assert sorted(map(tuple, files.merged(now, new, ["k"]).collect())) == [(1, "a", "x"), (2, "c", None), (3, "d", "z")]
    assert sorted(map(tuple, files.patched(now, new, ["k"]).collect())) == [(1, "a", "x"), (2, "c", "y")]


def test_stream_of_turns_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rnd, day = random.Random(5), dt.datetime(2025, 3, 1)
    rows, hours = [], {"u": 0.0, "v": 0.0}
    for i in range(60):
        u = rnd.choice("uv")
        hours[u] += rnd.choice([0.5, 2, 6, 9])
        rows.append((i, u, rnd.choice(["user", "advisor"]), f"t{i}", day + dt.timedelta(hours=hours[u])))
    df = spark.createDataFrame(rows, "turn_id bigint, user_id string, role string, text string, ts timestamp")
    for k in range(3):
        df.where(f"turn_id div 20 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = closed_sessions(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = q.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    columns = ["user_id", "session_no", "turns", "user_turns", "started", "ended"]
    want = memory.session_summary(df).where("closed").select(*columns)
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_profiles_by_batches_equal_replay(spark, tmp_path):
    ops = spark.createDataFrame(
        [("u", 1, "add", "habits", "", "a"), ("u", 3, "update", "habits", "h2", "c"), ("u", 2, "add", "habits", "", "b"), ("v", 1, "set_sex", None, None, "x"), ("u", 2, "add", "habits", "", "b")],
        "user_id string, seq int, op string, field string, item_id string, text string",
    )
    assert read_profiles(spark, str(tmp_path / "none")) is None
    rows = ops.collect()
    for part in (rows[2:], rows[:2]):
        spark.createDataFrame(part, ops.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_profiles(source, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(str, read_profiles(spark, str(tmp_path / "out")).collect())) == sorted(map(str, profile_state(ops).collect()))
    assert spark.read.parquet(str(tmp_path / "out" / "log")).count() == len(rows)
