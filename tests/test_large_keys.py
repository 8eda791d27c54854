"""Queries over tables whose keys go beyond 32 bits."""

import shutil

import pytest
from oracle import duck, spark_rows
from pyspark.sql import functions as F

from looseleaf.plans import graph

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """Notes twice, the second time under ids that begin where 32 bits end."""
    d = str(tmp_path_factory.mktemp("shifted"))
    shutil.copy(f"{FOLDER}/consultation_turns.parquet", d)
    notes = spark.read.parquet(f"{FOLDER}/source_notes.parquet")
    notes.unionByName(notes.withColumn("note_id", F.col("note_id") + 2**31)).write.parquet(f"{d}/source_notes.parquet")
    return d


def test_citations_of_large_ids(spark, shifted):
    got = spark_rows(graph.QUERIES["citations"](spark, shifted))
    assert got[1] and got == duck(shifted, graph.SQL["citations"])


def test_invented_ids_among_large_ids(spark, shifted):
    df = graph.QUERIES["invented_ids"](spark, shifted)
    got = spark_rows(df)
    assert got[1] and got == duck(shifted, graph.SQL["invented_ids"])
    assert dict(df.dtypes) == {"id": "int", "reply_id": "bigint"}
