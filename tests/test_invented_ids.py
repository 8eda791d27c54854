"""Invented ids where turns come twice and where a note lacks its id."""

import shutil

import pytest
from oracle import duck, spark_rows
from pyspark.sql import functions as F

from looseleaf.plans import graph

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Every turn twice under one id, the second time with another citation too."""
    d = str(tmp_path_factory.mktemp("repeated"))
    shutil.copy(f"{FOLDER}/source_notes.parquet", d)
    turns = spark.read.parquet(f"{FOLDER}/consultation_turns.parquet")
    turns.unionByName(turns.withColumn("text", F.concat("text", F.lit(" [9876]")))).write.parquet(f"{d}/consultation_turns.parquet")
    return d


@pytest.fixture(scope="module")
def unnumbered(spark, tmp_path_factory):
    """One note without an id."""
    d = str(tmp_path_factory.mktemp("unnumbered"))
    shutil.copy(f"{FOLDER}/consultation_turns.parquet", d)
    notes = spark.read.parquet(f"{FOLDER}/source_notes.parquet")
    notes.withColumn("note_id", F.when(F.col("note_id") != 3, F.col("note_id"))).write.parquet(f"{d}/source_notes.parquet")
    return d


def test_invented_ids_of_repeated_turns(spark, repeated):
    got = spark_rows(graph.QUERIES["invented_ids"](spark, repeated))
    assert got[1] and got == duck(repeated, graph.SQL["invented_ids"])


def test_invented_ids_beside_a_note_without_id(spark, unnumbered):
    df = graph.QUERIES["invented_ids"](spark, unnumbered)
    assert spark_rows(df) == duck(unnumbered, graph.SQL["invented_ids"])
    assert dict(df.dtypes) == {"id": "int", "reply_id": "bigint"}
