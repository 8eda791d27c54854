"""Readers and writers of the file formats that corpora come in: JSON lines, keyed JSON, GraphML, notes, book lists."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from looseleaf.session import checkpointed

PAGES = "book_id string, book_title string, page int, pdf_page int, paragraph int, text string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records of JSON lines; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(PAGES).option("mode", "FAILFAST").json(path)


def last_of_page(pages: DataFrame, order: str) -> DataFrame:
    """(book_id, page, text): of a page that comes twice the row with the greatest order."""
    return pages.groupBy("book_id", "page").agg(F.max_by("text", order).alias("text"))


def split_pages(texts: DataFrame, key: str, column: str, most: int | None = None) -> DataFrame:
    """(key, page, text) of texts with a form feed between pages; pages count from 1."""
    x = texts.select(key, F.posexplode(F.split(column, "\f")).alias("at", "text")).select(key, (F.col("at") + 1).alias("page"), "text")
    return x if most is None else x.where(F.col("page") <= most)


def read_keyed(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(doc_id, value) rows of JSON files that are one object keyed by id; value is the type of what a key holds."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", T._parse_datatype_string(f"map<string, {value}>"))).alias("doc_id", "value")
    return whole.select(entries)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, attributes) and edges (source, target, attributes); attributes are maps by the names of their keys."""
    data = "data array<struct<_VALUE: string, _key: string>>"
    keys = spark.read.format("xml").option("rowTag", "key").schema("_id string, `_attr.name` string, _for string").load(path).select("_id", F.col("`_attr.name`").alias("named"))
    names = F.map_from_entries(F.collect_list(F.struct("_id", "named")))

    def rows(tag: str, own: str) -> DataFrame:
        x = spark.read.format("xml").option("rowTag", tag).schema(f"{own}, {data}").load(path)
        known = keys.agg(names.alias("names"))  # the declared keys of a file, a handful
        return x.join(F.broadcast(known)).withColumn("attributes", F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_VALUE: string, _key: string>>")), lambda d: F.struct(F.element_at("names", d["_key"]), d["_VALUE"]))))

    nodes = rows("node", "_id string").select(F.col("_id").alias("name"), "attributes")
    edges = rows("edge", "_source string, _target string").select(F.col("_source").alias("source"), F.col("_target").alias("target"), "attributes")
    return nodes, edges


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, book_id, content) of Markdown files under folders of books; hidden, archive and concept folders are left out."""
    x = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("path"), F.col("value").alias("content"))
    book = F.element_at(F.split("path", "/"), -2)
    return x.withColumn("book_id", book).where(~book.startswith(".") & ~book.isin("archive", "concepts"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, title) of lines `book_id: title`; blank lines and comments are skipped."""
    x = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    return x.select(F.trim(F.substring_index("line", ":", 1)).alias("book_id"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("title"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, nulls left out, replacing what is there."""
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows, one object a line; what is there stays."""
    df.write.mode("append").json(path)


def pretty_json(value: Column) -> Column:
    """A struct, map or array as JSON on indented lines, the same text for the same value."""
    return F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})


def write_files(df: DataFrame, folder: str, name: str = "filename", content: str = "content") -> DataFrame:
    """One file for each row, named by the row, in a folder that all executors share; (name, bytes) of what was written.

    A file is written beside its place and moved there, so a task that runs again replaces it whole. Rows without a name
    are left out, a null content is an empty file; names can't hold a slash.
    """

    def write(batches):
        for batch in batches:
            done = []
            for file, text in zip(batch["file"], batch["text"]):
                data = (text or "").encode("utf-8")
                beside = os.path.join(folder, f".{file}.{uuid.uuid4().hex}")
                with open(beside, "wb") as out:
                    out.write(data)
                os.replace(beside, os.path.join(folder, file))
                done.append((file, len(data)))
            yield pd.DataFrame(done, columns=["file", "bytes"])

    os.makedirs(folder, exist_ok=True)
    rows = df.select(F.col(name).alias("file"), F.col(content).alias("text")).where("file is not null and not contains(file, '/')")
    written = rows.mapInPandas(write, "file string, bytes bigint")
    return checkpointed(written)  # written once


def overwrite_files(df: DataFrame, folder: str, name: str = "filename", content: str = "content") -> DataFrame:
    """write_files that also removes the files of the folder that no row names."""
    before = {f for f in (os.listdir(folder) if os.path.isdir(folder) else []) if not f.startswith(".")}
    written = write_files(df, folder, name, content)
    old = df.sparkSession.createDataFrame([(f,) for f in before], "file string")
    for (f,) in old.join(written, "file", "left_anti").toLocalIterator():
        os.remove(os.path.join(folder, f))
    return written


def deleted(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of current whose keys aren't in gone."""
    return current.join(gone.select(*keys), keys, "left_anti")


def merged(current: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of the patch replace those of their key, whole; other rows stay. The patch holds a key once."""
    return current.join(patch.select(*keys), keys, "left_anti").unionByName(patch)


def patched(current: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """Field patch: values of the patch that aren't null win; rows without a patch stay, patches without a row are dropped."""
    fields = [c for c in patch.columns if c not in keys]
    renamed = patch.select(*keys, *(F.col(c).alias(f"_{c}") for c in fields))
    x = current.join(renamed, keys, "left")
    return x.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in current.columns))
