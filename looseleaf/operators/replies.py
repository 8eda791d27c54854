"""Replies: cited ids, citation lines and topic menus, and citations resolved to titles and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The line that holds a citation, the line that opens a menu, and the caps on both.
CITATION = r"^\(อ้างอิง:\s*(.+?)\s*\)$"
MENU = "[หัวข้อ]"
TOPICS, TOPIC_CHARS, BOOKS = 5, 20, 3
#: Fixed value: marks before the items of a menu.
ITEM_MARK = r"^(?:[-•*]|\d+[.)])\s*"


def cited_ids(reply: Column) -> Column:
    """Distinct bracketed numbers in ascending order; numbers beyond 32 bits are no ids."""
    ids = F.transform(F.regexp_extract_all(reply, F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _last(lines: Column, test) -> Column:
    """Place from 0 of the last line that passes; null if none does."""
    return F.array_max(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: test(F.get(lines, i))))


def split_citation(text: Column) -> Column:
    """struct(body, citation): a citation on the last line that isn't blank is cut off, unless nothing would be left."""
    ls = _lines(text)
    at = _last(ls, lambda x: F.trim(x) != "")
    line = F.trim(F.get(ls, at))
    body = F.regexp_replace(F.array_join(F.slice(ls, F.lit(1), F.greatest(at, F.lit(0))), "\n"), r"^\s+|\s+$", "")
    good = F.coalesce(line.rlike(CITATION) & (body != ""), F.lit(False))
    return F.when(good, F.struct(body.alias("body"), F.regexp_extract(line, CITATION, 1).alias("citation"))).otherwise(F.struct(text.alias("body"), F.lit(None).cast("string").alias("citation")))


def topic_menu(text: Column) -> Column:
    """struct(visible, topics): the menu after the last marker line, unless no visible text would be left."""
    ls = _lines(text)
    at = _last(ls, lambda x: F.regexp_replace(F.trim(x), ":+$", "") == MENU)
    visible = F.regexp_replace(F.array_join(F.slice(ls, F.lit(1), F.greatest(F.coalesce(at, F.lit(0)), F.lit(0))), "\n"), r"^\s+|\s+$", "")
    after = F.filter(F.slice(ls, F.coalesce(at, F.lit(0)) + 2, F.size(ls)), lambda x: ~F.trim(x).rlike(CITATION))
    items = F.filter(F.transform(after, lambda x: F.trim(F.regexp_replace(F.trim(x), ITEM_MARK, ""))), lambda x: x != "")
    topics = F.slice(F.transform(items, lambda x: F.substring(x, 1, TOPIC_CHARS)), 1, TOPICS)
    good = at.isNotNull() & (visible != "")
    return F.when(good, F.struct(visible.alias("visible"), topics.alias("topics"))).otherwise(F.struct(text.alias("visible"), F.array().cast("array<string>").alias("topics")))


def invented(cited: DataFrame, passages: DataFrame) -> DataFrame:
    """(id, reply_id), each pair once: cited ids without a passage; none, as with NOT IN, if a passage has no id.

    cited: (reply_id, id); passages: (id, ...).
    """
    ids = passages.select("id")
    unknown = ids.where("id is null").select(F.lit(True).alias("unknown")).limit(1)
    return cited.join(ids, "id", "left_anti").distinct().join(unknown, F.lit(True), "left_anti")


def resolve(cited: DataFrame, passages: DataFrame, books: DataFrame) -> DataFrame:
    """(reply_id, citation): titles with page ranges, grouped by book in order of the first cited id, BOOKS at most.

    cited: (reply_id, id); passages: (id, book_id, first, last); books: (book_id, title). Ids without a passage are
    invented and dropped; a book without a title shows its id.
    """
    x = cited.distinct().join(passages, "id").join(books, "book_id", "left").withColumn("title", F.coalesce("title", "book_id"))
    pages = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    by = x.groupBy("reply_id", "title").agg(F.min("id").alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", pages.alias("p")))), lambda p: p["p"]), ", ").alias("ps"))
    top = by.withColumn("nth", F.row_number().over(Window.partitionBy("reply_id").orderBy("at", "title"))).where(F.col("nth") <= BOOKS)
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat("title", F.lit(" p. "), "ps").alias("s")))), lambda s: s["s"]), "; ")
    return top.groupBy("reply_id").agg(shown.alias("citation"))
