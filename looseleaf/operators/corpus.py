"""Corpus notes: rendering, parsing, fingerprints, and checks that return their violations as rows."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from looseleaf.functions import text as t
from looseleaf.operators.blocks import ranged, with_max_before, with_next, with_previous

#: Fixed values of the note format: required fields, least body, and the file names and comments below.
REQUIRED = ["uid", "type", "book_id", "chapter", "section", "pages", "pdf_pages"]
SHORT_BODY = 200


def ordinal(uid: Column) -> Column:
    """The number at the end of a uid, as text with its zeros."""
    return F.regexp_extract(uid, r"-([0-9]+)$", 1)


def render_note(notes: DataFrame) -> DataFrame:
    """notes with content: frontmatter of the fields that aren't null, and the body."""
    pair = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat(F.lit("["), F.col(a).cast("string"), F.lit(", "), F.col(b).cast("string"), F.lit("]")))
    shown = [("uid", F.col("uid")), ("type", F.col("note_type")), ("book_id", F.col("book_id")), ("chapter", F.col("chapter")), ("section", F.col("section")), ("pages", pair("page_first", "page_last")), ("pdf_pages", pair("pdf_first", "pdf_last"))]
    head = F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), v) for k, v in shown))
    return notes.withColumn("content", F.concat(F.lit("---\n"), head, F.lit("\n---\n"), F.col("body")))


def parse_note(files: DataFrame) -> DataFrame:
    """(path, fields, body) of files (path, content): fields is a map, null for a missing or unterminated frontmatter."""
    block = F.regexp_extract("content", r"(?s)^---\n(.*?)\n?---\n", 1)
    has = F.col("content").rlike(r"(?s)^---\n.*?\n?---\n")
    pairs = F.transform(F.filter(F.split(block, "\n"), lambda x: x.contains(":")), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    fields = F.map_from_entries(F.array_distinct(pairs))
    return files.select("path", F.when(has, fields).alias("fields"), F.when(has, F.regexp_replace("content", r"(?s)^---\n.*?\n?---\n", "")).otherwise(F.col("content")).alias("body"))


def missing_fields(parsed: DataFrame) -> DataFrame:
    """(path, field) for required fields that a note lacks; `frontmatter` if it has none."""
    lacking = F.filter(F.array(*map(F.lit, REQUIRED)), lambda f: ~F.coalesce(F.array_contains(F.map_keys("fields"), f), F.lit(False)))
    return parsed.select("path", F.explode(F.when(F.col("fields").isNull(), F.array(F.lit("frontmatter"))).otherwise(lacking)).alias("field"))


def filename(notes: DataFrame) -> Column:
    """Name that a note should have: its ordinal, section and pages."""
    return F.concat(ordinal(F.col("uid")), F.lit("-"), F.col("section"), F.lit("-น."), F.col("page_first").cast("string"), F.lit("-"), F.col("page_last").cast("string"), F.lit(".md"))


def filename_errors(notes: DataFrame) -> DataFrame:
    """(note_id, problem): file names that lack the pattern, or disagree with section or pages."""
    name = t.basename(F.col("path"))
    pattern = r"^([0-9]{2,3})-(.*)-น\.([0-9]+)-([0-9]+)\.md$"
    fits = name.rlike(pattern)
    pages = F.concat_ws("-", F.regexp_extract(name, pattern, 3), F.regexp_extract(name, pattern, 4))
    problem = F.when(~fits, F.array(F.lit("pattern"))).otherwise(
        F.filter(
            F.array(F.when(F.regexp_extract(name, pattern, 2) != F.col("section"), F.lit("section")), F.when(pages != F.concat_ws("-", F.col("page_first").cast("string"), F.col("page_last").cast("string")), F.lit("pages"))),
            lambda p: p.isNotNull(),
        )
    )
    return notes.select("note_id", F.explode(problem).alias("problem"))


def duplicate_keys(df: DataFrame, key: str, order: str) -> DataFrame:
    """(order, key, first): second and later rows of a key, with the row that holds it first. Works on keys of any size."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return df.join(first, key).where(F.col(order) > F.col("first")).select(order, key, "first")


def backward_ranges(notes: DataFrame) -> DataFrame:
    return notes.where("page_first > page_last or pdf_first > pdf_last").select("note_id")


def short_bodies(notes: DataFrame, least: int = SHORT_BODY) -> DataFrame:
    n = F.length(F.trim(F.regexp_replace("body", r"(?s)<!--.*?-->", "")))
    return notes.select("note_id", n.alias("chars")).where(F.col("chars") < least)


def mixed_widths(notes: DataFrame) -> DataFrame:
    """(book_id, widths) of books whose ordinals differ in width."""
    return notes.groupBy("book_id").agg(F.countDistinct(F.length(ordinal(F.col("uid")))).alias("widths")).where("widths > 1")


def order_violations(notes: DataFrame) -> DataFrame:
    """(note_id, problem): within a book by path, ordinals that don't rise and first pages that fall. Books are worked on in blocks."""
    n = ordinal(F.col("uid")).try_cast("int")
    x = ranged(notes.where("note_id is not null").select("note_id", "book_id", "path", F.struct(n.alias("n"), "page_first").alias("own")), ["book_id"], ["path", "note_id"])
    x = with_previous(x.withColumn("book_id", F.coalesce("book_id", F.lit(""))), ["book_id"], ["path", "note_id"], "own", F.col("_range"), "before")
    falls = F.when(F.col("own.n") <= F.col("before.n"), F.lit("ordinal")), F.when(F.col("own.page_first") < F.col("before.page_first"), F.lit("page"))
    return x.select("note_id", F.explode(F.filter(F.array(*falls), lambda p: p.isNotNull())).alias("problem"))


def coverage_gaps(notes: DataFrame) -> DataFrame:
    """(book_id, gap_from, gap_to): runs of pages between the first and last of a book that no note covers."""
    x = ranged(notes.where("book_id is not null").select("book_id", "page_first", "page_last").distinct(), ["book_id"], ["page_first", "page_last"])
    x = with_max_before(x, ["book_id"], ["page_first", "page_last"], F.col("page_last"), F.col("_range"), "reached")
    return x.where("page_first > reached + 1").select("book_id", (F.col("reached") + 1).alias("gap_from"), (F.col("page_first") - 1).alias("gap_to"))


def section_spans(notes: DataFrame) -> DataFrame:
    """(note_id, next_id, next_page): the section that follows in the book and the page it starts on."""
    x = ranged(notes.select("note_id", F.coalesce("book_id", F.lit("")).alias("book_id"), "page_first", "uid", F.struct("note_id", "page_first").alias("own")), ["book_id"], ["page_first", "uid", "note_id"])
    x = with_next(x, ["book_id"], ["page_first", "uid", "note_id"], "own", F.col("_range"), "after")
    return x.select("note_id", F.col("after.note_id").alias("next_id"), F.col("after.page_first").alias("next_page"))


def fingerprints(notes: DataFrame) -> DataFrame:
    """(uid, sha256) of rendered notes; of notes exported twice the last row counts."""
    return render_note(notes).groupBy("uid").agg(F.max_by(F.sha2("content", 256), "note_id").alias("sha256"))


def manifest_drift(committed: DataFrame, current: DataFrame) -> DataFrame:
    """(uid, status): new, removed or changed of current against committed fingerprints (uid, sha256)."""
    a, b = committed.select("uid", F.col("sha256").alias("old"), F.lit(True).alias("had")), current.select("uid", F.col("sha256").alias("now"), F.lit(True).alias("has"))
    x = a.join(b, "uid", "full_outer")
    status = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("now")), "changed")
    return x.select("uid", status.alias("status")).where("status is not null")


def with_page_markers(lines: DataFrame) -> DataFrame:
    """(book_id, page, content) from paragraphs (book_id, page, paragraph, record_id, text): a marker on pages after the first."""
    first = lines.where("text is not null").groupBy("book_id").agg(F.min("page").alias("first"))
    body = lines.where("text is not null").groupBy("book_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "record_id", "text"))), lambda p: p["text"]), "\n\n").alias("body"))
    marker = F.when(F.col("page") > F.col("first"), F.concat(F.lit("<!-- p."), F.col("page").cast("string"), F.lit(" -->\n"))).otherwise("")
    return body.join(first, "book_id").select("book_id", "page", F.concat(marker, F.col("body")).alias("content"))


def comment_kinds(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, nth, kind) of the HTML comments of a text: page, sic, malformed sic or unknown."""
    found = F.posexplode(F.regexp_extract_all(column, F.lit(r"(?s)<!--(.*?)-->"), 1))
    c = F.col("c")
    kind = F.when(c.rlike(r"^ p\.[0-9]+ $"), "page").when(c.rlike(r"^ sic: .+ $"), "sic").when(F.ltrim(c).startswith("sic:"), "malformed sic").otherwise("unknown")
    return texts.select(key, found.alias("nth", "c")).select(key, (F.col("nth") + 1).alias("nth"), kind.alias("kind"))


def sequence_headings(headings: DataFrame) -> DataFrame:
    """Headings (key, pos, major, minor) that continue the numbering 1.1, 1.2, ..., 2.1; others are sub-items.

    A heading counts if it goes on from the last one that counted, so this is a fold in order, one array for each key (a
    book's headings).
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "major", "minor")))
    start = F.struct(F.lit(0).alias("major"), F.lit(0).alias("minor"), F.array().cast("array<struct<pos: bigint, major: int, minor: int>>").alias("kept"))

    def step(a: Column, h: Column) -> Column:
        goes_on = ((h["major"] == a["major"]) & (h["minor"] == a["minor"] + 1) & (a["major"] > 0)) | ((h["major"] == a["major"] + 1) & (h["minor"] == 1))
        kept = F.concat(a["kept"], F.array(F.struct(h["pos"].cast("bigint").alias("pos"), h["major"].alias("major"), h["minor"].alias("minor"))))
        return F.when(goes_on, F.struct(h["major"].alias("major"), h["minor"].alias("minor"), kept.alias("kept"))).otherwise(a)

    folded = headings.groupBy("key").agg(ordered.alias("hs")).select("key", F.aggregate("hs", start, step)["kept"].alias("kept"))
    return folded.select("key", F.explode("kept").alias("h")).select("key", "h.pos", "h.major", "h.minor")


def table_runs(lines: DataFrame) -> DataFrame:
    """(key, start, rows, separated, widths) of runs of lines that begin with a pipe; lines: (key, k, line)."""
    w = Window.partitionBy("key").orderBy("k")
    piped = lines.where(F.col("line").startswith("|")).withColumn("run", F.col("k") - F.row_number().over(w))
    bare = F.regexp_replace(F.trim("line"), r"^\|+|\|+$", "")
    cells = F.split(bare, r"\|")
    rule = F.forall(cells, lambda c: F.trim(c).rlike("^:?-{3,}:?$"))
    x = piped.withColumn("rule", rule).withColumn("width", F.size(cells))
    runs = x.groupBy("key", "run").agg(F.min("k").alias("start"), F.count(F.lit(1)).alias("rows"), F.min(F.when(F.col("rule"), F.col("k"))).alias("at"), F.countDistinct(F.when(~F.col("rule"), F.col("width"))).alias("widths"))
    return runs.select("key", "start", "rows", F.coalesce(F.col("at") == F.col("start") + 1, F.lit(False)).alias("separated"), "widths")


def books_coverage(notes: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, missing): books that only notes or only pages have."""
    a, b = notes.select("book_id").distinct(), pages.select("book_id").distinct()
    return a.join(b, "book_id", "left_anti").withColumn("missing", F.lit("pages")).unionByName(b.join(a, "book_id", "left_anti").withColumn("missing", F.lit("notes")))


def parent_errors(notes: DataFrame, books: DataFrame) -> DataFrame:
    """(note_id, problem): book ids that aren't the folder of the note, and book ids that no book has."""
    own = notes.select("note_id", "book_id", F.element_at(F.split("path", "/"), -2).alias("parent"))
    folder = own.where("book_id is distinct from parent").select("note_id", F.lit("folder").alias("problem"))
    return folder.unionByName(own.join(books.select("book_id").distinct(), "book_id", "left_anti").select("note_id", F.lit("book").alias("problem")))


def heading_parse(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line, major, minor, title) of the lines of a text that are numbered headings, `N.M title`."""
    pattern = r"^([0-9]{1,4})\.([0-9]{1,6})[ \t]+(\S.*?)\s*$"
    x = texts.select(key, F.posexplode(t.lines(F.col(column))).alias("line", "l")).where(F.col("l").rlike(pattern))
    part = lambda i: F.regexp_extract("l", pattern, i)
    return x.select(key, "line", part(1).cast("int").alias("major"), part(2).cast("int").alias("minor"), part(3).alias("title"))


def index_entries(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, group, group_title, nth, token): the tokens of an index, whose lines are `N title` for a group and `N.M a, b; c` below it.

    Blanks within a token collapse; empty tokens and lines of another kind are left out.
    """
    lines = texts.select(key, F.explode(t.lines(F.col(column))).alias("l"))
    groups = lines.where(F.col("l").rlike(r"^[0-9]+[ \t]+\S")).select(key, F.regexp_extract("l", r"^([0-9]+)", 1).cast("int").alias("group"), F.trim(F.regexp_replace(F.regexp_extract("l", r"^[0-9]+[ \t]+(.*)$", 1), r"\s+", " ")).alias("group_title"))
    entries = lines.where(F.col("l").rlike(r"^[0-9]+\.[0-9]+[ \t]"))
    tokens = F.filter(F.transform(F.split(F.regexp_extract("l", r"^[0-9]+\.[0-9]+[ \t]+(.*)$", 1), "[,;]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    split = entries.select(key, F.regexp_extract("l", r"^([0-9]+)\.", 1).cast("int").alias("group"), F.regexp_extract("l", r"^[0-9]+\.([0-9]+)", 1).cast("int").alias("nth"), F.explode(tokens).alias("token"))
    return split.join(groups, [key, "group"], "left").select(key, "group", "group_title", "nth", "token")


def line_above(texts: DataFrame, key: str, column: str, wanted: str) -> DataFrame:
    """(key, line, above): of each line that matches wanted the nearest line above that isn't blank, null if there is none."""
    ls = t.lines(F.col(column))
    x = texts.select(key, F.transform(ls, lambda l, i: F.struct(i.alias("line"), l.alias("l"))).alias("ls")).select(key, F.filter("ls", lambda l: F.trim(l["l"]) != "").alias("ls"))
    near = F.transform(F.col("ls"), lambda l, i: F.struct(l["line"].alias("line"), l["l"].alias("l"), F.get(F.col("ls"), i - 1)["l"].alias("above")))
    return x.select(key, F.explode(near).alias("x")).select(key, "x.*").where(F.col("l").rlike(wanted)).select(key, "line", "above")


def table_captions(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, line, caption) of the first line of each table: the bold line right above it but for blank lines, null if there is none."""
    rows = line_above(texts, key, column, r"^\|").where("above is null or not startswith(above, '|')")
    caption = F.regexp_extract("above", r"^\*\*(.+)\*\*$", 1)
    return rows.select(key, "line", F.when(caption != "", caption).alias("caption"))


def strip_furniture(text: Column, titles: Column) -> Column:
    """The text without lines that are a page number between dashes or alone, and without title and blank lines at its end."""
    number = r"(?md)^[ \t]*(?:[-–—][ \t]*)?[0-9๐-๙]{1,4}(?:[ \t]*[-–—])?[ \t]*\r?$\n?"
    ls = t.lines(F.regexp_replace(text, number, ""))
    gone = lambda l: (F.trim(F.regexp_replace(l, r"\s+", " ")) == "") | F.coalesce(F.array_contains(titles, F.trim(l)), F.lit(False))
    last = F.aggregate(F.transform(ls, lambda l, i: F.when(gone(l), -1).otherwise(i)), F.lit(-1), lambda a, i: F.greatest(a, i))
    return F.array_join(F.slice(ls, 1, last + 1), "\n")


def composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def names_not_composed(notes: DataFrame) -> DataFrame:
    """(note_id, name) of file names that aren't in composed form; names in plain repertoire are answered without Python."""
    name = t.basename(F.col("path"))
    x = notes.select("note_id", name.alias("name")).where(name.rlike("[^ -~\u0e00-\u0e7f]|\u0e4d\u0e32"))
    return x.where(F.pandas_udf(composed, "string")("name") != F.col("name"))
