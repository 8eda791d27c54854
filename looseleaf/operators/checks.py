"""Checks that return violations, correlations without a key, fallbacks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from looseleaf.functions import text as t
from looseleaf.operators.blocks import ranged, with_running_sum


def outside_domain(df: DataFrame, key: str, column: str, allowed: list[str]) -> DataFrame:
    """(key, value) of values outside a closed set; null is outside."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(*allowed)).select(key, F.col(column).alias("value"))


def marker_violations(notes: DataFrame) -> DataFrame:
    """(note_id, page, problem) of page markers in notes (note_id, page_first, page_last, body).

    A marker stands for a transition, so it must lie after the first page and not after the last, and markers must ascend.
    """
    found = F.posexplode(F.regexp_extract_all("body", F.lit(r"<!-- p\.([0-9]+) -->"), 1)).alias("nth", "p")
    x = notes.select("note_id", "page_first", "page_last", found).withColumn("page", F.col("p").try_cast("int"))
    before = F.lag("page").over(Window.partitionBy("note_id").orderBy("nth"))
    outside = F.when((F.col("page") <= F.col("page_first")) | (F.col("page") > F.col("page_last")), F.lit("outside"))
    problems = F.filter(F.array(outside, F.when(F.col("before") >= F.col("page"), F.lit("order"))), lambda p: p.isNotNull())
    return x.withColumn("before", before).select("note_id", "page", F.explode(problems).alias("problem"))


def heading_lines(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, level, title) of the first Markdown heading of a text, if it has one."""
    first = F.regexp_extract(column, r"(?m)^(#{1,6})[ \t]+([^\n]*)$", 1)
    return texts.select(key, F.length(first).alias("level"), F.trim(F.regexp_extract(column, r"(?m)^(#{1,6})[ \t]+([^\n]*)$", 2)).alias("title")).where("level > 0")


def within_intervals(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, keep_points: list[str], keep_intervals: list[str]) -> DataFrame:
    """Points within intervals of their key, ends included.

    Both sides are cut by day, so the join is on (key, day) with a condition on top, and a key of any size is spread over
    its days; an interval is copied to each day it covers.
    """
    day = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(86_400_000_000))
    i = intervals.select(key, start, end, *keep_intervals, F.explode(F.sequence(day(start), day(end))).alias("_day"))
    p = points.where(F.col(at).isNotNull()).select(key, at, *keep_points, day(at).alias("_day"))
    return p.join(i, [key, "_day"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).select(key, *keep_points, *keep_intervals)


def zipped(a: DataFrame, b: DataFrame, group: str, order_a: list[str], order_b: list[str], keep_a: list[str], keep_b: list[str], strict: bool = False) -> DataFrame:
    """Rows of two sides side by side by their number within the group; the longer side meets nulls, or fails if strict."""

    def numbered(df: DataFrame, order: list[str], keep: list[str]) -> DataFrame:  # a group of any size in blocks of its order
        own = df.where(F.col(group).isNotNull()).select(group, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), *keep)
        keys = [f"_o{i}" for i in range(len(order))]
        return with_running_sum(ranged(own, [group], keys), [group], keys, F.lit(1), F.col("_range"), "nth").select(group, *keep, F.col("nth").cast("int").alias("nth"))

    x, y = numbered(a, order_a, keep_a), numbered(b, order_b, keep_b)
    if strict:
        x, y = x.withColumn("_x", F.lit(True)), y.withColumn("_y", F.lit(True))
        both = x.join(y, [group, "nth"], "full_outer")
        wrong = F.col("_x").isNull() | F.col("_y").isNull()
        return both.withColumn("nth", F.when(wrong, F.raise_error(F.concat(F.lit("sides differ in number in "), F.col(group))).cast("int")).otherwise(F.col("nth"))).drop("_x", "_y")
    return x.join(y, [group, "nth"], "full_outer")


def first_choice(modes: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first of several results that has any for a key."""
    out = None
    for n, df in enumerate(modes):
        fresh = df if out is None else df.join(out.select(key).distinct(), key, "left_anti")
        fresh = fresh.withColumn("mode", F.lit(n))
        out = fresh if out is None else out.unionByName(fresh)
    return out


def flattened(blocks: Column) -> Column:
    """Texts of the blocks (type, text) of type text, one after the other."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def link(base: Column, kind: str, key: Column) -> Column:
    """base/kind/key with one slash between; null without a base."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit(f"/{kind}/"), key)


def keyed_json(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(group, json): an object of the group's keys in order, the same for the same rows."""
    pairs = F.array_sort(F.collect_set(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return rows.where(F.col(key).isNotNull()).groupBy(group).agg(F.to_json(F.map_from_entries(pairs)).alias("json"))


def rate_report(rates: DataFrame) -> DataFrame:
    """(axis, line): a line of a report for each axis, with a bar."""
    shown = F.format_string("%-10s %5.1f%% ", "axis", F.col("rate") * 100)
    return rates.select("axis", F.concat(shown, t.bar(F.col("rate"))).alias("line"))


def markdown_table(lines: DataFrame) -> DataFrame:
    """(key, table): lines (key, k, line) that begin with a pipe as one table, the header and its rule once."""
    rows = lines.where(F.col("line").startswith("|")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("ls"))
    text = F.transform("ls", lambda x: x["line"])
    return rows.select("key", F.array_join(F.concat(F.slice(text, 1, 2), F.filter(F.slice(text, 3, F.size(text)), lambda x: ~x.isin(F.get(text, F.lit(0)), F.get(text, F.lit(1))))), "\n").alias("table"))


def summary(checks: dict[str, DataFrame]) -> DataFrame:
    """(name, violations, status): how many rows each check gave."""
    out = None
    for name, df in checks.items():
        one = df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("name"), "violations", F.when(F.col("violations") == 0, "ok").otherwise("fail").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def store_check(stores: dict[str, tuple[str, DataFrame | None]]) -> DataFrame:
    """(store, kind, rows, status) of stores given as name: (authoritative or derived, table or None): ok, empty or missing.

    A missing authoritative store is an error, a missing derived one can be rebuilt.
    """
    out = None
    for name, (kind, df) in stores.items():
        if df is None:
            continue
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("store"), F.lit(kind).alias("kind"), "rows", F.when(F.col("rows") > 0, "ok").otherwise("empty").alias("status"))
        out = one if out is None else out.unionByName(one)
    gone = [(n, k, 0, "missing" if k == "authoritative" else "to rebuild") for n, (k, df) in stores.items() if df is None]
    if not gone:
        return out
    missing = SparkSession.active().createDataFrame(gone, "store string, kind string, rows bigint, status string")
    return missing if out is None else out.unionByName(missing)


def routed(events: DataFrame, kind: str, handlers: dict[str, str]) -> DataFrame:
    """events with the handler of their kind; kinds without one, and null, are left out. Works on tables and streams."""
    to = F.element_at(F.create_map(*(F.lit(x) for kv in handlers.items() for x in kv)), F.col(kind))
    return events.withColumn("handler", to).where("handler is not null")


def payload_errors(events: DataFrame, key: str, payload: str, field: str) -> DataFrame:
    """(key, problem): payloads that aren't an object (malformed), and objects without the field (incomplete)."""
    fields = F.json_object_keys(payload)
    problem = F.when(F.col(payload).isNull() | fields.isNull(), "malformed").when(~F.array_contains(fields, field), "incomplete")
    return events.select(key, problem.alias("problem")).where("problem is not null")


def count_mismatches(whole: DataFrame, parts: DataFrame, key: str, expected: str) -> DataFrame:
    """(key, expected, found): keys whose number of parts (key) isn't the one they state."""
    n = parts.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    x = whole.select(key, F.col(expected).cast("bigint").alias("expected")).join(n, key, "left").fillna(0, ["found"])
    return x.where("expected is distinct from found")


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df with place, its number in the order over all rows, without one task that sees them all."""
    x = ranged(df.withColumn("_all", F.lit(0)), [], order)
    return with_running_sum(x, ["_all"], order, F.lit(1), F.col("_range"), "place").drop("_all", "_range")
