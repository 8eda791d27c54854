"""Applying a feed of inserts, updates and deletes by a commutative fold.

The state of a key is the maximum of struct(sequence, operation, payload) over its operations and base rows, so repeated
and out-of-order deliveries can be folded in any order, partially before the shuffle. A delete stays in the state as a
tombstone, so a change that comes late can't bring a key back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The list fields of a profile and the letter that starts the ids of their items.
ID_PREFIXES = {"chronic_conditions": "c", "allergies": "a", "medications": "m", "habits": "h", "ongoing_complaints": "o"}
#: Operations that set one value, and the value they set.
SINGLE_VALUES = {"set_sex": "sex", "set_birth_date": "birth_date", "set_notes": "notes"}


def fold_feed(feed: DataFrame, keys: list[str], seq: str, op: str, payload: list[str], base: DataFrame | None = None, deletes: tuple[str, ...] = ("delete", "remove")) -> DataFrame:
    """Current state (keys, seq, op, payload, live) of a change feed, tombstones included with live = false.

    base has the same columns (op null) and takes part as operations of its own sequence; the result may serve as a later base.
    Of operations with one key and one sequence the greatest (op, payload) counts, whatever the order. Rows with a null
    sequence can't be ordered and are left out; null keys form a key. Empty tables give no rows.
    """
    columns = [*keys, seq, op, *payload]
    rows = feed.select(*columns)
    if base is not None:
        rows = rows.unionByName(base.select(*columns))
    return (
        rows.where(F.col(seq).isNotNull())
        .groupBy(*keys)
        .agg(F.max(F.struct(seq, op, *payload)).alias("_last"))
        .select(*keys, *(F.col("_last")[c].alias(c) for c in (seq, op, *payload)))
        .withColumn("live", ~F.coalesce(F.col(op), F.lit("")).isin(*deletes))
    )


def deliver_once(ops: DataFrame) -> DataFrame:
    """(user_id, seq, op, field, item_id, text): each (user_id, seq) once, nulls as empty text; rows without either key are left out."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return (
        ops.where("user_id is not null and seq is not null")
        .select("user_id", "seq", *(text(c) for c in ("op", "field", "item_id", "text")))
        .groupBy("user_id", "seq")
        .agg(F.max(F.struct("op", "field", "item_id", "text")).alias("o"))
        .select("user_id", "seq", "o.*")
    )


def _valid_date(text: Column) -> Column:
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & (F.substring(text, 1, 4) != "0000") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def _numbered_adds(adds: DataFrame, block: int) -> DataFrame:
    """Adds with n, their number within (user_id, field) by sequence.

    Two levels: rows are counted within blocks of the sequence, and only the block totals are summed along a user, so
    one user with a large share of all operations is spread over tasks.
    """
    adds = adds.withColumn("block", F.floor(F.col("seq") / block))
    totals = adds.groupBy("user_id", "field", "block").count()
    before = totals.select("user_id", "field", "block", F.coalesce(F.sum("count").over(Window.partitionBy("user_id", "field").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("user_id", "field", "block").orderBy("seq")
    return adds.withColumn("n", F.row_number().over(within)).join(before, ["user_id", "field", "block"]).withColumn("n", (F.col("n") + F.col("before")).cast("int")).drop("block", "before")


#: What profile_state keeps of an item or value, and what a later base needs of it.
STATE = ["user_id", "field", "item_id", "added", "add_text", "written", "removed"]


def profile_state(ops: DataFrame, base: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """(user_id, field, item_id, value_no, text, live) and STATE: profiles after all delivered operations.

    One row for each item (value_no: the sequence that last wrote it; live = false is a tombstone), one for each single
    value set (item_id empty), one for each counter (field id_counters, item_id the list field, value_no the count).
    Adds take the next id of their list; ids are never used again, so an item lives until the first remove after its
    add, and whether an update or remove applied follows from the maxima of the three kinds alone. Updates and removes of
    ids not yet given stay in the state as rows that aren't live.

    base is an earlier result. The state of an item is its add and the maxima of its writes and removes, which fold the
    same way from any parts: the result doesn't depend on how the feed was split into base and ops nor on their order, and
    an add that comes late takes its place among the earlier ones. Operations of unknown kind, on unknown fields or ids,
    with empty text (but for notes) or with dates other than valid YYYY-MM-DD leave no trace. Repeated rows count once;
    rows of one (user_id, seq) that differ count as the greatest of them within one call.
    """
    once, kind = deliver_once(ops), dict(ops.dtypes)["seq"]
    listed = F.col("field").isin(*ID_PREFIXES)
    adds = once.where((F.col("op") == "add") & listed & (F.col("text") != "")).select("user_id", "field", "seq", "text")
    write = F.struct(F.col("seq").alias("seq"), F.col("text").alias("text"))
    edits = once.where(listed & ((F.col("op") == "remove") | (F.col("op") == "update") & (F.col("text") != "")))
    edits = edits.select("user_id", "field", "item_id", F.when(F.col("op") == "update", write).alias("written"), F.when(F.col("op") == "remove", F.col("seq")).alias("removed"))
    singles = once.where((F.col("op") == "set_notes") | (F.col("op") == "set_sex") & (F.col("text") != "") | (F.col("op") == "set_birth_date") & _valid_date(F.col("text")))
    single = F.element_at(F.create_map(*(F.lit(x) for kv in SINGLE_VALUES.items() for x in kv)), F.col("op"))
    edits = edits.unionByName(singles.select("user_id", single.alias("field"), F.lit("").alias("item_id"), write.alias("written"), F.lit(None).cast(kind).alias("removed")))
    if base is not None:
        kept = base.where("field <> 'id_counters'")
        earlier = kept.where("added is not null").select("user_id", "field", F.col("added").alias("seq"), F.col("add_text").alias("text"))
        adds = adds.unionByName(earlier).groupBy("user_id", "field", "seq").agg(F.max("text").alias("text"))  # an add of the base may come again
        edits = edits.unionByName(kept.where("written is not null or removed is not null").select("user_id", "field", "item_id", "written", "removed"))
    numbered = _numbered_adds(adds, block)
    prefix = F.element_at(F.create_map(*(F.lit(x) for kv in ID_PREFIXES.items() for x in kv)), F.col("field"))
    given = numbered.select("user_id", "field", F.concat(prefix, F.col("n").cast("string")).alias("item_id"), F.col("seq").alias("added"), F.col("text").alias("add_text"))
    nothing = lambda df, *names: df.withColumns({c: F.lit(None).cast(t) for c, t in names})
    events = nothing(given, ("written", f"struct<seq: {kind}, text: string>"), ("removed", kind)).unionByName(nothing(edits, ("added", kind), ("add_text", "string")))
    state = events.groupBy("user_id", "field", "item_id").agg(*(F.max(c).alias(c) for c in STATE[3:]))
    one = F.col("field").isin(*SINGLE_VALUES.values())
    live = one | F.col("added").isNotNull() & F.coalesce(F.col("removed") < F.col("added"), F.lit(True))
    last = F.greatest("written", F.when(F.col("added").isNotNull(), F.struct(F.col("added").alias("seq"), F.col("add_text").alias("text"))))
    rows = state.select("user_id", "field", "item_id", F.when(live, last["seq"]).otherwise(F.coalesce("removed", last["seq"])).alias("value_no"), last["text"].alias("text"), live.alias("live"), *STATE[3:])
    tallies = given.groupBy("user_id", F.col("field").alias("item_id")).agg(F.count(F.lit(1)).cast(kind).alias("value_no")).withColumns({"field": F.lit("id_counters"), "live": F.lit(True)})
    return rows.unionByName(tallies, allowMissingColumns=True)


def profile_rows(ops: DataFrame) -> DataFrame:
    """(user_id, field, item_id, value_no) of what is live in profile_state."""
    return profile_state(ops).where("live").select("user_id", "field", "item_id", F.col("value_no").cast("int").alias("value_no"))
