"""Consultations: turns split by inactivity, history windows, record lookups, photo patches and profile rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from looseleaf.operators.blocks import month_block, with_previous, with_running_sum
from looseleaf.operators.checks import within_intervals

#: Hours without a turn after which a consultation counts as over; exactly so many hours close it.
GAP_HOURS = 6.0



def distinct_turns(turns: DataFrame) -> DataFrame:
    """Turns once each: of rows alike in user, role, time and text the one with the least id. Null texts compare equal."""
    return turns.groupBy("user_id", "role", "ts", "text").agg(F.min("turn_id").alias("turn_id")).select("turn_id", "user_id", "role", "text", "ts")


def sessions(turns: DataFrame, gap_hours: float = GAP_HOURS) -> DataFrame:
    """turns with session_no, from 1 for each user: a turn opens a session if gap_hours or more passed since the one before.

    Rows without a time or user are left out. Users of any size are worked on in blocks of a month.
    """
    x = turns.where("user_id is not null and ts is not null")
    x = with_previous(x, ["user_id"], ["ts", "turn_id"], "ts", month_block("ts"), "previous")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous").cast("timestamp"))
    opens = F.when(F.col("previous").isNull() | (gap >= F.lit(int(gap_hours * 3_600_000_000))), 1).otherwise(0)
    return with_running_sum(x, ["user_id"], ["ts", "turn_id"], opens, month_block("ts"), "session_no").drop("previous")


def session_summary(turns: DataFrame, gap_hours: float = GAP_HOURS) -> DataFrame:
    """One row for each session: turns, turns of the user, begin, end, and whether a later session closed it.

    Closing is lazy: the last session of a user stays open.
    """
    each = sessions(turns, gap_hours).groupBy("user_id", "session_no").agg(
        F.count(F.lit(1)).alias("turns"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("user_turns"), F.min("ts").alias("started"), F.max("ts").alias("ended")
    )
    last = each.groupBy("user_id").agg(F.max("session_no").alias("last_no"))
    return each.join(last, "user_id").withColumn("closed", F.col("session_no") < F.col("last_no")).drop("last_no")


def transcripts(turns: DataFrame, gap_hours: float = GAP_HOURS) -> DataFrame:
    """(user_id, session_no, transcript): `role: text` lines of each session in order; turns without text are left out."""
    lines = sessions(turns, gap_hours).where("text is not null")
    ordered = F.array_sort(F.collect_list(F.struct("ts", "turn_id", F.concat_ws(": ", "role", "text").alias("line"))))
    return lines.groupBy("user_id", "session_no").agg(ordered.alias("ls")).select("user_id", "session_no", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("transcript"))


def last_turns(turns: DataFrame, most: int = 30) -> DataFrame:
    """The last turns of each user, newest first by `nth`; none for most = 0. The rank limit works before the shuffle, too."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("turn_id"))
    return turns.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def retrieval_text(turns: DataFrame, before: int = 3) -> DataFrame:
    """(turn_id, user_id, query): each user turn under the texts of the user's last turns before it, oldest first.

    Turns are numbered within users in blocks; each is sent to the turns that look back on it, so no task needs a whole user.
    """
    own = turns.where("role = 'user' and text is not null and user_id is not null and ts is not null")
    own = with_running_sum(own, ["user_id"], ["ts", "turn_id"], F.lit(1), month_block("ts"), "n")
    sent = own.select("user_id", "n", "text", "turn_id", F.explode(F.sequence(F.lit(0), F.lit(before))).alias("ahead"))
    at = sent.withColumn("to", F.col("n") + F.col("ahead")).groupBy("user_id", "to")
    got = at.agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("ts"), F.max(F.when(F.col("ahead") == 0, F.col("turn_id"))).alias("turn_id"))
    return got.where("turn_id is not null").select("turn_id", "user_id", F.array_join(F.transform("ts", lambda x: x["text"]), "\n").alias("query"))


def recent_records(records: DataFrame, most: int = 3) -> DataFrame:
    """The newest records of each user, numbered from 1."""
    w = Window.partitionBy("user_id").orderBy(F.desc("consultation_date"), F.desc("record_id"))
    return records.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def records_on(records: DataFrame, day: str) -> DataFrame:
    """Records of one UTC day, a half-open range that the scan can use."""
    start = F.lit(day).cast("timestamp")
    return records.where((F.col("consultation_date") >= start) & (F.col("consultation_date") < start + F.expr("interval 1 day")))


def search_records(records: DataFrame, pattern: str, most: int | None = 10) -> DataFrame:
    """Records of which a text field or a symptom matches the pattern, whatever the case; the newest ones, all for None."""
    p = "(?i)" + pattern
    hit = F.col("chief_complaint").rlike(p) | F.exists(F.coalesce("symptoms", F.array().cast("array<string>")), lambda s: F.coalesce(s.rlike(p), F.lit(False))) | F.col("advice_given").rlike(p) | F.col("conversation_summary").rlike(p)
    found = records.where(F.coalesce(hit, F.lit(False)))
    return found if most is None else found.orderBy(F.desc("consultation_date"), F.desc("record_id")).limit(most)


def completed_years(birth: Column, day: Column) -> Column:
    """Age in completed years; a birthday on 29 February is reached on 1 March of common years."""
    return F.year(day) - F.year(birth) - F.when(F.date_format(day, "MMdd") < F.date_format(birth, "MMdd"), 1).otherwise(0)


def latest_photos(photos: DataFrame) -> DataFrame:
    """One row for each photo: of repeated deliveries the fields that the last one with a value gave (patch wins over insert)."""
    fields = ["user_id", "captured_at", "confidence", "passed_gate", "color", "coating", "size", "shape", "spots", "notes", "quality"]
    return photos.groupBy("photo_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row_no"))).alias(c) for c in fields), F.count(F.lit(1)).alias("deliveries"))


def render_profile(state: DataFrame) -> DataFrame:
    """(user_id, profile): a text of the live single values and items of a profile state, empty lists left out."""
    live = state.where("live and field <> 'id_counters' and text <> ''")
    names = F.array(*map(F.lit, ["sex", "birth_date", "notes", "chronic_conditions", "allergies", "medications", "habits", "ongoing_complaints"]))
    rank = F.array_position(names, F.col("field"))
    items = live.groupBy("user_id", "field").agg(F.array_sort(F.collect_list(F.struct(F.coalesce(F.regexp_extract("item_id", r"([0-9]+)$", 1).try_cast("int"), F.lit(0)).alias("n"), "item_id", "text"))).alias("xs"))
    shown = F.array_join(F.transform("xs", lambda x: F.when(x["item_id"] == "", x["text"]).otherwise(F.concat(F.lit("["), x["item_id"], F.lit("] "), x["text"]))), "; ")
    lines = items.select("user_id", rank.alias("rank"), F.concat_ws(": ", "field", shown).alias("line"))
    return lines.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("profile"))


def gate_sessions(turns: DataFrame, markers: list[str], gap_hours: float = GAP_HOURS) -> DataFrame:
    """(user_id, session_no, passed): whether a user turn of a closed session holds one of the markers."""
    s = sessions(turns, gap_hours)
    hit = F.col("text").rlike("(?i)" + "|".join(markers)) & (F.col("role") == "user")
    each = s.groupBy("user_id", "session_no").agg(F.coalesce(F.max(hit), F.lit(False)).alias("passed"))
    last = each.groupBy("user_id").agg(F.max("session_no").alias("last_no"))
    return each.join(last, "user_id").where("session_no < last_no").select("user_id", "session_no", "passed")


def as_messages(turns: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(user_id, turn_id, role, content) of turns with a text, roles renamed; turns of other roles are left out."""
    to = F.element_at(F.create_map(*(F.lit(x) for kv in roles.items() for x in kv)), F.col("role"))
    return turns.where("text is not null").select("user_id", "turn_id", to.alias("role"), F.col("text").alias("content")).where("role is not null")


def gated_operations(ops: DataFrame, turns: DataFrame, markers: list[str], gap_hours: float = GAP_HOURS) -> DataFrame:
    """(delivery_id, user_id, session_no): operations noted in a closed session that passed the gate, or within gap_hours after it; they alone may change a profile."""
    passed = gate_sessions(turns, markers, gap_hours).where("passed").select("user_id", "session_no")
    spans = session_summary(turns, gap_hours).join(passed, ["user_id", "session_no"]).withColumn("until", F.col("ended") + F.make_interval(hours=F.lit(int(gap_hours))))
    return within_intervals(ops.where("user_id is not null"), spans, "user_id", "noted_at", "started", "until", ["delivery_id"], ["session_no"]).select("delivery_id", "user_id", "session_no")
