"""Queries on consultations, records, photos and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from looseleaf.operators import change_feed, memory as m
from looseleaf.sources.tables import table


def turns(spark, d):
    return m.distinct_turns(table(spark, d, "consultation_turns"))


MARKERS = ["cough", "pain", "ปวด", "แห้ง"]


def ages(spark, d):
    births = change_feed.profile_state(table(spark, d, "profile_ops")).where("field = 'birth_date'").select("user_id", F.try_to_date("text", "yyyy-MM-dd").alias("birth"))
    r = table(spark, d, "health_records").join(births, "user_id")
    day = F.to_date("consultation_date")
    return r.select("record_id", m.completed_years(F.col("birth"), day).cast("int").alias("age"))


def rejected(spark, d):
    """Operations that left no trace by their form alone: kind, field, text or date."""
    once = change_feed.deliver_once(table(spark, d, "profile_ops"))
    listed = F.col("field").isin(*change_feed.ID_PREFIXES)
    good = F.when(F.col("op").isin("add", "update"), listed & (F.col("text") != "")).when(F.col("op") == "remove", listed).when(F.col("op") == "set_sex", F.col("text") != "")
    good = good.when(F.col("op") == "set_birth_date", change_feed._valid_date(F.col("text"))).otherwise(F.col("op") == "set_notes")
    return once.where(~good).select("user_id", "seq", "op")


def audit(spark, d):
    """Deliveries of each profile operation: how often, when first and last."""
    return table(spark, d, "profile_ops").groupBy("user_id", "seq").agg(F.count(F.lit(1)).alias("deliveries"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"))


QUERIES = {
    "turns_once": turns,
    "session_of_turn": lambda s, d: m.sessions(turns(s, d)).select("turn_id", F.col("session_no").cast("bigint").alias("session_no")),
    "session_summary": lambda s, d: m.session_summary(turns(s, d)),
    "session_transcripts": lambda s, d: m.transcripts(turns(s, d)),
    "session_gate": lambda s, d: m.gate_sessions(turns(s, d), MARKERS),
    "history_last_turns": lambda s, d: m.last_turns(turns(s, d)).select("user_id", "turn_id", "nth"),
    "history_messages": lambda s, d: m.as_messages(m.last_turns(turns(s, d)), {"user": "user", "advisor": "assistant"}),
    "gated_operations": lambda s, d: m.gated_operations(table(s, d, "profile_ops"), turns(s, d), MARKERS),
    "retrieval_text": lambda s, d: m.retrieval_text(turns(s, d)),
    "records_recent": lambda s, d: m.recent_records(table(s, d, "health_records")).select("user_id", "record_id", "nth"),
    "records_on_day": lambda s, d: m.records_on(table(s, d, "health_records"), "2025-06-15").select("record_id", "user_id"),
    "records_search": lambda s, d: m.search_records(table(s, d, "health_records"), "cough|ไอแห้ง").select("record_id", "consultation_date"),
    "records_search_all": lambda s, d: m.search_records(table(s, d, "health_records"), "fever|ตัวร้อน", None).select("record_id"),
    "records_age": ages,
    "photos_latest": lambda s, d: m.latest_photos(table(s, d, "tongue_descriptions")),
    "photos_gate": lambda s, d: table(s, d, "tongue_descriptions").select("row_no", (F.col("confidence") >= 0.5).alias("passed"), (F.col("confidence") >= 0.5).eqNullSafe(F.col("passed_gate")).alias("agrees")),
    "profile_text": lambda s, d: m.render_profile(change_feed.profile_state(table(s, d, "profile_ops"))),
    "profile_rejected": rejected,
    "profile_audit": audit,
}

_TURNS = "t as (select user_id, role, ts, text, min(turn_id) as turn_id from consultation_turns group by user_id, role, ts, text)"
_FLAGS = f"""{_TURNS},
f as (select *, case when ts - lag(ts) over w >= interval 6 hour or lag(ts) over w is null then 1 else 0 end as opens
      from t where user_id is not null and ts is not null window w as (partition by user_id order by ts, turn_id)),
s as (select *, sum(opens) over (partition by user_id order by ts, turn_id rows unbounded preceding) as session_no from f)"""
_OPS = """o as (select distinct user_id, seq, op, coalesce(field, '') as field, coalesce(item_id, '') as item_id, coalesce(text, '') as text from profile_ops)"""
_PROFILE = f"""{_OPS},
l as (select * from o where field in ('chronic_conditions', 'allergies', 'medications', 'habits', 'ongoing_complaints')),
adds as (select user_id, field, seq, text, row_number() over (partition by user_id, field order by seq) as n from l where op = 'add' and text <> ''),
items as (
  select a.user_id, a.field, a.n, substr(a.field, 1, 1) || a.n as item_id,
         coalesce((select arg_max(u.text, u.seq) from l u where u.user_id = a.user_id and u.field = a.field and u.item_id = substr(a.field, 1, 1) || a.n
                   and u.op = 'update' and u.text <> '' and u.seq > a.seq), a.text) as text
  from adds a
  where not exists (select 1 from l r where r.user_id = a.user_id and r.field = a.field and r.item_id = substr(a.field, 1, 1) || a.n and r.op = 'remove' and r.seq > a.seq)),
singles as (
  select user_id, substr(op, 5) as field, arg_max(text, seq) as text from o
  where op = 'set_notes' or op = 'set_sex' and text <> ''
     or op = 'set_birth_date' and regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') and try_cast(text as date) is not null
  group by user_id, op)"""

SQL = {
    "turns_once": f"with {_TURNS} select turn_id, user_id, role, text, ts from t",
    "session_of_turn": f"with {_FLAGS} select turn_id, cast(session_no as bigint) as session_no from s",
    "session_summary": f"""with {_FLAGS}, g as (
  select user_id, cast(session_no as bigint) as session_no, count(*) as turns, cast(sum(case when role = 'user' then 1 else 0 end) as bigint) as user_turns,
         min(ts) as started, max(ts) as ended from s group by user_id, session_no)
select *, session_no < max(session_no) over (partition by user_id) as closed from g""",
    "session_transcripts": f"""with {_FLAGS}
select user_id, cast(session_no as bigint) as session_no, string_agg(role || ': ' || text, chr(10) order by ts, turn_id) as transcript
from s where text is not null group by user_id, session_no""",
    "session_gate": f"""with {_FLAGS}, g as (
  select user_id, cast(session_no as bigint) as session_no, coalesce(bool_or(role = 'user' and regexp_matches(text, 'cough|pain|ปวด|แห้ง', 'i')), false) as passed from s group by user_id, session_no)
select user_id, session_no, passed from (select *, max(session_no) over (partition by user_id) as last_no from g) q where session_no < last_no""",
    "history_messages": f"""with {_TURNS}
select user_id, turn_id, case role when 'advisor' then 'assistant' else role end as role, text as content
from (select *, row_number() over (partition by user_id order by ts desc, turn_id desc) as nth from t) q where nth <= 30 and text is not null and role in ('user', 'advisor')""",
    "gated_operations": f"""with {_FLAGS}, g as (
  select user_id, cast(session_no as bigint) as session_no, min(ts) as started, max(ts) as ended, coalesce(bool_or(role = 'user' and regexp_matches(text, 'cough|pain|ปวด|แห้ง', 'i')), false) as passed from s group by user_id, session_no),
l as (select *, max(session_no) over (partition by user_id) as last_no from g)
select delivery_id, p.user_id, session_no from profile_ops p join l on l.user_id = p.user_id and noted_at >= started and noted_at <= ended + interval 6 hour where passed and session_no < last_no""",
    "history_last_turns": f"""with {_TURNS}
select user_id, turn_id, cast(nth as int) as nth from (select *, row_number() over (partition by user_id order by ts desc, turn_id desc) as nth from t) q where nth <= 30""",
    "retrieval_text": f"""with {_TURNS}, u as (select * from t where role = 'user' and text is not null and user_id is not null and ts is not null)
select turn_id, user_id, string_agg(text, chr(10)) over (partition by user_id order by ts, turn_id rows between 3 preceding and current row) as query from u""",
    "records_recent": """select user_id, record_id, cast(nth as int) as nth from (
  select *, row_number() over (partition by user_id order by consultation_date desc, record_id desc) as nth from health_records) q where nth <= 3""",
    "records_on_day": "select record_id, user_id from health_records where consultation_date >= timestamp '2025-06-15' and consultation_date < timestamp '2025-06-16'",
    "records_search": """select record_id, consultation_date from health_records
where regexp_matches(chief_complaint, 'cough|ไอแห้ง', 'i') or list_bool_or(list_transform(symptoms, lambda s: regexp_matches(s, 'cough|ไอแห้ง', 'i')))
   or regexp_matches(advice_given, 'cough|ไอแห้ง', 'i') or regexp_matches(conversation_summary, 'cough|ไอแห้ง', 'i')
order by consultation_date desc, record_id desc limit 10""",
    "records_search_all": """select record_id from health_records
where regexp_matches(chief_complaint, 'fever|ตัวร้อน', 'i') or list_bool_or(list_transform(symptoms, lambda s: regexp_matches(s, 'fever|ตัวร้อน', 'i')))
   or regexp_matches(advice_given, 'fever|ตัวร้อน', 'i') or regexp_matches(conversation_summary, 'fever|ตัวร้อน', 'i')""",
    "records_age": f"""with {_OPS}, b as (
  select user_id, cast(arg_max(text, seq) as date) as birth from o
  where op = 'set_birth_date' and regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') and try_cast(text as date) is not null group by user_id)
select record_id, cast(year(consultation_date) - year(birth) - case when strftime(consultation_date, '%m%d') < strftime(birth, '%m%d') then 1 else 0 end as int) as age
from health_records join b using (user_id)""",
    "photos_latest": "select photo_id, "
    + ", ".join(f"arg_max({c}, row_no) filter ({c} is not null) as {c}" for c in ["user_id", "captured_at", "confidence", "passed_gate", "color", "coating", "size", "shape", "spots", "notes", "quality"])
    + ", count(*) as deliveries from tongue_descriptions group by photo_id",
    "photos_gate": "select row_no, confidence >= 0.5 as passed, (confidence >= 0.5) is not distinct from passed_gate as agrees from tongue_descriptions",
    "profile_text": f"""with {_PROFILE}, rows as (
  select user_id, field, n, '[' || item_id || '] ' || text as shown from items union all select user_id, field, 0 as n, text as shown from singles where text <> ''),
lines as (
  select user_id, list_position(['sex', 'birth_date', 'notes', 'chronic_conditions', 'allergies', 'medications', 'habits', 'ongoing_complaints'], field) as rank,
         field || ': ' || string_agg(shown, '; ' order by n) as line from rows group by user_id, field)
select user_id, string_agg(line, chr(10) order by rank) as profile from lines group by user_id""",
    "profile_rejected": f"""with {_OPS}
select user_id, seq, op from o where not case
  when op in ('add', 'update') then field in ('chronic_conditions', 'allergies', 'medications', 'habits', 'ongoing_complaints') and text <> ''
  when op = 'remove' then field in ('chronic_conditions', 'allergies', 'medications', 'habits', 'ongoing_complaints')
  when op = 'set_sex' then text <> ''
  when op = 'set_birth_date' then regexp_matches(text, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') and try_cast(text as date) is not null
  else op = 'set_notes' end""",
    "profile_audit": "select user_id, seq, count(*) as deliveries, min(received_at) as first_at, max(received_at) as last_at from profile_ops group by user_id, seq",
}
