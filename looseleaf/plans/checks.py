"""Queries on checks, correlations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from looseleaf.operators import checks as c, corpus, graph, memory
from looseleaf.plans import corpus as corpus_plans, graph as graph_plans, memory as memory_plans
from looseleaf.sources.tables import table

OPS = ["add", "update", "remove", "set_sex", "set_birth_date", "set_notes"]


def marked_notes(spark, d):
    """Notes with a marker for each later page; long ones also with one for its first page at the end."""
    n = table(spark, d, "source_notes")
    markers = F.when(F.col("page_last") > F.col("page_first"), F.transform(F.sequence(F.col("page_first") + 1, F.col("page_last")), lambda p: F.concat(F.lit("<!-- p."), p.cast("string"), F.lit(" -->\n"))))
    wrong = F.when(F.col("page_last") >= F.col("page_first") + 3, F.concat(F.lit("\n<!-- p."), F.col("page_first").cast("string"), F.lit(" -->"))).otherwise("")
    return n.select("note_id", "page_first", "page_last", F.concat(F.array_join(F.coalesce(markers, F.array().cast("array<string>")), ""), F.col("body"), wrong).alias("body"))


def photo_sessions(spark, d):
    photos = memory.latest_photos(table(spark, d, "tongue_descriptions"))
    s = memory.session_summary(memory_plans.turns(spark, d)).withColumn("until", F.col("ended") + F.expr("interval 3 hours"))
    return c.within_intervals(photos, s, "user_id", "captured_at", "started", "until", ["photo_id"], ["session_no"])


def best_photo(spark, d):
    p = table(spark, d, "tongue_descriptions")
    best = p.groupBy("user_id").agg(F.max(F.struct("confidence", (-F.col("row_no")).alias("first"))).alias("b"))
    return best.select("user_id", F.col("b.confidence").alias("confidence"), (-F.col("b.first")).alias("row_no"), (F.col("b.confidence") >= 0.5).alias("passed"))


def page_starts(spark, d):
    """First record of each page beside the notes of its book, by number; books of one side only meet nulls."""
    pages = table(spark, d, "page_records").groupBy("book_id", "page").agg(F.min("record_id").alias("record_id"))
    return c.zipped(pages, table(spark, d, "source_notes"), "book_id", ["page"], ["uid", "note_id"], ["page", "record_id"], ["note_id"])


def grounded(spark, d):
    """References of each query: relations, or chunks where there are none."""
    x = graph_plans.hits(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id").select("query_id", "id", "label")
    return c.first_choice([x.where("label = 3").select("query_id", "id"), x.where("label <> 3").select("query_id", "id")], "query_id")


def blocks(spark, d):
    r = table(spark, d, "health_records")
    parts = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("chief_complaint", F.lit("")).alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")), F.struct(F.lit("text").alias("type"), F.coalesce("advice_given", F.lit("")).alias("text")))
    return r.select("record_id", c.flattened(parts).alias("content"), F.substring("conversation_summary", 1, 400).alias("short"))


def summary(spark, d):
    notes = table(spark, d, "source_notes")
    return c.summary(
        {
            "op": c.outside_domain(table(spark, d, "profile_ops"), "delivery_id", "op", OPS),
            "role": c.outside_domain(table(spark, d, "consultation_turns"), "turn_id", "role", ["user", "advisor"]),
            "quality": c.outside_domain(table(spark, d, "tongue_descriptions"), "row_no", "quality", ["clear", "blurry", "partial", "poor_lighting"]),
            "duplicate uid": corpus.duplicate_keys(notes, "uid", "note_id"),
            "backward pages": corpus.backward_ranges(notes),
        }
    )


QUERIES = {
    "check_operations": lambda s, d: c.outside_domain(table(s, d, "profile_ops"), "delivery_id", "op", OPS),
    "check_markers": lambda s, d: c.marker_violations(marked_notes(s, d)),
    "check_summary": summary,
    "first_headings": lambda s, d: c.heading_lines(table(s, d, "documents"), "doc_id", "text"),
    "photo_sessions": photo_sessions,
    "photo_best": best_photo,
    "photo_links": lambda s, d: table(s, d, "tongue_descriptions").select("row_no", c.link(F.when(F.col("passed_gate"), F.lit("https://photos.example//")), "photos", F.col("photo_id")).alias("url")),
    "page_starts": page_starts,
    "references_or_chunks": grounded,
    "content_blocks": blocks,
    "book_manifest": lambda s, d: c.keyed_json(corpus.fingerprints(table(s, d, "source_notes")).withColumn("book", F.regexp_replace("uid", "-[0-9]+$", "")), "book", "uid", "sha256"),
    "landing_report": lambda s, d: c.rate_report(graph.landing_rates(graph_plans.outcomes(s, d))),
    "symptom_tables": lambda s, d: c.markdown_table(corpus_plans.symptom_tables(s, d)),
}

_OUT = "('add', 'update', 'remove', 'set_sex', 'set_birth_date', 'set_notes')"
_PHOTOS = "p as (select photo_id, arg_max(user_id, row_no) filter (user_id is not null) as user_id, arg_max(captured_at, row_no) filter (captured_at is not null) as captured_at from tongue_descriptions group by photo_id)"

SQL = {
    "check_operations": f"select delivery_id, op as value from profile_ops where op is null or op not in {_OUT}",
    "check_markers": """with m as (select note_id, page_first, page_last, list_concat(range(page_first + 1, page_last + 1), case when page_last >= page_first + 3 then [page_first] else [] end) as ps from source_notes where body is not null),
x as (select note_id, page_first, page_last, unnest(ps) as page, generate_subscripts(ps, 1) as nth from m),
y as (select *, lag(page) over (partition by note_id order by nth) as before from x)
select note_id, cast(page as int) as page, 'outside' as problem from y where page <= page_first or page > page_last
union all select note_id, cast(page as int), 'order' from y where before >= page""",
    "check_summary": f"""with v as (
select 'op' as name, count(*) as violations from profile_ops where op is null or op not in {_OUT}
union all select 'role', count(*) from consultation_turns where role is null or role not in ('user', 'advisor')
union all select 'quality', count(*) from tongue_descriptions where quality is null or quality not in ('clear', 'blurry', 'partial', 'poor_lighting')
union all select 'duplicate uid', count(*) from (select note_id, min(note_id) over (partition by uid) as first from source_notes where uid is not null) q where note_id > first
union all select 'backward pages', count(*) from source_notes where page_first > page_last or pdf_first > pdf_last)
select name, violations, case when violations = 0 then 'ok' else 'fail' end as status from v""",
    "first_headings": r"""with x as (select doc_id, regexp_extract(text, '(?m)^(#{1,6})[ \t]+([^\n]*)$', 1) as h, regexp_extract(text, '(?m)^(#{1,6})[ \t]+([^\n]*)$', 2) as title from documents)
select doc_id, cast(length(h) as int) as level, trim(title, ' ') as title from x where h <> ''""",
    "photo_sessions": f"""with {memory_plans._FLAGS}, g as (select user_id, cast(session_no as bigint) as session_no, min(ts) as started, max(ts) as ended from s group by user_id, session_no), {_PHOTOS}
select p.user_id, photo_id, session_no from p join g on p.user_id = g.user_id and captured_at >= started and captured_at <= ended + interval 3 hour""",
    "photo_best": """select user_id, confidence, row_no, confidence >= 0.5 as passed from (select *, row_number() over (partition by user_id order by confidence desc, row_no) as n from tongue_descriptions) q where n = 1""",
    "photo_links": "select row_no, case when passed_gate then 'https://photos.example/photos/' || photo_id end as url from tongue_descriptions",
    "page_starts": """with x as (select book_id, page, min(record_id) as record_id, row_number() over (partition by book_id order by page) as nth from page_records group by book_id, page),
y as (select book_id, note_id, row_number() over (partition by book_id order by uid, note_id) as nth from source_notes)
select coalesce(x.book_id, y.book_id) as book_id, cast(coalesce(x.nth, y.nth) as int) as nth, page, record_id, note_id from x full join y on x.book_id = y.book_id and x.nth = y.nth""",
    "references_or_chunks": f"""with {graph_plans._HITS}, t as (select query_id, id, label from h where rank <= 20)
select query_id, id, 0 as mode from t where label = 3 union all select query_id, id, 1 from t where label <> 3 and query_id not in (select query_id from t where label = 3)""",
    "content_blocks": "select record_id, coalesce(chief_complaint, '') || coalesce(advice_given, '') as content, substr(conversation_summary, 1, 400) as short from health_records",
    "book_manifest": f"""with {corpus_plans._PRINTS}
select regexp_replace(uid, '-[0-9]+$', '') as book, '{{' || string_agg('"' || uid || '":"' || sha256 || '"', ',' order by uid) || '}}' as json from f where sha256 is not null group by 1""",
    "landing_report": f"""with {graph_plans._OUTCOMES}, r as (select axis, count(*) filter (outcome <> 'miss') / count(*) as rate from o group by axis)
select axis, printf('%-10s %5.1f%% ', axis, round(rate, 6) * 100) || repeat('█', cast(round(round(rate, 6) * 20) as int)) as line from r""",
    "symptom_tables": """select record_id as key, '| n | symptom |' || chr(10) || '|---|---|' || coalesce(chr(10) || nullif(array_to_string(list_transform(symptoms, lambda s, i: '| ' || i || ' | ' || s || ' |'), chr(10)), ''), '') as "table"
from health_records where symptoms is not null""",
}
