"""Queries on page text and corpus notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from looseleaf.functions import text as t
from looseleaf.operators import corpus as c
from looseleaf.sources.tables import table

_MARKS = "ัำิีึืฺุู็่้๊๋์ํ๎"


def metrics(spark, d):
    x = table(spark, d, "page_records").where("text is not null")
    after = t.repair(F.col("text"))
    return x.select(
        "record_id",
        F.length("text").alias("chars"),
        t.doubled(F.col("text")).alias("doubled"),
        t.doubled(after).alias("doubled_after"),
        t.illegal_pairs(F.col("text")).alias("illegal_pairs"),
        t.orphan_marks(F.col("text")).alias("orphans"),
        F.size(t.unmapped(F.col("text"))).alias("unmapped"),
    )


def contexts(spark, d):
    x = table(spark, d, "page_records").select("record_id", "text", F.explode(t.unmapped(F.col("text"))).alias("at"))
    return x.select("record_id", "at", t.context(F.col("text"), F.col("at")).alias("around"))


def page_lines(spark, d):
    x = table(spark, d, "page_records").where("text is not null")
    return x.select("record_id", F.posexplode(t.lines(F.col("text"))).alias("k", "line"))


def asked(spark, d):
    x = table(spark, d, "documents").select("doc_id", t.field(F.col("text"), "Question:").alias("question"), F.contains("text", F.lit("ควรเลี่ยง")).alias("warns"), F.contains("text", F.lit("should avoid")).alias("avoids"))
    return x.where("question is not null or warns or avoids")


def symptom_tables(spark, d):
    """Symptoms of each record as lines of a Markdown table."""
    r = table(spark, d, "health_records").where("symptoms is not null")
    rows = F.transform("symptoms", lambda s, i: F.concat(F.lit("| "), (i + 1).cast("string"), F.lit(" | "), s, F.lit(" |")))
    lines = F.concat(F.array(F.coalesce("chief_complaint", F.lit("")), F.lit("| n | symptom |"), F.lit("|---|---|")), rows)
    return r.select(F.col("record_id").alias("key"), F.posexplode(lines).alias("k", "line"))


def rendered(spark, d):
    return c.render_note(table(spark, d, "source_notes"))


def parsed(spark, d):
    x = c.parse_note(rendered(spark, d).select("path", "note_id", "content").select(F.concat_ws("#", "note_id", "path").alias("path"), "content"))
    f = lambda k: F.element_at("fields", k)
    return x.select("path", f("uid").alias("uid"), f("section").alias("section"), t.page_pair(f("pages"))["first"].alias("first"), t.page_pair(f("pages"))["last"].alias("last"), t.page_pair(f("pdf_pages"))["first"].alias("pdf_first"), F.length("body").alias("chars"))


def committed(spark, d):
    m = table(spark, d, "index_manifest")
    last = m.groupBy().agg(F.max(F.struct("snapshot_no", "delivery_no")).alias("m")).select("m.snapshot_no", "m.delivery_no")
    return m.join(last, ["snapshot_no", "delivery_no"]).select(F.lower(F.trim("uid")).alias("uid"), F.lower("sha256").alias("sha256")).distinct()


def manifest_report(spark, d):
    m = table(spark, d, "index_manifest")
    return m.groupBy("snapshot_no", "delivery_no").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(F.lower(F.trim("uid"))).alias("uids"), F.sum(F.col("sha256").isNull().cast("bigint")).alias("nulls"), F.max("delivered_at").alias("delivered_at")
    )


def headings(spark, d):
    """Paragraphs numbered by page and paragraph, as headings of their book."""
    return table(spark, d, "page_records").select(F.col("book_id").alias("key"), F.col("record_id").alias("pos"), F.col("page").alias("major"), F.col("paragraph").alias("minor"))


def notes(spark, d):
    return table(spark, d, "source_notes")


def note_pages(spark, d):
    return c.with_page_markers(table(spark, d, "page_records"))


QUERIES = {
    "text_repair": lambda s, d: table(s, d, "page_records").select("record_id", t.repair(F.col("text")).alias("text")),
    "text_metrics": metrics,
    "unmapped_context": contexts,
    "page_lines": page_lines,
    "labelled_fields": asked,
    "table_runs": lambda s, d: c.table_runs(symptom_tables(s, d)),
    "heading_sequence": lambda s, d: c.sequence_headings(headings(s, d)),
    "section_spans": lambda s, d: c.section_spans(notes(s, d)),
    "page_markers": note_pages,
    "comment_kinds": lambda s, d: c.comment_kinds(note_pages(s, d).select(F.concat_ws("#", "book_id", "page").alias("page_key"), "content"), "page_key", "content"),
    "note_filename": lambda s, d: notes(s, d).select("note_id", c.filename(notes(s, d)).alias("name")),
    "note_render": lambda s, d: rendered(s, d).select("note_id", "content"),
    "note_parse": parsed,
    "note_missing_fields": lambda s, d: c.missing_fields(c.parse_note(rendered(s, d).select(F.concat_ws("#", "note_id", "path").alias("path"), "content"))),
    "note_filename_errors": lambda s, d: c.filename_errors(notes(s, d)),
    "note_duplicate_uids": lambda s, d: c.duplicate_keys(notes(s, d), "uid", "note_id"),
    "note_backward_pages": lambda s, d: c.backward_ranges(notes(s, d)),
    "note_short_bodies": lambda s, d: c.short_bodies(notes(s, d), 600),
    "note_mixed_widths": lambda s, d: c.mixed_widths(notes(s, d).unionByName(notes(s, d).where("page_first <= 3").withColumn("uid", F.concat("uid", F.lit("0"))))),
    "note_order_violations": lambda s, d: c.order_violations(notes(s, d)),
    "note_coverage_gaps": lambda s, d: c.coverage_gaps(notes(s, d)),
    "note_fingerprints": lambda s, d: c.fingerprints(notes(s, d)),
    "manifest_drift": lambda s, d: c.manifest_drift(committed(s, d), c.fingerprints(notes(s, d))),
    "manifest_report": manifest_report,
    "books_coverage": lambda s, d: c.books_coverage(notes(s, d), table(s, d, "page_records")),
}


def _repaired(x: str) -> str:
    for m in _MARKS:
        x = f"regexp_replace({x}, '{m}{m}(\\s*)[�ˠˣ]', '{m}{m}\\1', 'g')"
    for m in _MARKS:
        x = f"replace({x}, '{m}{m}', '{m}')"
    return x


def _doubles(x: str) -> str:
    return " + ".join(f"(length({x}) - length(replace({x}, '{m}{m}', '{m}')))" for m in _MARKS)


_CONTENT = """n as (select *, '---' || chr(10) || concat_ws(chr(10), 'uid: ' || uid, 'type: ' || note_type, 'book_id: ' || book_id, 'chapter: ' || chapter, 'section: ' || section,
  'pages: [' || page_first || ', ' || page_last || ']', 'pdf_pages: [' || pdf_first || ', ' || pdf_last || ']') || chr(10) || '---' || chr(10) || body as content from source_notes)"""
_PRINTS = f"{_CONTENT}, f as (select uid, arg_max(sha256(content), note_id) as sha256 from n group by uid)"
_PAGES = """b as (select book_id, page, string_agg(text, chr(10) || chr(10) order by paragraph, record_id) as body from page_records where text is not null group by book_id, page),
p as (select book_id, page, case when page > min(page) over (partition by book_id) then '<!-- p.' || page || ' -->' || chr(10) else '' end || body as content from b)"""
_ABOVE, _VOWELS, _TONES = "ัิีึื็ํ่้๊๋์", "ัิีึื็ํ", "่้๊๋์"

SQL = {
    "text_repair": f"select record_id, {_repaired('text')} as text from page_records",
    "text_metrics": f"""with r as (select record_id, text, {_repaired('text')} as after from page_records where text is not null),
ch as (select record_id, unnest(regexp_extract_all(text, '(?s).')) as ch, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) as i from r),
w as (select record_id, ch, lag(ch) over (partition by record_id order by i) as before from ch),
m as (select record_id, sum(case when position(ch in '{_ABOVE}') > 0 and before is not null and position(before in '{_ABOVE}') > 0
                                  and not (position(before in '{_VOWELS}') > 0 and position(ch in '{_TONES}') > 0) then 1 else 0 end) as pairs,
             sum(case when position(ch in '{_MARKS}') > 0 and not (before is not null and (before between 'ก' and 'ฮ' or position(before in '{_MARKS}เแโใไ') > 0)) then 1 else 0 end) as orphans
      from w group by record_id)
select record_id, cast(length(text) as int) as chars, cast({_doubles('text')} as int) as doubled, cast({_doubles('after')} as int) as doubled_after,
       cast(pairs as int) as illegal_pairs, cast(orphans as int) as orphans, cast(length(text) - length(replace(text, '�', '')) as int) as unmapped
from r join m using (record_id)""",
    "unmapped_context": """with ch as (select record_id, text, unnest(regexp_extract_all(text, '(?s).')) as ch, generate_subscripts(regexp_extract_all(text, '(?s).'), 1) as i
  from page_records where text like '%�%')
select record_id, cast(i - 1 as int) as at, substr(text, greatest(i - 26, 0) + 1, i + 14 - greatest(i - 26, 0)) as around from ch where ch = '�'""",
    "page_lines": r"""with l as (select record_id, string_split_regex(regexp_replace(text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') as ls from page_records where text is not null)
select record_id, cast(generate_subscripts(ls, 1) - 1 as int) as k, unnest(ls) as line from l""",
    "labelled_fields": r"""select doc_id, nullif(trim(regexp_extract(text, 'Question:[ \t]*(.*)', 1), ' '), '') as question, contains(text, 'ควรเลี่ยง') as warns, contains(text, 'should avoid') as avoids
from documents where nullif(trim(regexp_extract(text, 'Question:[ \t]*(.*)', 1), ' '), '') is not null or contains(text, 'ควรเลี่ยง') or contains(text, 'should avoid')""",
    "table_runs": """select record_id as key, 1 as start, cast(len(symptoms) + 2 as bigint) as rows, true as separated, cast(1 as bigint) as widths from health_records where symptoms is not null""",
    "heading_sequence": """with recursive h as (
  select book_id as key, record_id as pos, page as major, paragraph as minor, row_number() over (partition by book_id order by record_id) as n from page_records
), f(key, n, pos, major, minor, last_major, last_minor, kept) as (
  select key, n, pos, major, minor, case when major = 1 and minor = 1 then 1 else 0 end, case when major = 1 and minor = 1 then 1 else 0 end, major = 1 and minor = 1 from h where n = 1
  union all
  select h.key, h.n, h.pos, h.major, h.minor,
         case when h.major = f.last_major and h.minor = f.last_minor + 1 and f.last_major > 0 or h.major = f.last_major + 1 and h.minor = 1 then h.major else f.last_major end,
         case when h.major = f.last_major and h.minor = f.last_minor + 1 and f.last_major > 0 or h.major = f.last_major + 1 and h.minor = 1 then h.minor else f.last_minor end,
         h.major = f.last_major and h.minor = f.last_minor + 1 and f.last_major > 0 or h.major = f.last_major + 1 and h.minor = 1
  from f join h on h.key = f.key and h.n = f.n + 1
) select key, pos, major, minor from f where kept""",
    "section_spans": """select note_id, lead(note_id) over w as next_id, lead(page_first) over w as next_page from source_notes window w as (partition by book_id order by page_first, uid, note_id)""",
    "page_markers": f"with {_PAGES} select * from p",
    "comment_kinds": rf"""with {_PAGES}, x as (select book_id || '#' || page as page_key, regexp_extract_all(content, '(?s)<!--(.*?)-->', 1) as cs from p),
e as (select page_key, cast(generate_subscripts(cs, 1) as int) as nth, unnest(cs) as c from x)
select page_key, nth, case when regexp_matches(c, '^ p\.[0-9]+ $') then 'page' when regexp_matches(c, '^ sic: .+ $') then 'sic' when starts_with(ltrim(c), 'sic:') then 'malformed sic' else 'unknown' end as kind from e""",
    "note_filename": "select note_id, regexp_extract(uid, '-([0-9]+)$', 1) || '-' || section || '-น.' || page_first || '-' || page_last || '.md' as name from source_notes",
    "note_render": f"with {_CONTENT} select note_id, content from n",
    "note_parse": """select note_id || '#' || path as path, trim(uid) as uid, trim(section) as section, page_first as first, page_last as last,
  case when pdf_first is not null and pdf_last is not null then pdf_first end as pdf_first, cast(length(body) as int) as chars from source_notes""",
    "note_missing_fields": """select note_id || '#' || path as path, 'pdf_pages' as field from source_notes where pdf_first is null or pdf_last is null
union all select note_id || '#' || path, 'chapter' from source_notes where chapter is null union all select note_id || '#' || path, 'section' from source_notes where section is null""",
    "note_filename_errors": r"""with x as (select note_id, section, page_first, page_last, regexp_replace(path, '^.*/', '') as name from source_notes),
y as (select *, regexp_matches(name, '^[0-9]{2,3}-.*-น\.[0-9]+-[0-9]+\.md$') as fits, regexp_extract(name, '^([0-9]{2,3})-(.*)-น\.([0-9]+)-([0-9]+)\.md$', ['o', 's', 'a', 'b']) as g from x)
select note_id, 'pattern' as problem from y where not fits
union all select note_id, 'section' from y where fits and g.s <> section
union all select note_id, 'pages' from y where fits and g.a || '-' || g.b <> page_first || '-' || page_last""",
    "note_duplicate_uids": "select note_id, uid, first from (select note_id, uid, min(note_id) over (partition by uid) as first from source_notes where uid is not null) q where note_id > first",
    "note_backward_pages": "select note_id from source_notes where page_first > page_last or pdf_first > pdf_last",
    "note_short_bodies": "select note_id, cast(length(trim(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'))) as int) as chars from source_notes where length(trim(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'))) < 600",
    "note_mixed_widths": r"""with u as (select book_id, uid from source_notes union all select book_id, uid || '0' from source_notes where page_first <= 3)
select book_id, count(distinct length(regexp_extract(uid, '-([0-9]+)$', 1))) as widths from u group by book_id having count(distinct length(regexp_extract(uid, '-([0-9]+)$', 1))) > 1""",
    "note_order_violations": """with x as (select note_id, cast(regexp_extract(uid, '-([0-9]+)$', 1) as int) as n, page_first, lag(cast(regexp_extract(uid, '-([0-9]+)$', 1) as int)) over w as pn, lag(page_first) over w as pp
  from source_notes window w as (partition by book_id order by path, note_id))
select note_id, 'ordinal' as problem from x where n <= pn union all select note_id, 'page' from x where page_first < pp""",
    "note_coverage_gaps": """with x as (select book_id, page_first, max(page_last) over (partition by book_id order by page_first, page_last rows between unbounded preceding and 1 preceding) as reached
  from (select distinct book_id, page_first, page_last from source_notes) q)
select book_id, reached + 1 as gap_from, page_first - 1 as gap_to from x where page_first > reached + 1""",
    "note_fingerprints": f"with {_PRINTS} select * from f",
    "manifest_drift": f"""with {_PRINTS}, l as (select max(struct_pack(snapshot_no := snapshot_no, delivery_no := delivery_no)) as m from index_manifest),
c as (select distinct lower(trim(uid)) as uid, lower(sha256) as sha256 from index_manifest, l where snapshot_no = m.snapshot_no and delivery_no = m.delivery_no)
select coalesce(c.uid, f.uid) as uid, case when c.uid is null then 'new' when f.uid is null then 'removed' else 'changed' end as status
from c full join f on c.uid = f.uid where c.uid is null or f.uid is null or c.sha256 is distinct from f.sha256""",
    "manifest_report": """select snapshot_no, delivery_no, count(*) as rows, count(distinct lower(trim(uid))) as uids, count(*) filter (sha256 is null) as nulls, max(delivered_at) as delivered_at
from index_manifest group by snapshot_no, delivery_no""",
    "books_coverage": """select distinct book_id, 'pages' as missing from source_notes where book_id not in (select book_id from page_records)
union all select distinct book_id, 'notes' from page_records where book_id not in (select book_id from source_notes)""",
}
