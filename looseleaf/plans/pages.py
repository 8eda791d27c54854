"""Queries on numbered texts, tables and file names, stores, routed events, contexts of graphs and rebuilt vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from looseleaf.operators import checks as c, corpus, graph as g, vectors as v
from looseleaf.plans import graph as graph_plans
from looseleaf.sources.tables import table

#: Tables that every run needs, and tables that can be derived again.
STORES = {"page_records": "authoritative", "source_notes": "authoritative", "profile_ops": "authoritative", "consultation_turns": "authoritative", "exported_entities": "derived", "index_manifest": "derived", "embeddings": "derived"}
#: Kinds of events that are handled; others are ignored.
HANDLERS = {"view": "message", "click": "message", "purchase": "order", "signup": "follow"}


def numbered_pages(spark, d):
    """Records under a heading of their page and paragraph."""
    x = table(spark, d, "page_records")
    head = F.concat(F.col("page").cast("string"), F.lit("."), F.col("paragraph").cast("string"), F.lit(" "), F.coalesce("book_title", F.lit("-")))
    return x.select("record_id", "book_id", "page", "paragraph", F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


def index_texts(spark, d):
    flat = lambda col: F.regexp_replace(F.coalesce(col, F.lit("-")), r"[\r\n]+", " ")
    n = F.col("page_first").cast("string")
    entry = F.concat(n, F.lit("."), (F.col("note_id") % 50).cast("string"), F.lit(" "), flat("section"))
    return table(spark, d, "source_notes").where("page_first is not null").select("note_id", F.concat(n, F.lit(" "), flat("chapter"), F.lit("\n"), entry).alias("text"))


def captioned_tables(spark, d):
    x = table(spark, d, "health_records").where("symptoms is not null")
    caption = F.when((F.col("record_id") % 2 == 0) & (F.coalesce("chief_complaint", F.lit("")) != ""), F.concat(F.lit("**"), "chief_complaint", F.lit("**\n\n"))).otherwise("")
    rows = F.array_join(F.transform("symptoms", lambda s, i: F.concat(F.lit("\n| "), (i + 1).cast("string"), F.lit(" | "), s, F.lit(" |"))), "")
    return x.select("record_id", F.concat(caption, F.lit("| n | symptom |\n|---|---|"), rows).alias("text"))


def stores(spark, d):
    return c.store_check({name: (kind, table(spark, d, name)) for name, kind in STORES.items()})


def known_nodes(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"))
    return parts.unionByName(table(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("name")))


def relation_lines(spark, d):
    e = graph_plans.edges(spark, d).select("source", "target", F.lit(None).cast("string").alias("keywords"), "weight")
    return g.relation_lines(known_nodes(spark, d), e)


def order_context(spark, d):
    """What an order is about: its parts, then which supplier each came from."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("part"), F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("supplier"), "l_partkey")
    names = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    entities = items.join(names, "l_partkey").select("o_orderkey", F.concat_ws(": ", "part", "p_name").alias("line"))
    every = table(spark, d, "orders").select("o_orderkey", F.lit(None).cast("string").alias("line"))
    return g.graph_context(entities.unionByName(every), items.select("o_orderkey", F.concat_ws(" -> ", "part", "supplier").alias("line")), "o_orderkey")


def landing_variants(spark, d):
    names = table(spark, d, "canonical_terms").select(F.explode(F.array("term", "term_en")).alias("name"))
    return g.landing_with_variants(graph_plans.axis_values(spark, d), names)


def rebuilt_vectors(spark, d):
    e = table(spark, d, "exported_entities").select(F.col("entity_id").alias("id"), F.col("description").alias("text"))
    r = graph_plans.edges(spark, d).select(F.concat_ws("|", "source", "target").alias("id"), F.concat_ws(" ", "source", "target").alias("text"))
    n = table(spark, d, "source_notes").select(F.col("note_id").alias("id"), F.col("body").alias("text"))
    return v.rebuilt(e, r, n).select("kind", "id", F.array_join(F.transform("vector", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


QUERIES = {
    "entity_embeddings": lambda s, d: table(s, d, "exported_entities").select("entity_id", F.array_join(F.transform(v.hash_embedding(F.coalesce("description", F.lit(""))), lambda x: x.cast("int").cast("string")), ",").alias("vector")),
    "headings_parsed": lambda s, d: corpus.heading_parse(numbered_pages(s, d), "record_id", "text"),
    "index_entries": lambda s, d: corpus.index_entries(index_texts(s, d), "note_id", "text"),
    "lines_above_headings": lambda s, d: corpus.line_above(table(s, d, "documents"), "doc_id", "text", "^#"),
    "table_captions": lambda s, d: corpus.table_captions(captioned_tables(s, d), "record_id", "text"),
    "furniture_stripped": lambda s, d: table(s, d, "page_records").select("record_id", corpus.strip_furniture(F.col("text"), F.array("book_title")).alias("text")),
    "names_not_composed": lambda s, d: corpus.names_not_composed(table(s, d, "exported_entities").select(F.col("entity_id").alias("note_id"), F.concat("name", F.lit(".md")).alias("path"))),
    "note_parent_errors": lambda s, d: corpus.parent_errors(table(s, d, "source_notes"), table(s, d, "source_notes").where("book_title is not null")),
    "store_check": stores,
    "event_routing": lambda s, d: c.routed(table(s, d, "events"), "event_type", HANDLERS).select("event_id", "handler"),
    "payload_errors": lambda s, d: c.payload_errors(table(s, d, "events"), "event_id", "props", "k"),
    "count_mismatches": lambda s, d: c.count_mismatches(table(s, d, "exported_entities"), table(s, d, "exported_entities").select("entity_id", F.explode("source_files").alias("f")), "entity_id", "degree"),
    "turns_in_order": lambda s, d: c.in_order(table(s, d, "consultation_turns").where("ts is not null").select("turn_id", "ts"), ["ts", "turn_id"]).select("turn_id", "place"),
    "relation_lines": relation_lines,
    "graph_context": order_context,
    "entity_sources": lambda s, d: g.source_rows(graph_plans.entity_files(s, d), ["name"]),
    "relation_sources": lambda s, d: g.source_rows(graph_plans.mentions(s, d), ["source", "target"], "file"),
    "landing_variants": landing_variants,
    "token_chunks": lambda s, d: v.token_chunks(table(s, d, "documents"), "doc_id", "text"),
    "vectors_rebuilt": rebuilt_vectors,
}

_LINES = r"string_split_regex(regexp_replace({}, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r')"
_HEADING = r"'^([0-9]{1,4})\.([0-9]{1,6})[ \t]+(\S.*?)\s*$'"
_NUMBER = r"'(?m)^[ \t]*(?:[-–—][ \t]*)?[0-9๐-๙]{1,4}(?:[ \t]*[-–—])?[ \t]*\r?$\n?'"
_WORDS = r"list_filter(string_split_regex(lower({}), '[ \t\n\f\r\v]+'), lambda w: w <> '')"
VECTOR = "array_to_string(list_transform(range(16), lambda d: cast(coalesce(list_sum(list_transform({}, lambda h: case when h % 16 = d then (case when (h // 16) % 2 = 0 then 1 else -1 end) else 0 end)), 0) as int)), ',')"
_HASHES = "list_transform({}, lambda w: cast('0x' || substr(md5(w), 1, 6) as int))"


def vector_sql(text: str) -> str:
    return VECTOR.format(_HASHES.format(_WORDS.format(text)))


SQL = {
    "entity_embeddings": f"select entity_id, {vector_sql("coalesce(description, '')")} as vector from exported_entities",
    "headings_parsed": rf"""with x as (select record_id, {_LINES.format("page || '.' || paragraph || ' ' || coalesce(book_title, '-') || chr(10) || coalesce(text, '')")} as ls from page_records),
l as (select record_id, unnest(ls) as l, generate_subscripts(ls, 1) - 1 as line from x)
select record_id, cast(line as int) as line, cast(regexp_extract(l, {_HEADING}, 1) as int) as major, cast(regexp_extract(l, {_HEADING}, 2) as int) as minor, regexp_extract(l, {_HEADING}, 3) as title from l where regexp_matches(l, {_HEADING})""",
    "index_entries": r"""with n as (select note_id, page_first as g, cast(note_id % 50 as int) as nth, regexp_replace(coalesce(chapter, '-'), '[\r\n]+', ' ', 'g') as c, regexp_replace(coalesce(section, '-'), '[\r\n]+', ' ', 'g') as s from source_notes where page_first is not null)
select note_id, g as "group", case when regexp_matches(c, '^[ \t]*\S') then trim(regexp_replace(regexp_replace(c, '^[ \t]+', ''), '\s+', ' ', 'g'), ' ') end as group_title, nth, token
from (select *, unnest(list_filter(list_transform(string_split_regex(regexp_replace(s, '^[ \t]+', ''), '[,;]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: x <> '')) as token from n) q""",
    "lines_above_headings": rf"""with x as (select doc_id, {_LINES.format('text')} as ls from documents), l as (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) - 1 as line from x),
a as (select *, lag(l) over (partition by doc_id order by line) as above from l where trim(l, ' ') <> '')
select doc_id, cast(line as int) as line, above from a where starts_with(l, '#')""",
    "table_captions": """with x as (select record_id, chief_complaint, record_id % 2 = 0 and coalesce(chief_complaint, '') <> '' as cap from health_records where symptoms is not null)
select record_id, cast(case when cap then 2 else 0 end as int) as line, case when cap then chief_complaint end as caption from x""",
    "furniture_stripped": rf"""with x as (select record_id, book_title, {_LINES.format(f"regexp_replace(text, {_NUMBER}, '', 'g')")} as ls from page_records),
y as (select *, list_max(list_transform(ls, lambda l, i: case when trim(regexp_replace(l, '\s+', ' ', 'g'), ' ') = '' or coalesce(trim(l, ' ') = book_title, false) then 0 else i end)) as last from x)
select record_id, array_to_string(ls[1:last], chr(10)) as text from y""",
    "names_not_composed": """with n as (select entity_id as note_id, regexp_replace(name || '.md', '^.*/', '') as name from exported_entities) select note_id, name from n where name <> nfc_normalize(name)""",
    "note_parent_errors": """select note_id, 'folder' as problem from source_notes where book_id is distinct from regexp_extract(path, '([^/]*)/[^/]*$', 1)
union all select note_id, 'book' from source_notes where book_id not in (select book_id from source_notes where book_title is not null)""",
    "store_check": " union all ".join(f"select '{n}' as store, '{k}' as kind, count(*) as rows, case when count(*) > 0 then 'ok' else 'empty' end as status from {n}" for n, k in STORES.items()),
    "event_routing": f"""select event_id, case event_type {' '.join(f"when '{k}' then '{h}'" for k, h in HANDLERS.items())} end as handler from events where event_type in ({', '.join(f"'{k}'" for k in HANDLERS)})""",
    "payload_errors": """select event_id, case when props is null or not json_valid(props) or json_type(props) <> 'OBJECT' then 'malformed' when json_extract(props, '$.k') is null then 'incomplete' end as problem from events
where props is null or not json_valid(props) or json_type(props) <> 'OBJECT' or json_extract(props, '$.k') is null""",
    "count_mismatches": "select entity_id, cast(degree as bigint) as expected, cast(coalesce(len(source_files), 0) as bigint) as found from exported_entities where degree is distinct from coalesce(len(source_files), 0)",
    "turns_in_order": "select turn_id, row_number() over (order by ts, turn_id) as place from consultation_turns where ts is not null",
    "relation_lines": f"""with {graph_plans._EDGES}, k as (select 'part-' || p_partkey as name from part union all select 'supplier-' || s_suppkey from supplier where s_acctbal > 0),
b as (select source as name, target as other, weight from e union all select target, source, weight from e)
select b.name, other, '- ' || case when other in (select name from k) then '[[' || other || ']]' else other end || ' (; ' || weight || ')' as line from b where b.name in (select name from k)""",
    "entity_sources": """with f as (select distinct name, unnest(source_files) as source from exported_entities where name is not null)
select name, row_number() over (partition by name order by source) as nth, source from f where source is not null""",
    "relation_sources": f"with {graph_plans._MENTIONS}, f as (select distinct source, target, file from m) select source, target, row_number() over (partition by source, target order by file) as nth, file from f",
    "graph_context": """with x as (select distinct l_orderkey as o_orderkey, 0 as part, 'part-' || l_partkey || ': ' || p_name as line from lineitem join part on p_partkey = l_partkey
union select l_orderkey, 1, 'part-' || l_partkey || ' -> ' || 'supplier-' || l_suppkey from lineitem)
select o_orderkey, string_agg(line, chr(10) order by part, line) as block from orders left join x using (o_orderkey) group by o_orderkey
union all select o_orderkey, string_agg(line, chr(10) order by part, line) from x where o_orderkey not in (select o_orderkey from orders) group by o_orderkey""",
    "token_chunks": """with x as (select doc_id, octet_length(encode(text)) as n from documents where text <> ''),
s as (select doc_id, n, unnest(generate_series(0, greatest(n - 101, 0), 1100)) as first from x)
select doc_id, cast(first / 1100 as int) as chunk, cast(first as int) as first, cast(least(1200, n - first) as int) as tokens from s""",
    "vectors_rebuilt": f"""with {graph_plans._EDGES}, t as (select 'entity' as kind, cast(entity_id as varchar) as id, description as text from exported_entities
union all select 'relation', source || '|' || target, source || ' ' || target from e union all select 'chunk', cast(note_id as varchar), body from source_notes)
select kind, id, {vector_sql('text')} as vector from t where trim(text, ' ') <> ''""",
}
