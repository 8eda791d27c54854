"""Queries on entity graphs, vectors, replies and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from looseleaf.operators import budget, evaluation as e, graph as g, replies as r, vectors as v
from looseleaf.sources.tables import table


def nodes(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_type").alias("type"), F.col("p_name").alias("description"))
    sup = table(spark, d, "supplier").select(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("name"), F.lit(None).cast("string").alias("type"), F.col("s_name").alias("description"))
    return parts.unionByName(sup)


def mentions(spark, d):
    """Part and supplier of each line item, named by its order."""
    x = table(spark, d, "lineitem").select(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("b"), F.col("l_orderkey").cast("string").alias("file"), "l_quantity")
    return g.canonical_pairs(x, "a", "b")


def edges(spark, d):
    return mentions(spark, d).groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"), F.sum("l_quantity").alias("quantity"))


def entity_files(spark, d):
    return table(spark, d, "exported_entities").where("name is not null").select("name", F.explode("source_files").alias("source"))


def relation_files(spark, d):
    return g.provenance(mentions(spark, d), ["source", "target"], "file")


def axis_values(spark, d):
    x = table(spark, d, "tongue_descriptions")
    return x.select(F.explode(F.array(F.struct(F.lit("color").alias("axis"), F.col("color").alias("value")), F.struct(F.lit("coating").alias("axis"), F.col("coating").alias("value")))).alias("x")).select("x.*")


def outcomes(spark, d):
    terms = table(spark, d, "canonical_terms").select(F.explode(F.array("term", "term_en")).alias("name"))
    return g.landing(axis_values(spark, d), terms)


def hits(spark, d, k=20):
    x = table(spark, d, "embeddings")
    return v.top_k(x.where("vec_id % 100 = 0"), x, k)


def above_cut(spark, d):
    x = table(spark, d, "embeddings")
    return v.scores(x.where("vec_id % 100 = 0"), x)


def references(spark, d):
    """Hits of even labels stand for relations, of odd ones for chunks; both name the class of their vector."""
    x = hits(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    path = F.concat(F.lit("note-"), (F.col("id") % 37).cast("string"), F.lit(".md"))
    rel = x.where("label % 2 = 0").select("query_id", path.alias("path"), "rank")
    chunk = x.where("label % 2 = 1").select("query_id", path.alias("path"), "rank")
    return v.merge_hits(rel, chunk)


def ranked_documents(spark, d, k=60):
    """The documents that the nearest vectors of each query stand for: the ranked candidates of one query, k at most."""
    docs = table(spark, d, "documents").where("title is not null").select(F.col("doc_id").alias("id"), "title", "text")
    return hits(spark, d, k).join(docs, "id")


def sections(spark, d):
    ranked = ranked_documents(spark, d)
    chunks = v.chunk_tokens(ranked.select("id", "text").distinct(), "id", "text", 1200, 0).where("chunk = 0").select("id", F.col("content").alias("chunk"))
    x = ranked.join(chunks, "id", "left").select("query_id", "rank", F.col("title").alias("name"), F.col("text").alias("note"), "chunk")
    return budget.pack_sections(x, "query_id", 5000)


def context_blocks(spark, d):
    named = table(spark, d, "exported_entities").where("description <> ''").select(F.col("entity_id").alias("id"), F.concat_ws(": ", "name", "description").alias("line"))
    x = hits(spark, d, 60).join(named, "id").withColumn("cost", F.length("line"))
    kept = budget.keep_within(x, "query_id", "rank", F.col("cost"), 2000, "line")
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda l: l["line"]), "\n").alias("block"), F.count(F.lit(1)).alias("lines"))


def advised(spark, d):
    """Advisor turns as replies that cite notes by number, some with a menu or a citation line."""
    i = F.col("turn_id")
    text = F.concat("text", F.lit(" ["), (i % 7 + 1).cast("string"), F.lit("][" ), (i % 11 + 1).cast("string"), F.lit("][" ), (i % 5000 + 100).cast("string"), F.lit("]"))
    menu = F.when(i % 2 == 0, F.concat(F.lit("\n[หัวข้อ]:\n- "), F.substring("text", 1, 30), F.lit("\n2) "), "role", F.lit("\n\n(อ้างอิง: x)\n* "), F.substring("text", 5, 8))).otherwise("")
    cite = F.when(i % 3 == 0, F.lit("\n(อ้างอิง: ก น. 1-2)\n")).otherwise("")
    x = table(spark, d, "consultation_turns").where("role = 'advisor' and text is not null")
    return x.select(i.alias("reply_id"), F.concat(text, cite).alias("cited"), F.concat(text, menu).alias("with_menu"))


def cited(spark, d):
    return advised(spark, d).select("reply_id", F.explode(r.cited_ids(F.col("cited"))).alias("id"))


def passages(spark, d):
    """Notes by id; ids of notes are of 64 bits, cited ones of 32."""
    return table(spark, d, "source_notes").select(F.col("note_id").alias("id"), "book_id", F.col("page_first").alias("first"), F.col("page_last").alias("last"))


def titles(spark, d):
    return table(spark, d, "source_notes").groupBy("book_id").agg(F.min("book_title").alias("title"))


def recalls(spark, d):
    q = table(spark, d, "eval_items").select("qid", "hops", "expects")
    docs = table(spark, d, "documents").where("title is not null").select(F.col("title").alias("section"), "doc_kind").distinct()
    found = q.select("qid", F.explode("expects").alias("section")).join(docs, "section")
    mix = found.select("qid", F.lit("mix").alias("mode"), "section")
    naive = found.where("doc_kind = 'source_note'").select("qid", F.lit("naive").alias("mode"), "section")
    return e.section_recall(q, mix.unionByName(naive), ["mix", "naive"])


QUERIES = {
    "entity_provenance": lambda s, d: g.provenance(entity_files(s, d), ["name"]),
    "relation_provenance": relation_files,
    "graph_entities": lambda s, d: g.export_entities(nodes(s, d), edges(s, d)),
    "graph_relations": edges,
    "graph_degree_top25": lambda s, d: g.top_by_degree(g.export_entities(nodes(s, d), edges(s, d)), 25),
    "graph_isolated": lambda s, d: g.isolated(nodes(s, d), mentions(s, d)),
    "graph_type_counts": lambda s, d: g.type_counts(nodes(s, d)),
    "graph_summary": lambda s, d: g.summary(nodes(s, d), edges(s, d)),
    "graph_adjacency": lambda s, d: g.adjacency(mentions(s, d)),
    "stem_collisions": lambda s, d: g.stem_collisions(table(s, d, "exported_entities").select(F.explode(F.array(F.col("name"), F.replace("name", F.lit(" "), F.lit("/")), F.replace("name", F.lit(" "), F.lit("_")))).alias("name"))),
    "concept_notes": lambda s, d: g.concept_notes(table(s, d, "exported_entities").select("entity_id", "name", F.col("entity_type").alias("type"), "description", "degree", "source_files")),
    "near_names": lambda s, d: g.near_names(table(s, d, "exported_entities")),
    "landing_outcomes": outcomes,
    "landing_rates": lambda s, d: g.landing_rates(outcomes(s, d)),
    "vector_top20": hits,
    "vector_above_cut": lambda s, d: above_cut(s, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best")),
    "vector_references": references,
    "vector_drift": lambda s, d: v.missing_vectors(table(s, d, "exported_entities").select(F.col("entity_id").alias("vec_id")), table(s, d, "embeddings"), "vec_id"),
    "vector_rebuild": lambda s, d: v.rebuild_stats(table(s, d, "exported_entities"), "entity_id", "description"),
    "chunks": lambda s, d: v.chunk_tokens(table(s, d, "documents"), "doc_id", "text"),
    "line_budget": lambda s, d: budget.keep_within(ranked_documents(s, d), "query_id", "rank", F.length("title"), 400, "title"),
    "section_budget": sections,
    "context_blocks": context_blocks,
    "cited_ids": cited,
    "invented_ids": lambda s, d: r.invented(cited(s, d), passages(s, d)),
    "citations": lambda s, d: r.resolve(cited(s, d), passages(s, d), titles(s, d)),
    "citation_split": lambda s, d: advised(s, d).select("reply_id", r.split_citation(F.col("cited")).alias("x")).select("reply_id", "x.body", "x.citation"),
    "topic_menus": lambda s, d: advised(s, d).select("reply_id", r.topic_menu(F.col("with_menu")).alias("x")).select("reply_id", "x.visible", F.array_join("x.topics", "|").alias("topics")),
    "section_recall": recalls,
    "recall_verdict": lambda s, d: e.verdict(recalls(s, d)),
    "recall_wins": lambda s, d: e.wins(recalls(s, d), "mix", "naive"),
}

_NODES = """n as (select 'part-' || p_partkey as name, p_type as type, p_name as description from part union all select 'supplier-' || s_suppkey, null, s_name from supplier)"""
_MENTIONS = """m as (select least('part-' || l_partkey, 'supplier-' || l_suppkey) as source, greatest('part-' || l_partkey, 'supplier-' || l_suppkey) as target, cast(l_orderkey as varchar) as file, l_quantity from lineitem)"""
_EDGES = f"{_MENTIONS}, e as (select source, target, count(*) as weight, sum(l_quantity) as quantity from m group by source, target)"
_ENTITIES = f"""{_NODES}, {_EDGES}, d as (select name, count(*) as degree from (select source as name from e union all select target from e) q group by name),
x as (select n.name, coalesce(type, 'UNKNOWN') as type, coalesce(description, '') as description, coalesce(degree, 0) as degree from n left join d using (name))"""
_SQUEEZE = r"lower(regexp_replace({}, '[ \t\n\f\r\v]+', '', 'g'))"
_OUTCOMES = f"""k as (select distinct {_SQUEEZE.format('name')} as s from (select term as name from canonical_terms union all select term_en from canonical_terms) q where {_SQUEEZE.format('name')} <> ''),
v as (select distinct axis, value, {_SQUEEZE.format('value')} as s from (select 'color' as axis, color as value from tongue_descriptions union all select 'coating', coating from tongue_descriptions) q where value is not null),
o as (select axis, value, case when s in (select s from k) then 'exact' when s <> '' and exists (select 1 from k where contains(v.s, k.s) or contains(k.s, v.s)) then 'substring' else 'miss' end as outcome from v)"""
_HITS = """a as (select vec_id, label, cast(embedding as double[]) as v, sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) as n from embeddings),
p as (select q.vec_id as query_id, b.vec_id as id, b.label, round(list_dot_product(list_transform(b.v, lambda z: z / b.n), list_transform(q.v, lambda z: z / q.n)), 6) as score from a q, a b where q.vec_id % 100 = 0),
h as (select query_id, id, label, score, cast(row_number() over (partition by query_id order by score desc, id) as int) as rank from p where score >= 0.2)"""
_CITED = """t as (select turn_id as reply_id, text || ' [' || (turn_id % 7 + 1) || '][' || (turn_id % 11 + 1) || '][' || (turn_id % 5000 + 100) || ']' as base, turn_id, role, text as raw from consultation_turns where role = 'advisor' and text is not null),
c as (select reply_id, base || case when turn_id % 3 = 0 then chr(10) || '(อ้างอิง: ก น. 1-2)' || chr(10) else '' end as cited from t),
i as (select distinct reply_id, cast(unnest(regexp_extract_all(cited, '\\[([0-9]+)\\]', 1)) as int) as id from c)""".replace("\\\\", "\\")
_RECALLS = """q as (select qid, hops, list_distinct(expects) as expects from eval_items), f as (select qid, unnest(expects) as section from q),
s as (select title, bool_or(doc_kind = 'source_note') as own from documents where title is not null group by title),
g as (select qid, 'mix' as mode, section from f join s on section = title union all select qid, 'naive', section from f join s on section = title where own),
r as (select q.qid, m.mode, hops, coalesce(string_agg(section, '; ' order by section), '') as found, round(count(section) / max(len(expects)), 6) as recall
      from q cross join (values ('mix'), ('naive')) m(mode) left join g on g.qid = q.qid and g.mode = m.mode group by q.qid, m.mode, hops)"""

SQL = {
    "entity_provenance": """with f as (select distinct name, unnest(source_files) as source from exported_entities where name is not null)
select name, string_agg(source, ',' order by source) as sources, cast(count(*) as int) as n from f where source is not null group by name""",
    "relation_provenance": f"with {_MENTIONS}, f as (select distinct source, target, file from m) select source, target, string_agg(file, ',' order by file) as sources, cast(count(*) as int) as n from f group by source, target",
    "graph_entities": f"with {_ENTITIES} select * from x",
    "graph_relations": f"with {_EDGES} select * from e",
    "graph_degree_top25": f"with {_ENTITIES} select name, degree from x order by degree desc, name limit 25",
    "graph_isolated": f"with {_NODES}, {_MENTIONS} select name from n where name not in (select source from m) and name not in (select target from m)",
    "graph_type_counts": f"with {_NODES} select coalesce(type, 'UNKNOWN') as type, count(*) as n from n group by 1",
    "graph_summary": f"""with {_ENTITIES} select count(*) as nodes, (select count(*) from e) as edges, count(*) filter (degree = 0) as isolated, round((select count(*) from e) / count(*), 2) as ratio from x""",
    "graph_adjacency": f"with {_MENTIONS} select source as name, target as other from m union select target, source from m",
    "stem_collisions": """with x as (select distinct n as name, translate(n, '/\\:*?"<>|', '_________') as stem from (select unnest([name, replace(name, ' ', '/'), replace(name, ' ', '_')]) as n from exported_entities) q where n is not null)
select stem, count(*) as names from x group by stem having count(*) > 1""",
    "concept_notes": r"""with x as (select *, translate(name, '/\:*?"<>|', '_________') as stem, '"' || replace(replace(name, '\', '\\'), '"', '\"') || '"' as quoted,
  (select string_agg('- [[' || regexp_replace(regexp_replace(f, '^.*/', ''), '\.md$', '') || ']]', chr(10) order by f) from (select distinct unnest(source_files) as f) q) as files from exported_entities where name is not null)
select entity_id, stem || '.md' as filename, '---' || chr(10) || 'entity: ' || quoted || chr(10) || 'type: "' || coalesce(entity_type, 'UNKNOWN') || '"' || chr(10) || 'degree: ' || degree || chr(10) || 'generated: true' || chr(10)
  || 'aliases: [' || case when stem = name then '' else quoted end || ']' || chr(10) || '---' || chr(10) || chr(10) || coalesce(description, '')
  || case when files is null then '' else chr(10) || chr(10) || '## Sources' || chr(10) || files end as content from x""",
    "landing_outcomes": f"with {_OUTCOMES} select * from o",
    "landing_rates": f"""with {_OUTCOMES}, c as (select axis, count(*) filter (outcome = 'exact') as exact, count(*) filter (outcome = 'substring') as substring, count(*) filter (outcome = 'miss') as miss from o group by axis)
select *, round((exact + substring) / (exact + substring + miss), 6) as rate from c""",
    "vector_top20": f"with {_HITS} select query_id, id, score, rank from h where rank <= 20",
    "vector_above_cut": f"with {_HITS} select query_id, count(*) as hits, max(score) as best from h group by query_id",
    "vector_references": f"""with {_HITS}, b as (select query_id, 'note-' || (id % 37) || '.md' as path, label % 2 as kind, rank from h where rank <= 20),
f as (select query_id, path, min(kind * 1000 + rank) as seen from b group by query_id, path)
select query_id, path, cast(row_number() over (partition by query_id order by seen, path) as int) as place from f""",
    "vector_drift": """select distinct entity_id as vec_id, 'vector' as missing from exported_entities where entity_id not in (select vec_id from embeddings)
union all select distinct vec_id, 'id' from embeddings where vec_id not in (select entity_id from exported_entities)""",
    "vector_rebuild": """select count(*) as prepared, count(*) filter (length(trim(coalesce(description, ''), ' ')) > 0) as rebuilt, count(*) filter (length(trim(coalesce(description, ''), ' ')) = 0) as skipped,
  count(entity_id) - count(distinct entity_id) as duplicates from exported_entities""",
    "chunks": r"""with w as (select doc_id, list_filter(string_split_regex(text, '[ \t\n\f\r\v]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, ws, unnest(generate_series(0, greatest(len(ws) - 21, 0), 100)) as pos from w where len(ws) > 0)
select doc_id, cast(pos / 100 as int) as chunk, cast(len(ws[pos + 1:pos + 120]) as int) as tokens, array_to_string(ws[pos + 1:pos + 120], ' ') as content from s""",
    "line_budget": f"""with recursive {_HITS},
x as (select query_id, rank, title, length(title) as cost, row_number() over (partition by query_id order by rank) as n from h join documents on doc_id = id where rank <= 60 and title is not null),
f(query_id, n, rank, title, used, place, kept) as (
  select query_id, n, rank, title, case when cost <= 400 then cost else 0 end, case when cost <= 400 then 1 else 0 end, cost <= 400 from x where n = 1
  union all
  select x.query_id, x.n, x.rank, x.title, case when f.used + x.cost <= 400 then f.used + x.cost else f.used end, case when f.used + x.cost <= 400 then f.place + 1 else f.place end, f.used + x.cost <= 400
  from f join x on x.query_id = f.query_id and x.n = f.n + 1)
select query_id, cast(rank as bigint) as rank, cast(place as int) as place, title from f where kept""",
    "section_budget": f"""with recursive {_HITS},
x as (select query_id, title, length(text) as nl, length(array_to_string(list_slice(list_filter(string_split_regex(text, '[ \t\n\f\r\v]+'), lambda z: z <> ''), 1, 1200), ' ')) as cl, row_number() over (partition by query_id order by rank) as n from h join documents on doc_id = id where rank <= 60 and title is not null),
f(query_id, n, used, place, label, whole, kept) as (
  select query_id, n - 1, 0, 0, '', false, false from x where n = 1
  union all
  select x.query_id, x.n,
    case when f.used + length('[' || (f.place + 1) || '] ' || x.title) + 1 + x.nl <= 5000 then f.used + length('[' || (f.place + 1) || '] ' || x.title) + 1 + x.nl
         when f.used + length('[' || (f.place + 1) || '] ' || x.title) + 1 + x.cl <= 5000 then f.used + length('[' || (f.place + 1) || '] ' || x.title) + 1 + x.cl else f.used end,
    case when f.used + length('[' || (f.place + 1) || '] ' || x.title) + 1 + x.cl <= 5000 then f.place + 1 else f.place end,
    '[' || (f.place + 1) || '] ' || x.title,
    f.used + length('[' || (f.place + 1) || '] ' || x.title) + 1 + x.nl <= 5000,
    f.used + length('[' || (f.place + 1) || '] ' || x.title) + 1 + x.cl <= 5000
  from f join x on x.query_id = f.query_id and x.n = f.n + 1)
select query_id, cast(place as int) as place, label, whole from f where kept""",
    "context_blocks": f"""with recursive {_HITS},
x as (select query_id, rank, concat_ws(': ', name, description) as line, length(concat_ws(': ', name, description)) as cost, row_number() over (partition by query_id order by rank) as n
  from h join exported_entities on entity_id = id where rank <= 60 and description <> ''),
f(query_id, n, line, used, kept) as (
  select query_id, n, line, case when cost <= 2000 then cost else 0 end, cost <= 2000 from x where n = 1
  union all
  select x.query_id, x.n, x.line, case when f.used + x.cost <= 2000 then f.used + x.cost else f.used end, f.used + x.cost <= 2000 from f join x on x.query_id = f.query_id and x.n = f.n + 1)
select query_id, string_agg(line, chr(10) order by n) as block, count(*) as lines from f where kept group by query_id""",
    "cited_ids": f"with {_CITED} select reply_id, id from i",
    "invented_ids": f"with {_CITED} select id, reply_id from i where id not in (select note_id from source_notes)",
    "citations": f"""with {_CITED}, p as (select note_id as id, book_id, page_first as first, page_last as last from source_notes),
b as (select book_id, min(book_title) as title from source_notes group by book_id),
x as (select reply_id, i.id, coalesce(title, book_id) as title, case when first = last then cast(first as varchar) else first || '-' || last end as pg from i join p on p.id = i.id left join b using (book_id)),
y as (select reply_id, title, min(id) as seen, string_agg(pg, ', ' order by id) as ps from x group by reply_id, title),
z as (select *, row_number() over (partition by reply_id order by seen, title) as nth from y)
select reply_id, string_agg(title || ' p. ' || ps, '; ' order by nth) as citation from z where nth <= 3 group by reply_id""",
    "citation_split": f"""with {_CITED} select c.reply_id, case when t.turn_id % 3 = 0 then trim(base, ' ') else base end as body, case when t.turn_id % 3 = 0 then 'ก น. 1-2' end as citation from c join t using (reply_id)""",
    "topic_menus": f"""with {_CITED} select reply_id, base as visible, case when turn_id % 2 = 0 then array_to_string(list_filter([trim(substr(trim(substr(raw, 1, 30), ' '), 1, 20), '~'), role, trim(substr(trim(substr(raw, 5, 8), ' '), 1, 20), '~')], lambda x: x <> ''), '|') else '' end as topics from t""",
    "section_recall": f"with {_RECALLS} select * from r",
    "recall_verdict": f"with {_RECALLS} select mode, count(*) as questions, round(avg(recall), 6) as mean, round(avg(recall) filter (hops > 1), 6) as mean_multi from r group by mode",
    "recall_wins": f"""with {_RECALLS}, w as (select qid, max(recall) filter (mode = 'mix') as a, max(recall) filter (mode = 'naive') as b from r group by qid)
select case when a > b then 'mix' when a < b then 'naive' else 'tie' end as outcome, count(*) as n from w group by 1""",
}
