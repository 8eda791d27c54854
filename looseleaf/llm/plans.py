"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from looseleaf.llm.canonical import map_cells
from looseleaf.llm.contamination import find_leaks
from looseleaf.llm.encoding import damaged
from looseleaf.llm.packing import byte_tokens, pack_all
from looseleaf.llm.personal import mention_rows, redact
from looseleaf.llm.plain_form import cells, not_plain, plain_forms
from looseleaf.llm.scan_noise import noise_kinds, repaired
from looseleaf.sources.tables import table


def named(spark, d):
    return cells({"source_notes": (table(spark, d, "source_notes"), "note_id", ["section", "chapter"]), "exported_entities": (table(spark, d, "exported_entities"), "entity_id", ["name"])})


def p5_found(spark, d):
    return not_plain(named(spark, d))


def p5_plain(spark, d):
    return plain_forms(named(spark, d))


def scanned(spark, d):
    """Texts from scans of both tables, in the form that the operator takes."""
    pages, notes = table(spark, d, "page_records"), table(spark, d, "source_notes")
    first = pages.select(
        F.lit("page_records").alias("src"), F.col("record_id").alias("row_id"), F.col("book_id").alias("book"), F.col("page").alias("first"), F.col("page").alias("last"), F.array("book_title").alias("titles"), "text"
    )
    second = notes.select(
        F.lit("source_notes").alias("src"),
        F.col("note_id").alias("row_id"),
        F.col("book_id").alias("book"),
        F.col("page_first").alias("first"),
        F.col("page_last").alias("last"),
        F.array("book_title", "chapter").alias("titles"),
        F.col("body").alias("text"),
    )
    return first.unionByName(second)


def p1_found(spark, d):
    return noise_kinds(scanned(spark, d))


def p1_repaired(spark, d):
    return repaired(scanned(spark, d))


def p3_found(spark, d):
    typed = cells({"tongue_descriptions": (table(spark, d, "tongue_descriptions"), "row_no", ["color", "coating"]), "exported_entities": (table(spark, d, "exported_entities"), "entity_id", ["name"])})
    axis = F.when(F.col("field") == "name", "entity").otherwise(F.col("field"))
    return map_cells(typed.withColumn("axis", axis), table(spark, d, "canonical_terms"))


def private(spark, d):
    return cells(
        {
            "consultation_turns": (table(spark, d, "consultation_turns"), "turn_id", ["text"]),
            "health_records": (table(spark, d, "health_records"), "record_id", ["conversation_summary"]),
            "profile_ops": (table(spark, d, "profile_ops"), "delivery_id", ["text"]),
        }
    )


def p6_found(spark, d):
    return mention_rows(private(spark, d))


def p6_redacted(spark, d):
    return redact(private(spark, d), "value")


def p7_packed(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("id"), byte_tokens(F.col("text")).alias("size"))
    return pack_all(docs, table(spark, d, "pack_sizes")).withColumnRenamed("id", "doc_id")


def p7_loads(spark, d):
    """What is packed for each capacity: documents, parts and tokens, and whether no container is over it."""
    each = p7_packed(spark, d).groupBy("capacity", "container").agg(F.sum("size").alias("load"), F.count(F.lit(1)).alias("parts"), F.sum((F.col("part") == 0).cast("bigint")).alias("documents"))
    return each.groupBy("capacity").agg(F.sum("documents").alias("documents"), F.sum("parts").alias("parts"), F.sum("load").alias("tokens"), (F.max("load") <= F.col("capacity")).alias("fits"))


def p8_found(spark, d):
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_spans(spark, d):
    found = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.select("doc_id", "item_id", F.round("cover", 3).alias("cover"), F.to_json("spans").alias("spans"))


def p9_found(spark, d):
    return damaged(table(spark, d, "documents")).select("doc_id").distinct()


def p9_restored(spark, d):
    return damaged(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p3_found, p5_found, p5_plain, p6_found, p6_redacted, p7_packed, p7_loads, p8_found, p8_spans, p9_found, p9_restored)}
SQL = {
    "p7_loads": """with d as (select octet_length(encode(text)) + 1 as n from documents where text is not null)
select capacity, count(*) as documents, cast(sum(ceil(n / capacity)) as bigint) as parts, cast(sum(n) as bigint) as tokens, true as fits from pack_sizes cross join d group by capacity""",
}
