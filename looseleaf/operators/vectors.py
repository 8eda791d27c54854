"""Vector search by cosine, merging with graph hits, chunking and rebuilding of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed value: similarity under which a hit doesn't count.
CUT = 0.2


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length or their sizes differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def unit(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): vectors of length one; those without length are left out."""
    x = vectors.select(key, F.transform(vector, lambda e: e.cast("double")).alias("v")).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    return x.where("norm > 0").select(key, F.transform("v", lambda e: e / F.col("norm")).alias("v"))


#: Vectors that one task compares with the queries, on average.
CELL = 20_000


def scores(queries: DataFrame, vectors: DataFrame, cut: float = CUT, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> DataFrame:
    """(query_id, id, score) of every query and vector at or above the cut; exact.

    queries (key, vector) are a stated set that is searched against all vectors. Vectors fall into cells of about CELL by a
    hash and are moved once; queries are copied to every cell, so a task sees the queries against one cell and the number
    of tasks grows with the vectors. Nothing passes through the driver.
    """
    cells = cells or max(8, -(-vectors.count() // CELL))
    q = unit(queries, key, vector).select(F.col(key).alias("query_id"), F.col("v").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"))
    base = unit(vectors, key, vector).select(F.col(key).alias("id"), "v", F.pmod(F.xxhash64(key), F.lit(cells)).cast("int").alias("cell"))
    return base.join(q, "cell").select("query_id", "id", F.round(dot(F.col("v"), F.col("q")), 6).alias("score")).where(F.col("score") >= cut)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, cut: float = CUT, key: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors of each query at or above the cut, ties by id; exact.

    Each task keeps its own k best of each query, as the rank limit works before the second shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores(queries, vectors, cut, key, vector, cells).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_hits(relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, path, place): references of relations, then of chunks, each path once where it was first seen.

    Both sides: (query_id, path, rank).
    """
    both = relations.select("query_id", "path", F.struct(F.lit(0).alias("from"), "rank").alias("at")).unionByName(chunks.select("query_id", "path", F.struct(F.lit(1).alias("from"), "rank").alias("at")))
    first = both.where("path is not null").groupBy("query_id", "path").agg(F.min("at").alias("at"))
    return first.select("query_id", "path", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "path")).alias("place"))


def missing_vectors(ids: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, missing): ids without a vector, and vectors without an id."""
    a, b = ids.select(key).distinct(), vectors.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing", F.lit("vector")).unionByName(b.join(a, key, "left_anti").withColumn("missing", F.lit("id")))


def chunk_tokens(texts: DataFrame, key: str, column: str, size: int = 120, overlap: int = 20) -> DataFrame:
    """(key, chunk, tokens, content): runs of `size` words, each beginning `size - overlap` words after the one before."""
    words = F.filter(F.split(column, r"\s+"), lambda w: w != "")
    x = texts.select(key, words.alias("ws")).where("size(ws) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    at = x.select(key, "ws", F.posexplode(starts).alias("chunk", "at"))
    piece = F.slice("ws", F.col("at") + 1, F.lit(size))
    return at.select(key, "chunk", F.size(piece).alias("tokens"), F.array_join(piece, " ").alias("content"))


def hash_embedding(text: Column, dims: int = 16) -> Column:
    """A deterministic vector of a text: signed counts of words by the first digits of their hash. A stand-in for an embedding model."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int"))
    of = lambda d: F.aggregate(hashed, F.lit(0.0), lambda s, h: s + F.when(h % dims == d, F.when(F.floor(h / dims) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    return F.array(*(of(d) for d in range(dims)))


def rebuild_stats(texts: DataFrame, key: str, column: str) -> DataFrame:
    """One row: texts prepared, vectors rebuilt, skipped as empty, and repeated ids."""
    x = texts.select(key, (F.length(F.trim(F.coalesce(column, F.lit("")))) == 0).alias("empty"))
    return x.agg(
        F.count(F.lit(1)).alias("prepared"), F.sum((~F.col("empty")).cast("bigint")).alias("rebuilt"), F.sum(F.col("empty").cast("bigint")).alias("skipped"), (F.count(key) - F.countDistinct(key)).alias("duplicates")
    )


def token_chunks(texts: DataFrame, key: str, column: str, size: int = 1200, overlap: int = 100) -> DataFrame:
    """(key, chunk, first, tokens): chunks of `size` tokens of the byte-level tokenizer, one for each UTF-8 byte, by their first token."""
    x = texts.select(key, F.octet_length(column).alias("n")).where("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return x.select(key, "n", F.posexplode(starts).alias("chunk", "first")).select(key, "chunk", "first", F.least(F.lit(size), F.col("n") - F.col("first")).alias("tokens"))


def rebuilt(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, id, vector): vectors of entities (id, text), relations (id, text) and chunks (id, text) anew; empty texts are skipped."""
    out = None
    for kind, df in (("entity", entities), ("relation", relations), ("chunk", chunks)):
        x = df.where("trim(text) <> ''").select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), hash_embedding(F.col("text")).alias("vector"))
        out = x if out is None else out.unionByName(x)
    return out
