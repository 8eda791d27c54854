"""Entity graphs: provenance, degrees, adjacency, statistics, notes for concepts and name checks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from looseleaf.functions import text as t
from looseleaf.operators.blocks import ranged, with_running_sum

#: Fixed value: similarity from which two names count as near duplicates.
NEAR = 0.82
#: Fixed value: letters of pairs of names that are compared at once.
BATCH = 1 << 18


def provenance(mentions: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """(keys, sources, n): the distinct sources of each entity or relation in order, joined by commas, and their number."""
    files = mentions.where(F.col(source).isNotNull()).select(*keys, source).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(source)).alias("fs"))
    return files.select(*keys, F.array_join("fs", ",").alias("sources"), F.size("fs").alias("n"))


def source_rows(mentions: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """(keys, nth, source): the distinct sources of each entity or relation as rows, numbered in order.

    For names with any number of sources: no array holds them all, and the numbers are made in blocks.
    """
    x = ranged(mentions.where(F.col(source).isNotNull()).select(*keys, source).dropna(subset=keys).distinct(), keys, [source])
    return with_running_sum(x, keys, [source], F.lit(1), F.col("_range"), "nth").select(*keys, "nth", source)


def canonical_pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    """edges with source and target, the lesser end first; loops are left out."""
    return edges.where(F.col(a) != F.col(b)).withColumn("source", F.least(a, b)).withColumn("target", F.greatest(a, b))


def degrees(edges: DataFrame) -> DataFrame:
    """(name, degree) over both ends of edges (source, target)."""
    return edges.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("degree"))


def export_entities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, type, description, degree): nodes with their degree, 0 if isolated, and defaults for what is missing."""
    n = nodes.select("name", F.coalesce("type", F.lit("UNKNOWN")).alias("type"), F.coalesce("description", F.lit("")).alias("description"))
    return n.join(degrees(edges), "name", "left").fillna(0, ["degree"])


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("name"))
    return nodes.select("name").join(ends, "name", "left_anti")


def top_by_degree(entities: DataFrame, k: int) -> DataFrame:
    return entities.select("name", "degree").orderBy(F.desc("degree"), "name").limit(k)


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.coalesce("type", F.lit("UNKNOWN")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated nodes, edges for each node rounded to two places (0 without nodes)."""
    one, none = F.lit(1), F.lit(0)
    marks = lambda df, n, e, i: df.select(n.alias("n"), e.alias("e"), i.alias("i"))
    rows = marks(nodes, one, none, none).unionByName(marks(edges, none, one, none)).unionByName(marks(isolated(nodes, edges), none, none, one))
    x = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(to) for c, to in (("n", "nodes"), ("e", "edges"), ("i", "isolated"))))
    return x.withColumn("ratio", F.when(F.col("nodes") > 0, F.round(F.col("edges") / F.col("nodes"), 2)).otherwise(0.0))


def adjacency(edges: DataFrame) -> DataFrame:
    """(name, other) of both directions of each edge, once."""
    ab, ba = edges.select(F.col("source").alias("name"), F.col("target").alias("other")), edges.select(F.col("target").alias("name"), F.col("source").alias("other"))
    return ab.unionByName(ba).distinct()


def stem_collisions(names: DataFrame) -> DataFrame:
    """(stem, names): different names that give one file name."""
    return names.where("name is not null").groupBy(t.safe_name(F.col("name")).alias("stem")).agg(F.countDistinct("name").alias("names")).where("names > 1")


def concept_notes(entities: DataFrame) -> DataFrame:
    """(entity_id, filename, content) of entities (entity_id, name, type, description, degree, source_files)."""
    stem = t.safe_name(F.col("name"))
    aliases = F.when(stem == F.col("name"), "").otherwise(t.yaml_scalar(F.col("name")))
    head = F.concat(
        F.lit("---\nentity: "), t.yaml_scalar(F.col("name")), F.lit("\ntype: "), t.yaml_scalar(F.coalesce("type", F.lit("UNKNOWN"))), F.lit("\ndegree: "), F.col("degree").cast("string"), F.lit("\ngenerated: true\naliases: ["), aliases, F.lit("]\n---\n")
    )
    files = F.array_join(F.transform(F.array_sort(F.array_distinct(F.coalesce("source_files", F.array().cast("array<string>")))), lambda f: F.concat(F.lit("- [["), t.stem(f), F.lit("]]"))), "\n")
    body = F.concat(F.lit("\n"), F.coalesce("description", F.lit("")), F.when(files != "", F.concat(F.lit("\n\n## Sources\n"), files)).otherwise(""))
    return entities.where("name is not null").select("entity_id", F.concat(stem, F.lit(".md")).alias("filename"), F.concat(head, body).alias("content"))


def similarity():
    """Ratcliff-Obershelp similarity of two columns of names, that of difflib without junk.

    All pairs of a batch go through the search for the longest common block together, then all stretches that are left
    before and after the blocks, by their size. Of blocks of one length the first in a counts, then the first in b.
    """

    def longest(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in a, place in b, length) of the longest common block of each stretch (row, from, to, from, to). a, b: all letters, and where each row begins."""
        row, alo, ahi, blo, bhi = part
        wide = int((bhi - blo).max())
        places = np.arange(wide, dtype=np.int32)[:, None]
        within = blo + places < bhi
        y = b[0][b[1][row] + np.minimum(blo + places, bhi - 1)]
        run = np.zeros((wide + 1, len(row)), np.int32)  # of the common block that ends at each place; the first stands for none
        i, j, size = alo.copy(), blo.copy(), np.zeros(len(row), np.int32)
        for step in range(int((ahi - alo).max())):
            at = alo + step
            run[1:] = (run[:-1] + 1) * ((y == a[0][a[1][row] + np.minimum(at, ahi - 1)]) & within & (at < ahi))
            n = run[1:].max(axis=0)
            more = n > size
            if more.any():
                size[more], i[more] = n[more], (at - n + 1)[more]
                j[more] = (blo + run[1:].argmax(axis=0) - n + 1)[more]
        return i, j, size

    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        la, lb = (np.fromiter(map(len, x), np.int32, len(x)) for x in (a, b))
        flat = lambda x, n: (np.frombuffer("".join(x).encode("utf-32-le"), np.uint32), np.cumsum(n, dtype=np.int64) - n)
        xs, ys = flat(a, la), flat(b, lb)
        matched = np.zeros(len(a), np.int64)
        todo = np.stack([np.arange(len(a), dtype=np.int32), 0 * la, la, 0 * lb, lb])
        while (todo := todo[:, (todo[1] < todo[2]) & (todo[3] < todo[4])]).size:
            size = np.ceil(np.log2(np.maximum(todo[2] - todo[1], todo[4] - todo[3]))).astype(int)
            left = []
            for k in np.unique(size):
                same = todo[:, size == k]
                for part in np.array_split(same, 1 + (same.shape[1] << k) // BATCH, axis=1):
                    if part.size:
                        i, j, n = longest(xs, ys, part)
                        np.add.at(matched, part[0], n)
                        row, alo, ahi, blo, bhi = part
                        left += [np.stack([row, alo, i, blo, j])[:, n > 0], np.stack([row, i + n, ahi, j + n, bhi])[:, n > 0]]
            todo = np.concatenate(left, axis=1)
        return pd.Series(np.where(la + lb > 0, 2.0 * matched / np.maximum(la + lb, 1), 1.0))

    return of


def near_names(names: DataFrame, least: float = NEAR) -> DataFrame:
    """(a, b, similarity) of different names at least so similar, blanks and case aside; a < b.

    Exact. M matched letters of names of lengths p and q lie in at most p + q - 2M + 1 blocks, so the names share at least
    3M - p - q - 1 letter pairs in their blocks; with M from the similarity asked for, the rarest of these is among the
    rarer pairs of both, and only those are joined. The other bounds come with the join: what can still be matched before,
    after and beside that pair, the letters of both as bits, and the edits that M leaves (letters outside blocks). Forms
    are compared once whatever the number of their spellings; the comparison itself runs in Arrow batches.
    """
    spelt = names.where("name is not null").select("name").distinct().withColumn("s", t.squeezed(F.col("name"))).where("length(s) > 1")
    n = F.length("s")
    forms = spelt.select("s").distinct().withColumn("letters", _letters("s"))
    each = forms.select("s", "letters", F.posexplode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("at", "g"))
    freq = each.groupBy("g").agg(F.count(F.lit(1)).alias("f"))
    ranked = each.join(freq, "g").withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("f", "g", "at")))
    shared = F.greatest(F.lit(1), F.ceil((1.5 * least - 1) * 2 * n / (2 - least) - 1))
    prefix = ranked.where(F.col("r") <= n - shared).select("s", n.alias("n"), "letters", "g", "at", "r")
    a, b = (prefix.select("g", *(F.col(c).alias(f"{c}_{side}") for c in ("s", "n", "letters", "at", "r"))) for side in "ab")
    p, q = F.col("n_a"), F.col("n_b")
    m = F.ceil((least - 1e-6) * (p + q) / 2)  # similarities are rounded to six places
    rest = (p + q - 2 * m).cast("int")
    fits = (
        ((p < q) | ((p == q) & (F.col("s_a") < F.col("s_b"))))
        & (p >= m)
        & (F.least("at_a", "at_b") + F.least(p - F.col("at_a"), q - F.col("at_b")) >= m)
        & (F.least(p - F.col("r_a"), q - F.col("r_b")) >= 3 * m - p - q - 1)
        & (F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= rest)
        & (F.call_function("levenshtein", "s_a", "s_b", rest) >= 0)  # -1 beyond the rest
    )
    pairs = a.join(b, "g").where(fits).select("s_a", "s_b").distinct()
    one, other = spelt.select(F.col("name").alias("x"), F.col("s").alias("s_a")), spelt.select(F.col("name").alias("y"), F.col("s").alias("s_b"))
    first = F.col("x") < F.col("y")
    side = lambda x, y, to: F.when(first, F.col(x)).otherwise(F.col(y)).alias(to)
    met = pairs.join(one, "s_a").join(other, "s_b").select(side("x", "y", "a"), side("y", "x", "b"), side("s_a", "s_b", "sa"), side("s_b", "s_a", "sb"))
    near = met.withColumn("similarity", F.round(F.pandas_udf(similarity(), "double")("sa", "sb"), 6)).where(F.col("similarity") >= least)
    same = one.join(other.withColumnRenamed("s_b", "s_a"), "s_a").where(first).select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("similarity"))
    return near.select("a", "b", "similarity").unionByName(same)


def _letters(c: str) -> Column:
    """The letters of a text as bits, three in each of 21 classes: one for each of the first three letters of the class.

    Two texts differ in at most as many bits as one has letters that the other hasn't.
    """
    place = "3 * pmod(hash(x), 21)"
    return F.expr(f"aggregate(split({c}, ''), 0L, (z, x) -> z | shiftleft(1L + 2 * (shiftright(z, {place}) & 3L) & 7L, {place}))")


def landing(values: DataFrame, names: DataFrame) -> DataFrame:
    """(axis, value, outcome): exact, substring or miss of each distinct value (axis, value) among names, blanks aside.

    A text lies within another only if its first letters do, so both directions are joins on a gram: the first one or two
    letters of the inner text, all runs of one and two letters of the outer.
    """
    known = names.select(t.squeezed(F.col("name")).alias("k")).where("k <> ''").distinct()
    v = values.where("value is not null").select("axis", "value").distinct().withColumn("s", t.squeezed(F.col("value")))

    def runs(c: str) -> Column:
        n = F.length(c)
        of = lambda w: F.when(n >= w, F.transform(F.sequence(F.lit(1), n - (w - 1)), lambda i: F.substring(F.col(c), i, F.lit(w)))).otherwise(F.array().cast("array<string>"))
        return F.explode(F.array_distinct(F.concat(of(1), of(2)))).alias("g")

    s = v.select("s").where("s <> ''").distinct()
    head = lambda c: F.substring(c, 1, 2).alias("g")
    inner = s.select("s", runs("s")).join(known.select("k", head("k")), "g").where(F.contains("s", "k"))
    outer = known.select("k", runs("k")).join(s.select("s", head("s")), "g").where(F.contains("k", "s"))
    hits = inner.select("s").unionByName(outer.select("s")).distinct().withColumn("hit", F.lit(True))
    exact = known.select(F.col("k").alias("s"), F.lit(True).alias("same"))
    x = v.join(exact, "s", "left").join(hits, "s", "left")
    return x.select("axis", "value", F.when(F.col("same"), "exact").when(F.col("hit"), "substring").otherwise("miss").alias("outcome"))


def landing_rates(outcomes: DataFrame) -> DataFrame:
    """(axis, exact, substring, miss, rate): outcomes counted, and the part that landed (0 without values)."""
    count = lambda o: F.sum((F.col("outcome") == o).cast("bigint")).alias(o)
    x = outcomes.groupBy("axis").agg(count("exact"), count("substring"), count("miss"))
    return x.withColumn("rate", F.round((F.col("exact") + F.col("substring")) / (F.col("exact") + F.col("substring") + F.col("miss")), 6))


def near_variants(values: DataFrame, names: DataFrame, least: float = NEAR) -> DataFrame:
    """(axis, value, name, similarity): of each distinct value that landed neither exactly nor by part the names near it.

    The same bound by rare letter pairs as in near_names, between two sides.
    """
    missed = landing(values, names).where("outcome = 'miss'").select("axis", "value").withColumn("s", t.squeezed(F.col("value"))).where("length(s) > 1")
    known = names.where("name is not null").select("name").distinct().withColumn("k", t.squeezed(F.col("name"))).where("length(k) > 1")
    pair = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2))))).alias("g")
    la, lb = F.length("s"), F.length("k")
    # names so near share letter pairs: 3M - p - q - 1 of them at least
    met = missed.select("axis", "value", "s", pair("s")).join(known.select("name", "k", pair("k")), "g").where(2 * F.least(la, lb) >= least * (la + lb)).select("axis", "value", "s", "name", "k").distinct()
    ratio = F.pandas_udf(similarity(), "double")
    return met.withColumn("similarity", F.round(ratio("s", "k"), 6)).where(F.col("similarity") >= least).select("axis", "value", "name", "similarity")


def landing_with_variants(values: DataFrame, names: DataFrame, least: float = NEAR) -> DataFrame:
    """landing with a fourth outcome, near_variant, for values that only come near a name."""
    near = near_variants(values, names, least).select("axis", "value").distinct().withColumn("near", F.lit(True))
    return landing(values, names).join(near, ["axis", "value"], "left").select("axis", "value", F.when(F.col("near"), "near_variant").otherwise(F.col("outcome")).alias("outcome"))


def relation_lines(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(name, other, line): the relation lines of the notes of both ends of relations (source, target, keywords, weight).

    An end that is a node gets a line that links the other end if that is a node too, and names it plainly otherwise; a
    relation without a known end gives none.
    """
    known = nodes.select("name").where("name is not null").distinct()
    ends = relations.select(F.col("source").alias("name"), F.col("target").alias("other"), "keywords", "weight").unionByName(relations.select(F.col("target").alias("name"), F.col("source").alias("other"), "keywords", "weight"))
    x = ends.join(known, "name").join(known.select(F.col("name").alias("other"), F.lit(True).alias("linked")), "other", "left")
    stem = F.when(F.col("linked"), F.concat(F.lit("[["), t.safe_name(F.col("other")), F.lit("]]"))).otherwise(F.col("other"))
    return x.select("name", "other", F.concat(F.lit("- "), stem, F.lit(" ("), F.coalesce("keywords", F.lit("")), F.lit("; "), F.col("weight").cast("string"), F.lit(")")).alias("line"))


def graph_context(entities: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """(key, block): lines of entities (key, line), then of relations (key, line), each once and in order; null if there are none.

    Keys are queries, whose hits are few; keys without hits come in with a null line.
    """
    both = entities.select(key, F.lit(0).alias("part"), "line").unionByName(relations.select(key, F.lit(1).alias("part"), "line"))
    x = both.groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("line").isNotNull(), F.struct("part", "line")))).alias("ls"))
    return x.select(key, F.when(F.size("ls") > 0, F.array_join(F.transform("ls", lambda l: l["line"]), "\n")).alias("block"))
