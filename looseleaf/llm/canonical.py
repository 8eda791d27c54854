"""Mapping freely typed values to a reference list.

Values are deduplicated and normalised (plain form, case, blanks, punctuation at the ends). Candidates come from an
inverted index of the character n-grams of the reference forms; a pair is scored by the cosine of n-gram vectors weighted
by inverse document frequency; the best entry is accepted if its score reaches a threshold and leads the next entry by a
margin.

The index holds grams of two and three letters. Single letters, which nearly all pairs share, are part of the score but
not of the index: they are added only for pairs that can still reach the threshold by them. Parts so short that letters
alone could reach it (two letters, say) are looked up by letters as well, so no pair is lost.

Two things typed around a term are undone before scoring: wrappings ("it is ...", "... (see photo)"), learned from the
distinct values that hold a reference form whole, and doubled naming ("term = other name"), by scoring the parts.

Scale: everything after the first step works on distinct values, in equi-joins; the optimizer broadcasts the side of the
reference list while its size is small, and splits skewed grams otherwise. No pair of values is ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from looseleaf.llm.plain_form import plain_forms
from looseleaf.session import checkpointed

#: Defaults: least score, least lead over the next entry, score that needs no check of the spelling, edits (a share of the
#: letters, but two at least) that the check allows, distinct entries that show a wrapping.
THRESHOLD, MARGIN, SURE, EDITS, SHOWN_BY = 0.27, 0.015, 0.62, 0.37, 4


def normal(text: Column) -> Column:
    """Lower case; underscores, hyphens and blanks as one space; no space within Thai; no punctuation at the ends."""
    x = F.regexp_replace(F.lower(text), r"[\s_\-]+", " ")
    x = F.regexp_replace(x, r"(?<=[฀-๿]) (?=[฀-๿])", "")
    return F.regexp_replace(x, r"^[\s.,;:!?/=]+|[\s.,;:!?/=]+$", "")


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]", "")


def _grams(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, gram, tf): letters, pairs at a distance of one or two, and triples, of the text without blanks and punctuation.

    Pairs at both distances are one kind, so two letters that changed places lose few of them; leaving out blanks, words
    that changed places do.
    """
    n = F.length("_p")

    def of(width: int, piece) -> Column:
        return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)), piece)).otherwise(F.array().cast("array<string>"))

    at = lambda i, k=1: F.substring(F.col("_p"), i, F.lit(k))
    grams = F.concat(of(1, lambda i: at(i)), of(2, lambda i: at(i, 2)), of(3, lambda i: F.concat(at(i), at(i + 2))), of(3, lambda i: at(i, 3)))
    return df.withColumn("_p", _squeezed(F.col(text))).select(*keys, F.explode(grams).alias("gram")).groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("tf"))


def _forms(entries: DataFrame, plain: DataFrame) -> DataFrame:
    """(axis, term_id, form): normal forms of the reference list, and names of two words with the first cut to its initial."""
    plain = entries.join(plain, "value")
    forms = plain.select("axis", "term_id", normal(F.col("plain")).alias("form")).where("form <> ''")
    short = forms.where(F.col("form").rlike("^[a-z]{2,} [a-z]{4,}$")).withColumn("form", F.regexp_replace("form", "^([a-z])[a-z]+", "$1."))
    return forms.unionByName(short).distinct()


def _wrappings(values: DataFrame, forms: DataFrame, shown_by: int) -> DataFrame:
    """(axis, side, wrap): what stands before or after reference forms in the values of at least shown_by entries."""
    # a value that holds a form holds its first three letters: an index of one gram for each form
    n = F.length("norm")
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(F.col("norm"), i, F.lit(3))))
    heads = forms.where("length(form) >= 4").select("axis", "term_id", "form", F.substring("form", 1, 3).alias("head"))
    at = F.instr(F.col("norm"), F.col("form"))
    asked = values.where(n > 4).select("axis", "norm", F.explode(starts).alias("head"))
    held = asked.join(heads, ["axis", "head"]).where((at > 0) & (F.col("norm") != F.col("form")))
    held = held.select("axis", "term_id", F.substring(F.col("norm"), F.lit(1), at - 1).alias("left"), F.substring(F.col("norm"), at + F.length("form"), F.lit(10**6)).alias("right"))
    sides = held.select("axis", "term_id", F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left").alias("wrap")), F.struct(F.lit("right").alias("side"), F.col("right").alias("wrap")))).alias("x")).select("axis", "term_id", "x.*")
    return sides.where("trim(wrap) <> ''").groupBy("axis", "side", "wrap").agg(F.countDistinct("term_id").alias("n")).where(F.col("n") >= shown_by).select("axis", "side", "wrap")


def _parts(values: DataFrame, wraps: DataFrame) -> DataFrame:
    """(axis, value, part): the value without wrappings, and its parts where it names a thing twice."""
    x = values.select("axis", "value", "norm")
    for side in ("left", "right"):
        n = F.length("norm")
        held = F.substring(F.col("norm"), F.lit(1), F.col("k")) if side == "left" else F.substring(F.col("norm"), n - F.col("k") + 1, F.col("k"))
        ends = x.where(n > 2).select("axis", "value", "norm", F.explode(F.sequence(F.lit(1), n - 2)).alias("k")).select("axis", "value", "k", held.alias("wrap"))
        longest = ends.join(wraps.where(F.col("side") == side).select("axis", "wrap"), ["axis", "wrap"]).groupBy("axis", "value").agg(F.max("k").alias("k"))
        cut = F.substring(F.col("norm"), F.col("k") + 1, n) if side == "left" else F.substring(F.col("norm"), F.lit(1), n - F.col("k"))
        x = x.join(longest, ["axis", "value"], "left").withColumn("norm", F.regexp_replace(F.when(F.col("k").isNull(), F.col("norm")).otherwise(cut), r"^[\s.,;:!?/=]+|[\s.,;:!?/=]+$", "")).drop("k")
    names = F.filter(F.transform(F.split("norm", r" ?[/=;()|] ?"), lambda p: F.trim(p)), lambda p: F.length(p) > 1)
    return x.select("axis", "value", F.explode(F.array_distinct(F.concat(F.array("norm"), names))).alias("part")).where("part <> ''")


def match_values(values: DataFrame, terms: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN, sure: float = SURE, edits: float = EDITS, shown_by: int = SHOWN_BY) -> DataFrame:
    """(axis, value, term_id, score, lead) for each distinct (axis, value); term_id is 0 where no entry is accepted.

    near, score and lead are null where no entry comes within margin of the threshold; lead is over such entries only.
    values: (axis, value), terms: (axis, term_id, term, term_en). Null and empty values give no rows; ties between
    entries are no match; an axis without entries matches nothing.
    """
    distinct = values.where("value is not null and value <> ''").select("axis", "value").distinct()
    entries = terms.select("axis", "term_id", F.explode(F.array("term", "term_en")).alias("value")).where("value is not null")
    texts = checkpointed(plain_forms(distinct.select("value").unionByName(entries.select("value"))))  # of both sides at once
    plain = checkpointed(distinct.join(texts, "value").select("axis", "value", normal(F.col("plain")).alias("norm")))
    forms = checkpointed(_forms(entries, texts))
    parts = checkpointed(_parts(plain, _wrappings(plain, forms, shown_by)))
    # grams carry numbers instead of texts
    each = parts.select("axis", "part").distinct().withColumn("pid", F.xxhash64("axis", "part"))
    known = forms.withColumn("fid", F.xxhash64("axis", "term_id", "form"))
    pg, fg = _grams(each, ["axis", "pid"], "part"), _grams(known, ["axis", "fid"], "form")
    total = each.groupBy("axis").agg(F.count(F.lit(1)).alias("total"))
    df = pg.groupBy("axis", "gram").agg(F.count(F.lit(1)).alias("df")).join(total, "axis")
    idf = df.select("axis", "gram", F.log((F.col("total") + 1) / (F.col("df") + 0.5)).alias("idf"))
    unseen = F.coalesce("idf", F.lit(8.0))
    letter, energy = F.length("gram") == 1, F.col("w") * F.col("w")
    least = threshold - margin

    def weighted(grams: DataFrame, of: str, as_: str, letters: str) -> DataFrame:
        """Weights of unit vectors, and the length that single letters have in each; written down, as it is read three times."""
        x = grams.join(idf, ["axis", "gram"], "left").select("axis", of, "gram", (F.sqrt("tf") * unseen).alias("w"))
        whole = Window.partitionBy(of)
        x = x.withColumn("norm", F.sqrt(F.sum(energy).over(whole))).withColumn("ls", F.sqrt(F.coalesce(F.sum(F.when(letter, energy)).over(whole), F.lit(0.0))))
        return checkpointed(x.select("axis", of, "gram", (F.col("ls") / F.col("norm")).alias(letters), (F.col("w") / F.col("norm")).alias(as_)))

    px, index = weighted(pg, "pid", "pw", "pl"), weighted(fg, "fid", "fw", "fl")
    # parts and forms alike mostly share longer grams; where letters alone can reach the threshold, letters are looked up, too
    asked = px.where(~letter | (F.col("pl") >= least))
    shared = asked.join(index, ["axis", "gram"]).groupBy("pid", "fid").agg(F.sum(F.when(letter, 0.0).otherwise(F.col("pw") * F.col("fw"))).alias("dot"), F.max("pl").alias("pl"), F.max("fl").alias("fl"))
    hopeful = checkpointed(shared.where(F.col("dot") + F.col("pl") * F.col("fl") >= least - 1e-9).select("pid", "fid", "dot"))
    singles = hopeful.select("pid", "fid").join(px.where(letter).select("pid", "gram", "pw"), "pid").join(index.where(letter).select("fid", "gram", "fw"), ["fid", "gram"])
    more = singles.groupBy("pid", "fid").agg(F.sum(F.col("pw") * F.col("fw")).alias("more"))
    scored = hopeful.join(more, ["pid", "fid"], "left").select("pid", "fid", (F.col("dot") + F.coalesce("more", F.lit(0.0))).alias("score")).where(F.col("score") >= least)
    # of each part and entry the best form, while it is numbers still
    ends = known.select("fid", "term_id", "form")
    top_forms = scored.join(ends.select("fid", "term_id"), "fid").groupBy("pid", "term_id").agg(F.max(F.struct("score", "fid")).alias("b"))
    named = top_forms.select("pid", "term_id", "b.score", "b.fid").withColumn("nth", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("score"), "term_id"))).where("nth <= 2")
    texts = named.join(each.select("pid", "axis", "part"), "pid").join(ends.select("fid", "form"), "fid")
    best = parts.join(texts, ["axis", "part"]).groupBy("axis", "value", "term_id").agg(F.max(F.struct("score", "part", "form")).alias("b"))
    best = best.select("axis", "value", "term_id", "b.*")
    order = Window.partitionBy("axis", "value").orderBy(F.desc("score"), "term_id")
    top = best.withColumn("next", F.lead("score", 1, 0.0).over(order)).withColumn("rank", F.row_number().over(order)).where("rank = 1")
    letters = F.greatest(F.length(_squeezed(F.col("part"))), F.length(_squeezed(F.col("form"))))
    near = F.levenshtein(_squeezed(F.col("part")), _squeezed(F.col("form"))) <= F.greatest(F.lit(2.0), letters * edits)
    top = top.select("axis", "value", F.col("term_id").alias("near"), "score", (F.col("score") - F.col("next")).alias("lead"), ((F.col("score") >= sure) | near).alias("spelt"))
    accept = (F.col("score") >= threshold) & (F.col("lead") >= margin) & F.col("spelt")
    return distinct.join(top, ["axis", "value"], "left").select("axis", "value", F.when(accept, F.col("near")).otherwise(0).cast("bigint").alias("term_id"), "near", "score", "lead")


def map_cells(cells: DataFrame, terms: DataFrame, **options: float) -> DataFrame:
    """(src, row_id, field, term_id) of cells (src, row_id, field, axis, value) that aren't letter for letter an entry.

    Null, empty and `-` are no values, and a cell without an axis has no reference list; they give no rows. term_id is the
    entry meant, 0 if none is. Repeated rows count once.
    """
    exact = terms.select("axis", F.explode(F.array("term", "term_en")).alias("value")).where("value is not null").distinct()
    typed = cells.where("value is not null and value not in ('', '-')")
    free = typed.join(exact, ["axis", "value"], "left_anti")
    return free.join(match_values(free, terms, **options), ["axis", "value"]).select("src", "row_id", "field", "term_id").distinct()
