"""Visually identical text with different characters: one plain form for each text.

Texts are exploded to positioned code points; broadcast joins with the decomposition and look-alike mappings replace
each one; combining marks are ordered by class and composed again; the strings are rebuilt. All of it is DataFrame
work: one shuffle by text, after which every step uses the same partitioning.

Scale: only distinct texts that hold a character outside the plain repertoire are exploded at all. The joined mappings are
derived from the Unicode tables of the Python runtime and hold a few thousand rows, whatever the input.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Letters of other alphabets that look like a Latin letter.
LIKE_LATIN = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ρ": "p",
}
#: Hyphens that look like the ordinary one.
HYPHENS = "‐‑﹣－"
#: Characters that no rule touches; a text of only these is plain but for the two Thai vowels below.
PLAIN = r"^[ -~ก-ฺ฿-์๎-๛]*$"
#: Thai vowels typed as two characters.
TWO_E = "เเ"
NIKHAHIT_AA = "([่-๋]*)ํ([่-๋]*)า"


@lru_cache(1)
def _rows() -> list[tuple]:
    """(ch, parts, script, twins): parts are (ch, class, compositions by starter), twins the look-alikes by script."""
    twins: dict[str, dict[str, str]] = {}
    for other, latin in LIKE_LATIN.items():
        script = "G" if "Ͱ" <= other < "Ѐ" else "C"
        twins.setdefault(other, {})["L"] = latin
        twins.setdefault(latin, {}).setdefault(script, other)
    for x in list(twins):
        if "L" in twins[x]:
            for s in "CG":
                if s in twins.get(twins[x]["L"], {}) and twins[twins[x]["L"]][s] != x:
                    twins[x].setdefault(s, twins[twins[x]["L"]][s])
    joins: dict[str, dict[str, str]] = {}
    special: dict[str, str] = {}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        kind, category = unicodedata.decomposition(ch), unicodedata.category(ch)
        if category == "Cf" or ch == "͏" or "︀" <= ch <= "️":
            special[ch] = ""
        elif category == "Zs":
            special[ch] = " "
        elif ch in HYPHENS:
            special[ch] = "-"
        elif kind.startswith(("<wide>", "<narrow>")):
            special[ch] = unicodedata.normalize("NFKD", ch)
        elif kind and not kind.startswith("<"):
            special[ch] = unicodedata.normalize("NFD", ch)
            if unicodedata.normalize("NFC", ch) == ch and len(pair := kind.split()) == 2:
                joins.setdefault(chr(int(pair[1], 16)), {})[chr(int(pair[0], 16))] = ch
        elif unicodedata.combining(ch):
            special[ch] = ch
    for ch in joins:
        special.setdefault(ch, ch)
    for ch in twins:
        special.setdefault(ch, ch)
    return [(ch, [(p, unicodedata.combining(p), list(joins[p].items()) if p in joins else None) for p in parts]) for ch, parts in special.items()], [(ch, ss) for ch, ss in twins.items()]


def mappings(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(ch, parts) and (ch, twins), both of bounded size."""
    parts, twins = _rows()
    return (
        spark.createDataFrame(parts, "ch string, parts array<struct<c: string, ccc: int, joins: array<struct<s: string, ch: string>>>>"),
        spark.createDataFrame(twins, "ch string, twins map<string, string>"),
    )


def suspect(text: Column) -> Column:
    """Whether a text can differ from its plain form; exact, as the rules touch nothing else."""
    return ~text.rlike(PLAIN) | text.contains(TWO_E)


def _script(ch: Column) -> Column:
    return F.when(ch.rlike(r"^\p{IsLatin}"), "L").when(ch.rlike(r"^\p{IsCyrillic}"), "C").when(ch.rlike(r"^\p{IsGreek}"), "G")


def thai_vowels(text: Column) -> Column:
    """Each Thai vowel typed as two characters as its one character."""
    return F.regexp_replace(F.regexp_replace(text, TWO_E, "แ"), NIKHAHIT_AA, "$1$2ำ")


def plain_forms(texts: DataFrame, column: str = "value") -> DataFrame:
    """(column, plain): the plain form of each distinct text that isn't null.

    Canonical composition; ordinary spaces, hyphens and widths; no invisible (format) characters; Thai vowels as one
    character; in a word of mixed alphabets, look-alikes in the alphabet of its unmistakable letters, or, if it has none,
    of the unmistakable letters of the text, else Latin. Words wholly of another alphabet, other letters, spaces at
    the ends and empty texts stay. Conjoining Hangul is not composed.
    """
    spark = texts.sparkSession
    parts, twins = mappings(spark)
    distinct = texts.select(F.col(column).alias("v")).where("v is not null").distinct()
    odd = distinct.where(suspect(F.col("v"))).withColumn("k", F.md5("v"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # a small number of texts is spread, too
    chars = odd.repartition(tasks, "k").select("k", F.posexplode(F.split("v", "")).alias("pos", "ch"))
    pieces = (
        chars.join(F.broadcast(parts), "ch", "left")
        .select("k", "pos", F.posexplode(F.coalesce("parts", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"), F.lit(None).cast("array<struct<s:string,ch:string>>").alias("joins"))))).alias("sub", "p"))
        .select("k", "pos", "sub", "p.*")
    )
    by = Window.partitionBy("k")
    pieces = pieces.withColumn("seg", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(by.orderBy("pos", "sub")))
    segments = pieces.groupBy("k", "seg").agg(F.array_sort(F.collect_list(F.struct("ccc", "pos", "sub", "c", "joins"))).alias("cs"))
    # (starter so far, marks left, class of the last mark left)
    first = F.struct(F.col("cs")[0]["c"].alias("s"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    joined = lambda a, m: F.get(F.filter(m["joins"], lambda j: j["s"] == a["s"]), F.lit(0))["ch"]
    fold = F.aggregate(
        F.slice("cs", 2, F.size("cs")),
        first,
        lambda a, m: F.when(((a["last"] < m["ccc"]) | (a["rest"] == "")) & joined(a, m).isNotNull(), F.struct(joined(a, m).alias("s"), a["rest"].alias("rest"), a["last"].alias("last"))).otherwise(
            F.struct(a["s"].alias("s"), F.concat(a["rest"], m["c"]).alias("rest"), m["ccc"].alias("last"))
        ),
    )
    composed = segments.select("k", "seg", F.when(F.size("cs") == 1, first).otherwise(fold).alias("f")).select("k", "seg", F.col("f.s").alias("ch"), F.col("f.rest").alias("rest"))
    letters = (
        composed.join(F.broadcast(twins), "ch", "left")
        .withColumn("script", _script(F.col("ch")))
        .withColumn("word", F.sum(F.when(F.col("ch").rlike(r"^[\p{L}\p{M}]"), 0).otherwise(1)).over(by.orderBy("seg")))
    )
    for s in "LCG":  # letters with no look-alike show the alphabet of the word and of the text
        sure = (F.col("script") == s) & F.col("twins").isNull()
        letters = letters.withColumn(f"w{s}", F.sum(F.when(sure, 1).otherwise(0)).over(Window.partitionBy("k", "word"))).withColumn(f"t{s}", F.sum(F.when(sure, 1).otherwise(0)).over(by))
        letters = letters.withColumn(f"m{s}", F.max(F.col("script") == s).over(Window.partitionBy("k", "word")))

    def dominant(x: str) -> Column:
        return F.when((F.col(f"{x}C") > F.col(f"{x}L")) & (F.col(f"{x}C") >= F.col(f"{x}G")), "C").when(F.col(f"{x}G") > F.col(f"{x}L"), "G").when(F.col(f"{x}L") > 0, "L")

    mixed = F.col("mL").cast("int") + F.col("mC").cast("int") + F.col("mG").cast("int") > 1
    target = F.coalesce(dominant("w"), dominant("t"), F.when(mixed, "L"))
    letters = letters.withColumn("ch", F.when(F.col("twins").isNotNull() & (target != F.col("script")), F.coalesce(F.element_at("twins", target), F.col("ch"))).otherwise(F.col("ch")))
    rebuilt = letters.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "ch", "rest"))), lambda x: F.concat(x["ch"], x["rest"])), "").alias("plain"))
    done = odd.join(rebuilt, "k", "left").select(F.col("v").alias(column), thai_vowels(F.coalesce("plain", F.lit(""))).alias("plain"))
    return done.unionByName(distinct.where(~suspect(F.col("v"))).select(F.col("v").alias(column), F.col("v").alias("plain")))


def cells(tables: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(src, row_id, field, value) of text columns of several tables, given as name: (table, id column, columns)."""
    out = None
    for src, (df, key, columns) in tables.items():
        pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns)))
        part = df.select(F.lit(src).alias("src"), F.col(key).cast("bigint").alias("row_id"), pairs.alias("x")).select("src", "row_id", "x.*")
        out = part if out is None else out.unionByName(part)
    return out


def not_plain(values: DataFrame) -> DataFrame:
    """(src, row_id, field) of the cells whose value isn't in its plain form; nulls and empty texts are plain."""
    odd = values.where(suspect(F.col("value")))
    changed = plain_forms(odd).where(F.col("plain") != F.col("value"))
    return odd.join(changed, "value", "left_semi").select("src", "row_id", "field").distinct()
