"""Greedy packing under a token budget: what doesn't fit is skipped, later items may still fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def keep_within(items: DataFrame, key: str, order: str, cost: Column, budget: int, payload: str) -> DataFrame:
    """(key, order, place, payload): items kept in order within the budget; place numbers them from 1.

    A fold over one array for each key, the ranked candidates of one query.
    """
    ranked = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cost.cast("bigint").alias("c"), F.col(payload).alias("p")))).alias("xs"))
    kept = "array<struct<o: bigint, p: string>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(kept).alias("kept"))
    step = lambda a, x: F.when(a["used"] + x["c"] <= budget, F.struct((a["used"] + x["c"]).alias("used"), F.concat(a["kept"], F.array(F.struct(x["o"].cast("bigint").alias("o"), x["p"].alias("p")))).alias("kept"))).otherwise(a)
    out = ranked.select(key, F.posexplode(F.aggregate("xs", start, step)["kept"]).alias("place", "x"))
    return out.select(key, F.col("x.o").alias(order), (F.col("place") + 1).alias("place"), F.col("x.p").alias(payload))


def pack_sections(references: DataFrame, key: str, budget: int) -> DataFrame:
    """(key, place, label, whole): references kept in order within the budget, numbered from 1.

    references: (key, rank, name, note, chunk). Each takes its whole note if that fits, else its chunk if that does, else
    none. A label `[number] name` and a line end count too, so the cost of an item depends on how many were kept before.
    """
    ranked = references.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "name", F.length("note").alias("nl"), F.length("chunk").alias("cl")))).alias("xs"))
    kept = "array<struct<label: string, whole: boolean>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(kept).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        label = F.concat(F.lit("["), (F.size(a["kept"]) + 1).cast("string"), F.lit("] "), x["name"])
        head = F.length(label) + 1
        add = lambda n, whole: F.struct((a["used"] + head + n).cast("bigint").alias("used"), F.concat(a["kept"], F.array(F.struct(label.alias("label"), F.lit(whole).alias("whole")))).cast(kept).alias("kept"))
        fits = lambda n: F.coalesce(a["used"] + head + n <= budget, F.lit(False))
        return F.when(fits(x["nl"]), add(x["nl"], True)).when(fits(x["cl"]), add(x["cl"], False)).otherwise(a)

    out = ranked.select(key, F.posexplode(F.aggregate("xs", start, step)["kept"]).alias("place", "x"))
    return out.select(key, (F.col("place") + 1).alias("place"), "x.label", "x.whole")
