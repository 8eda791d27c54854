"""Order-dependent columns over keys of any size: work within blocks of the order, then over block totals only.

A plain window puts all rows of a key into one task. Here a window sees one block of one key, and a second one a row for
each block, so a key that holds a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from looseleaf.session import checkpointed


def ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with _range, blocks of rows that are near in (keys, order), for rows without a natural block such as a month.

    A range partitioning splits large keys; it is sampled, so the result is written down before it is used.
    """
    columns = [*keys, *order]
    x = df.repartitionByRange(*columns) if parts is None else df.repartitionByRange(parts, *columns)
    return checkpointed(x.withColumn("_range", F.spark_partition_id()))


def with_previous(df: DataFrame, keys: list[str], order: list[str], value: str, block: Column, to: str) -> DataFrame:
    """df with the value of the row before, in order, within keys; null in the first. block must not decrease in order."""
    x = df.withColumn("_b", block)
    within = Window.partitionBy(*keys, "_b").orderBy(*order)
    last = x.groupBy(*keys, "_b").agg(F.max(F.struct(*order, F.struct(value).alias("_v"))).alias("_m"))
    last = last.select(*keys, "_b", F.lag(F.col("_m")["_v"][value]).over(Window.partitionBy(*keys).orderBy("_b")).alias("_before"))
    x = x.withColumn(to, F.lag(value).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    return x.join(last, [*keys, "_b"]).withColumn(to, F.when(F.col("_first"), F.col("_before")).otherwise(F.col(to))).drop("_b", "_first", "_before")


def with_next(df: DataFrame, keys: list[str], order: list[str], value: str, block: Column, to: str) -> DataFrame:
    """df with the value of the row after, in order, within keys; null in the last."""
    x = df.withColumn("_b", block)
    within = Window.partitionBy(*keys, "_b").orderBy(*order)
    first = x.groupBy(*keys, "_b").agg(F.min(F.struct(*order, F.struct(value).alias("_v"))).alias("_m"))
    first = first.select(*keys, "_b", F.lead(F.col("_m")["_v"][value]).over(Window.partitionBy(*keys).orderBy("_b")).alias("_after"))
    x = x.withColumn(to, F.lead(value).over(within)).withColumn("_last", F.lead(F.lit(1)).over(within).isNull())
    return x.join(first, [*keys, "_b"]).withColumn(to, F.when(F.col("_last"), F.col("_after")).otherwise(F.col(to))).drop("_b", "_last", "_after")


def _with_running(df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column, to: str, fold, own: bool) -> DataFrame:
    x = df.withColumn("_b", block).withColumn("_v", value)
    within = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = x.groupBy(*keys, "_b").agg(fold("_v").alias("_s")).select(*keys, "_b", fold("_s").over(before).alias("_before"))
    return x.withColumn("_in", fold("_v").over(within)).join(totals, [*keys, "_b"])


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column, to: str) -> DataFrame:
    """df with the sum of value over the rows up to this one, in order, within keys."""
    x = _with_running(df, keys, order, value, block, to, F.sum, True)
    return x.withColumn(to, F.col("_in") + F.coalesce("_before", F.lit(0))).drop("_b", "_v", "_in", "_before")


def with_max_before(df: DataFrame, keys: list[str], order: list[str], value: Column, block: Column, to: str) -> DataFrame:
    """df with the maximum of value over the rows before this one, in order, within keys; null in the first."""
    x = _with_running(df, keys, order, value, block, to, F.max, False)
    return x.withColumn(to, F.greatest("_in", "_before")).drop("_b", "_v", "_in", "_before")


def month_block(ts: str) -> Column:
    """Blocks of about a month, for rows in order of time."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(2_592_000_000_000))
