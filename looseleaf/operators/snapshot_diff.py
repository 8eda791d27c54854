"""What changed between full snapshots: hash ranges, Merkle digests compared top-down, rows only where digests differ.

Every row hashes to one of 2**leaf_bits hash ranges. A leaf digest is an order-free fold (two XORs of independent
64-bit hashes and a count) of the rows of one range; digests of inner nodes fold the digests of their children. The
digests of two consecutive snapshots are compared from the root down, each level only below nodes that differ, and rows
are looked at only in ranges whose leaves differ.

Scale: the rows are shuffled once, by (snapshot, range), for the digests; unchanged ranges are filtered out before the
second pass shuffles anything. With N keys in a snapshot, leaf_bits near log2(N / 1000) keeps a range at about a
thousand rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from looseleaf.session import checkpointed

#: Bits that one level of the tree adds.
STEP = 4


def _key(uid: Column) -> Column:
    return F.lower(F.regexp_replace(uid, r"(?U)^\s+|\s+$", ""))


def _range(key: Column, leaf_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - leaf_bits).cast("int")


def current_deliveries(manifest: DataFrame) -> DataFrame:
    """Rows (snapshot_no, uid, sha256) of the highest delivery of each snapshot, keys and digests in plain spelling.

    Rows without snapshot_no or uid, or with a blank uid, can't be addressed and are left out. A null delivery_no counts
    below any number. Repeated rows stay; they are folded later.
    """
    rows = manifest.select(
        "snapshot_no", F.coalesce("delivery_no", F.lit(-(2**31))).alias("delivery_no"), _key(F.col("uid")).alias("uid"), F.lower("sha256").alias("sha256")
    ).where("snapshot_no is not null and uid <> ''")
    last = rows.groupBy("snapshot_no").agg(F.max("delivery_no").alias("delivery_no"))
    return rows.join(last, ["snapshot_no", "delivery_no"]).select("snapshot_no", "uid", "sha256")


def _digest(*of: Column) -> list[Column]:
    return [F.bit_xor(F.xxhash64(F.lit(1), *of)).alias("da"), F.bit_xor(F.xxhash64(F.lit(2), *of)).alias("db"), F.count(F.lit(1)).alias("n")]


def leaf_digests(rows: DataFrame, leaf_bits: int) -> DataFrame:
    """(snapshot_no, node, da, db, n): one digest for each hash range of each snapshot."""
    return (
        rows.withColumn("node", _range(F.col("uid"), leaf_bits))
        .repartition("snapshot_no", "node")  # serves both aggregations below
        .groupBy("snapshot_no", "node", "uid")
        .agg(F.max("sha256").alias("sha256"))
        .groupBy("snapshot_no", "node")
        .agg(*_digest(F.col("uid"), F.col("sha256").isNull(), F.col("sha256")))
    )


def _pairs(leaves: DataFrame) -> DataFrame:
    """(old_no, new_no): each snapshot and the one with the next lower number; one row for each snapshot, a few in all."""
    return leaves.select("snapshot_no").distinct().select(F.lag("snapshot_no").over(Window.orderBy("snapshot_no")).alias("old_no"), F.col("snapshot_no").alias("new_no")).where("old_no is not null")


def _sides(pairs: DataFrame) -> DataFrame:
    """(snapshot_no, pair, is_new): the comparisons that a snapshot takes part in."""
    return pairs.select(F.col("new_no").alias("snapshot_no"), F.col("new_no").alias("pair"), F.lit(True).alias("is_new")).unionByName(
        pairs.select(F.col("old_no").alias("snapshot_no"), F.col("new_no").alias("pair"), F.lit(False).alias("is_new"))
    )


def differing_ranges(leaves: DataFrame, leaf_bits: int) -> DataFrame:
    """(pair, node): hash ranges whose digests differ between snapshot `pair` and the one before it, found from the root down."""
    sides = checkpointed(_sides(_pairs(leaves)))
    levels = [leaves]
    for _ in range(leaf_bits, 0, -STEP):
        levels.append(levels[-1].groupBy("snapshot_no", F.shiftright("node", STEP).alias("node")).agg(*_digest(F.col("node"), F.col("da"), F.col("db"), F.col("n"))))

    def compare(above: DataFrame | None, nodes: DataFrame) -> DataFrame:
        both = nodes.join(sides, "snapshot_no")
        if above is not None:
            both = both.withColumn("up", F.shiftright("node", STEP)).join(above.withColumnRenamed("node", "up"), ["pair", "up"], "left_semi")
        digest = F.struct("da", "db", "n")
        return (
            both.groupBy("pair", "node")
            .agg(F.max(F.when(F.col("is_new"), digest)).alias("new"), F.max(F.when(~F.col("is_new"), digest)).alias("old"))
            .where(~F.col("new").eqNullSafe(F.col("old")))
            .select("pair", "node")
        )

    return reduce(compare, reversed(levels), None)


def snapshot_changes(manifest: DataFrame, leaf_bits: int = 16) -> DataFrame:
    """(snapshot_no, uid, status): keys new, removed or changed against the snapshot with the next lower number.

    A null digest equals only null. One key twice in a delivery counts once, with its greatest digest that isn't null.
    The first snapshot and empty tables give no rows; extra columns are ignored. leaf_bits must be a multiple of 4
    up to 28.
    """
    if leaf_bits % STEP or not 0 < leaf_bits <= 28:
        raise ValueError(f"leaf_bits must be a multiple of {STEP} up to 28")
    rows = current_deliveries(manifest)
    leaves = checkpointed(leaf_digests(rows, leaf_bits))
    ranges = differing_ranges(leaves, leaf_bits).join(_sides(_pairs(leaves)), "pair")
    return (
        rows.withColumn("node", _range(F.col("uid"), leaf_bits))
        .join(ranges, ["snapshot_no", "node"])
        .groupBy("pair", "uid")
        .agg(
            F.max("is_new").alias("in_new"),
            F.max(~F.col("is_new")).alias("in_old"),
            F.max(F.when(F.col("is_new"), F.col("sha256"))).alias("new"),
            F.max(F.when(~F.col("is_new"), F.col("sha256"))).alias("old"),
        )
        .select(
            F.col("pair").alias("snapshot_no"),
            "uid",
            F.when(~F.col("in_old"), "new").when(~F.col("in_new"), "removed").when(~F.col("new").eqNullSafe(F.col("old")), "changed").alias("status"),
        )
        .where("status is not null")
    )
