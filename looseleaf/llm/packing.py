"""Filling containers of fixed capacity with items, by patterns fitted with non-negative least squares.

Items are counted in a histogram of size classes. Patterns of a few classes that nearly fill a container are enumerated,
and their repeat counts fitted to the histogram by non-negative least squares and rounded down. Items take their places in
the patterns by their number within the class; those left over are packed by best fit, in groups of bounded size.

Scale: the histogram and the patterns are of bounded size (CLASSES classes) whatever the input, so only they pass through
the driver. Items are numbered within a class in two levels, by a hash bucket and over bucket totals, so a class with a
third of all items is spread over tasks, the more the more items there are; an item finds its place in the table of
pattern slots, a few for each class, by its class and the range of numbers that a slot takes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from looseleaf.session import checkpointed

#: Size classes of a capacity; patterns drawn of many items; classes that a pattern leaves unused at most.
CLASSES, DRAWN, SLACK = 512, 4000, 2
#: Items that one task packs by best fit at once.
GROUP = 20_000
#: Items of all classes numbered together, on average.
BUCKET = 50_000


def byte_tokens(text: Column) -> Column:
    """Tokens of a text under the public byte-level tokenizer: one for each UTF-8 byte and an end mark."""
    return F.octet_length(text) + F.lit(1)


def split_items(items: DataFrame, capacity: int) -> DataFrame:
    """(id, part, size): items over the capacity in full parts and a rest; others whole, as part 0. Null sizes count as 0."""
    size = F.coalesce("size", F.lit(0)).cast("bigint")
    parts = F.greatest(F.lit(1), F.ceil(size / capacity))
    x = items.select("id", size.alias("size"), F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("part"))
    return x.select("id", "part", F.least(F.lit(capacity), F.col("size") - F.col("part") * capacity).alias("size"))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x that makes |ax - b| small, for non-negative a and b, by multiplicative steps."""
    x, target = np.full(a.shape[1], b.sum() / max(1.0, a.sum())), a.T @ b
    for _ in range(rounds):
        x *= target / np.maximum(a.T @ (a @ x), 1e-12)
    return x


def patterns(counts: dict[int, int], classes: int = CLASSES, drawn: int = DRAWN, slack: int = SLACK) -> list[tuple[int, ...]]:
    """Multisets of size classes that fill classes units but for slack.

    All of two items and all of three that fill a container to the unit; of more, drawn ones: classes are drawn as often
    as they occur until one more item can close the container. The draws are seeded, so the same histogram gives the same
    patterns.
    """
    present = np.array(sorted(counts))
    held, out = set(present.tolist()), set()
    for c in held:
        if classes - slack <= c:
            out.add((c,))
        for d in range(max(1, classes - c - slack), classes - c + 1):
            if d in held and d <= c:
                out.add((c, d))
    small = present[present <= classes - 2]
    for i, c in enumerate(small):
        for d in small[: i + 1]:
            e = classes - int(c) - int(d)
            if 0 < e <= d and e in held:
                out.add((int(c), int(d), e))
    rng, weights = np.random.default_rng(1), np.array([counts[c] for c in present], float)
    draws = rng.choice(present, size=(drawn, 48), p=weights / weights.sum()) if len(present) else np.zeros((0, 48), int)
    for row in draws:
        left, chosen = classes, []
        for c in row.tolist():
            if c < left - slack:
                chosen.append(c)
                left -= c
            k = int(np.searchsorted(present, left, "right")) - 1
            if chosen and k >= 0 and present[k] >= left - slack:
                out.add(tuple(sorted([*chosen, int(present[k])], reverse=True)))
                if len(chosen) > 1:
                    break
    return sorted(out, reverse=True)


def fit_patterns(counts: dict[int, int], classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats), never using more items of a class than there are."""
    found = patterns(counts, classes)
    if not found:
        return []
    order = sorted(counts)
    row = {c: i for i, c in enumerate(order)}
    a = np.zeros((len(order), len(found)))
    for j, p in enumerate(found):
        for c in p:
            a[row[c], j] += 1
    b = np.array([counts[c] for c in order], float)
    # few patterns with many repeats round better than many with few
    best = np.argsort(-nnls(a, b))[: 2 * len(order)]
    x = np.zeros(len(found))
    x[best] = nnls(a[:, best], b)
    left, out = Counter(counts), []
    for j in np.argsort(-x):
        need = Counter(found[j])
        times = min([int(x[j] + 1e-6), *(left[c] // n for c, n in need.items())])
        if times > 0:
            out.append((found[j], times))
            for c, n in need.items():
                left[c] -= n * times
    for p in sorted(found, key=lambda p: (-sum(p), len(p))):  # what rounding left over
        need = Counter(p)
        if (times := min(left[c] // n for c, n in need.items())) > 0:
            out.append((p, times))
            for c, n in need.items():
                left[c] -= n * times
    return out


def _numbered(parts: DataFrame, buckets: int) -> DataFrame:
    """parts with no, their number within the class from 0."""
    x = parts.withColumn("bucket", F.pmod(F.xxhash64("id", "part"), F.lit(buckets)).cast("int"))
    totals = x.groupBy("class", "bucket").count()
    before = totals.select("class", "bucket", F.coalesce(F.sum("count").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("class", "bucket").orderBy("id", "part")
    return x.withColumn("no", F.row_number().over(within) - 1).join(before, ["class", "bucket"]).withColumn("no", F.col("no") + F.col("before")).drop("before", "bucket")


def _best_fit(sizes: list[tuple[int, int]], capacity: int) -> list[int]:
    """Container of each (size, index), largest first, each into the fullest that has room."""
    room: list[tuple[int, int]] = []
    where, n = [0] * len(sizes), 0
    for size, i in sorted(sizes, reverse=True):
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, c = room.pop(k)
        else:
            left, c, n = capacity, n, n + 1
        where[i] = c
        insort(room, (left - size, c))
    return where


def pack(items: DataFrame, capacity: int, group: int = GROUP) -> DataFrame:
    """(id, part, size, container): every part of every item in a container of the capacity.

    items: (id, size). Only items over the capacity are split. Containers are numbered by strings: of a pattern, its
    repeat and place, or of a group packed by best fit. Repeated rows of an id are packed each; an empty table gives no
    rows; items of size 0 take a place like any other.
    """
    unit = capacity / CLASSES
    cls = F.greatest(F.lit(1), F.ceil(F.col("size") / unit)).cast("int")  # a class never understates a size
    parts = split_items(items, capacity).withColumn("class", F.least(F.lit(CLASSES), cls))
    full = parts.where(F.col("class") == CLASSES).select("id", "part", "size", F.concat_ws("-", F.lit("f"), "id", "part").alias("container"))
    small = parts.where(F.col("class") < CLASSES)
    counts = {r[0]: r[1] for r in small.groupBy("class").count().collect()}
    rest = checkpointed(_numbered(small, max(8, -(-sum(counts.values()) // BUCKET))))
    slots, used = [], Counter()
    for j, (p, times) in enumerate(fit_patterns(counts)):
        for c, n in Counter(p).items():
            slots.append((c, used[c], used[c] + n * times, j, n))
            used[c] += n * times
    spark = items.sparkSession
    table = spark.createDataFrame(slots, "class int, lo bigint, hi bigint, pattern int, n int")
    taken = F.broadcast(table)  # a few patterns for each of CLASSES classes
    placed = rest.join(taken, (rest["class"] == taken["class"]) & (rest["no"] >= taken["lo"]) & (rest["no"] < taken["hi"]), "left").drop(taken["class"])
    done = placed.where("pattern is not null").select("id", "part", "size", F.concat_ws("-", F.lit("p"), "pattern", F.floor((F.col("no") - F.col("lo")) / F.col("n"))).alias("container"))
    left = placed.where("pattern is null").select("id", "part", "size")
    n_left = sum(counts.values()) - sum(used.values())
    groups = max(1, -(-n_left // group))

    def fit(df: pd.DataFrame) -> pd.DataFrame:
        where = _best_fit([(int(s), i) for i, s in enumerate(df["size"])], capacity)
        return pd.DataFrame({"id": df["id"], "part": df["part"], "size": df["size"], "container": [f"r-{g}-{c}" for g, c in zip(df["g"], where)]})

    kind = dict(items.dtypes)["id"]
    residue = left.withColumn("g", F.pmod(F.xxhash64("id", "part", F.lit(3)), F.lit(groups)).cast("int")).groupBy("g").applyInPandas(fit, f"id {kind}, part int, size bigint, container string")
    return full.select("id", "part", F.col("size").cast("bigint"), "container").unionByName(done.select("id", "part", F.col("size").cast("bigint"), "container")).unionByName(residue)


def pack_all(items: DataFrame, sizes: DataFrame) -> DataFrame:
    """(capacity, id, part, size, container) for every capacity of sizes, a short list."""
    items, out = checkpointed(items.select("id", "size")), None
    for (capacity,) in sizes.select("capacity").where("capacity > 0").distinct().orderBy("capacity").collect():
        one = pack(items, capacity).select(F.lit(capacity).cast("bigint").alias("capacity"), "id", "part", "size", "container")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return items.sparkSession.createDataFrame([], f"capacity bigint, id {dict(items.dtypes)['id']}, part int, size bigint, container string")
    return out
