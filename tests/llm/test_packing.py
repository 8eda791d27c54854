import random

import numpy as np
from pyspark.sql import functions as F

from looseleaf.llm.packing import nnls, pack, pack_all


def packed(spark, sizes, capacity, **k):
    return [tuple(r) for r in pack(spark.createDataFrame(list(enumerate(sizes)), "id bigint, size bigint"), capacity, **k).collect()]


def check(rows, sizes, capacity):
    load, whole = {}, {}
    for i, _, s, c in rows:
        load[c] = load.get(c, 0) + s
        whole.setdefault(i, []).append(s)
    assert max(load.values()) <= capacity
    for i, s in enumerate(sizes):
        assert sum(whole[i]) == (s or 0)
        assert len(whole[i]) == max(1, -(-(s or 0) // capacity))
    return sum(load.values()) / (capacity * len(load))


def test_random_sizes_fill_well(spark):
    rnd = random.Random(1)
    sizes = [int(rnd.lognormvariate(5.5, 0.9)) + 1 for _ in range(3000)]
    for capacity in (500, 2048):
        assert check(packed(spark, sizes, capacity), sizes, capacity) > 0.985
    assert check(packed(spark, sizes, 1000, group=300), sizes, 1000) > 0.95


def test_edges(spark):
    sizes = [0, None, 100, 100, 101, 250, 1, 99]
    check(packed(spark, sizes, 100), sizes, 100)
    assert packed(spark, [], 100) == []
    check(packed(spark, [60] * 50, 100), [60] * 50, 100)


def test_all_capacities_and_repeated_rows(spark):
    items = spark.createDataFrame([(1, 10, "x"), (1, 10, "x"), (2, 30, "x")], "id bigint, size bigint, container string")
    sizes = spark.createDataFrame([(20,), (40,), (0,)], "capacity bigint")
    got = pack_all(items, sizes)
    assert {r[0]: (r[1], r[2]) for r in got.groupBy("capacity").agg(F.count("*"), F.sum("size")).collect()} == {20: (4, 50), 40: (3, 50)}
    assert pack_all(items, sizes.limit(0)).count() == 0


def test_nnls_fits():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    assert np.abs(a @ nnls(a, np.array([8.0, 5.0]), 4000) - [8, 5]).max() < 0.05
