"""Snapshots and change feeds on small fixtures and against row-by-row models."""

import random

from pyspark.sql import functions as F

from looseleaf.operators import change_feed as cf
from looseleaf.operators.snapshot_diff import snapshot_changes

MANIFEST = "snapshot_no int, delivery_no int, uid string, sha256 string, node int, pair string"


def changes(spark, rows, **k):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], MANIFEST)  # extra columns with clashing names
    return sorted(map(tuple, snapshot_changes(df, **k).collect()))


def test_statuses_spelling_and_nulls(spark):
    rows = [
        (1, 1, "a", "AB"), (1, 1, " A ", "ab"), (1, 1, "b", None), (1, 1, "c", "01"), (1, 1, "d", "02"),
        (3, 2, "a", "ab"), (3, 2, "b", None), (3, 2, "c", None), (3, 2, "e", "05"), (3, 1, "z", "99"),
        (None, 1, "q", "1"), (3, 2, None, "1"), (3, 2, "  ", "1"),
    ]
    assert changes(spark, rows) == [(3, "c", "changed"), (3, "d", "removed"), (3, "e", "new")]
    assert changes(spark, rows, leaf_bits=4) == changes(spark, rows)


def test_first_snapshot_and_empty(spark):
    assert changes(spark, [(7, 1, "a", "1")]) == []
    assert changes(spark, []) == []


def test_many_keys_against_sets(spark):
    rnd = random.Random(1)
    snaps = {n: {f"k{rnd.randrange(400)}": str(rnd.randrange(3)) for _ in range(300)} for n in (1, 2, 4)}
    rows = [(n, 1, k, v) for n, s in snaps.items() for k, v in s.items()]
    want = []
    for old, new in ((1, 2), (2, 4)):
        a, b = snaps[old], snaps[new]
        want += [(new, k, "new") for k in b.keys() - a.keys()] + [(new, k, "removed") for k in a.keys() - b.keys()] + [(new, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]]
    assert changes(spark, rows, leaf_bits=8) == sorted(want)


OPS = "user_id string, seq int, op string, field string, item_id string, text string, live int"


def model(ops):
    """Operations applied one after the other."""
    state, singles, counters = {}, {}, {}
    for user, seq, op, field, item, text in sorted({(u, s, o, f or "", i or "", t or "") for u, s, o, f, i, t in ops}):
        if op == "add" and field in cf.ID_PREFIXES and text:
            counters[user, field] = counters.get((user, field), 0) + 1
            state[user, field, cf.ID_PREFIXES[field] + str(counters[user, field])] = seq
        elif op == "update" and text and (user, field, item) in state:
            state[user, field, item] = seq
        elif op == "remove" and field in cf.ID_PREFIXES:
            state.pop((user, field, item), None)
        elif op == "set_notes" or op == "set_sex" and text:
            singles[user, op[4:]] = seq
    rows = [(*k, v) for k, v in state.items()] + [(u, f, "", s) for (u, f), s in singles.items()]
    return sorted(rows + [(u, "id_counters", f, n) for (u, f), n in counters.items()])


def random_ops(seed, n=150):
    rnd = random.Random(seed)
    ops, seqs = [], {}
    for _ in range(n):
        u = rnd.choice("xyz")
        seqs[u] = seqs.get(u, 0) + rnd.choice([1, 1, 2])
        op = rnd.choice(["add", "add", "update", "remove", "set_sex", "set_notes", "delete"])
        field = rnd.choice(["allergies", "habits", "diet", None])
        ops.append((u, seqs[u], op, field, rnd.choice(["a1", "a2", "h1", "h3", "", None]), rnd.choice(["t", "u", "", None])))
    return ops + rnd.sample(ops, 40)


def test_profile_against_model(spark):
    for seed in (1, 2):
        ops = random_ops(seed)
        random.Random(seed).shuffle(ops)
        df = spark.createDataFrame([(*o, 0) for o in ops], OPS)
        for block in (4, 4096):
            got = cf.profile_state(df, block=block).where("live").select("user_id", "field", "item_id", "value_no")
            assert sorted(map(tuple, got.collect())) == model(ops)


def test_profile_goes_on_from_a_base(spark):
    ops = sorted(set(random_ops(3, 80)), key=repr)
    early, late = [o for o in ops if o[1] <= 20], [o for o in ops if o[1] > 20]
    make = lambda x: spark.createDataFrame([(*o, 0) for o in x], OPS)
    base = cf.profile_state(make(early))
    got = cf.profile_state(make(late), base).where("live").select("user_id", "field", "item_id", "value_no")
    assert sorted(map(tuple, got.collect())) == model(ops)


def test_profile_is_the_same_for_any_split_and_order(spark):
    ops = sorted(set(random_ops(4, 100)), key=repr)
    make = lambda x: spark.createDataFrame([(*o, 0) for o in x], OPS)
    want = model(ops)
    for seed in range(3):
        rnd, state = random.Random(seed), None
        rnd.shuffle(ops)
        cuts = sorted(rnd.sample(range(len(ops)), 2))
        for a, b in zip([0, *cuts], [*cuts, len(ops)]):
            again = rnd.sample(ops[:a], min(a, 5))  # deliveries repeat across parts
            state = spark.createDataFrame(cf.profile_state(make(ops[a:b] + again), state).collect(), cf.profile_state(make([])).schema)
        assert sorted(map(tuple, state.where("live").select("user_id", "field", "item_id", "value_no").collect())) == want


def test_late_changes_meet_a_base(spark):
    make = lambda *x: spark.createDataFrame([(*o, 0) for o in x], OPS)
    base = cf.profile_state(make(("u", 1, "add", "allergies", "", "nuts"), ("u", 5, "update", "allergies", "a1", "all nuts")))
    gone = cf.profile_state(make(("u", 3, "remove", "allergies", "a1", "")), base)
    assert not gone.where("field = 'allergies'").first()["live"]
    base = cf.profile_state(make(("u", 5, "add", "allergies", "", "late one")))
    ids = cf.profile_state(make(("u", 2, "add", "allergies", "", "first")), base).where("field = 'allergies'").collect()
    assert {(r["item_id"], r["text"]) for r in ids} == {("a1", "first"), ("a2", "late one")}


def test_dates_and_empty(spark):
    rows = [("u", i, "set_birth_date", None, None, t, 0) for i, t in enumerate(["1990-02-28", "1990-02-30", "19900228", "12/5/1988", "", None, "0000-01-01"], 1)]
    got = cf.profile_rows(spark.createDataFrame(rows, OPS)).collect()
    assert [tuple(r) for r in got] == [("u", "birth_date", "", 1)]
    assert cf.profile_rows(spark.createDataFrame([], OPS)).count() == 0


def test_fold_feed_keeps_tombstones(spark):
    feed = spark.createDataFrame([("k", 3, "delete", None), ("k", 2, "set", "b"), ("k", 2, "set", "b"), ("j", None, "set", "x"), (None, 1, "set", "n")], "key string, seq int, op string, v string")
    base = spark.createDataFrame([("k", 1, None, "a"), ("m", 1, None, "c")], "key string, seq int, op string, v string")
    got = {r["key"]: (r["seq"], r["v"], r["live"]) for r in cf.fold_feed(feed, ["key"], "seq", "op", ["v"], base).collect()}
    assert got == {"k": (3, None, False), "m": (1, "c", True), None: (1, "n", True)}
    again = cf.fold_feed(spark.createDataFrame([("k", 2, "set", "late")], "key string, seq int, op string, v string"), ["key"], "seq", "op", ["v"], cf.fold_feed(feed, ["key"], "seq", "op", ["v"], base).drop("live"))
    assert not again.where(F.col("key") == "k").first()["live"]
