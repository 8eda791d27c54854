import random

from looseleaf.llm.canonical import map_cells, match_values

TERMS = [(1, "color", "แดงสด", "bright red"), (2, "color", "ชมพูอ่อน", "light pink"), (3, "color", "ซีดขาว", "pale white"), (4, "color", "ม่วงคล้ำ", "dusky purple"), (5, "color", "น้ำตาลไหม้", "burnt umber"), (6, "other", "ผักคำตะวัน", "Ostratra senvedica")]
SCHEMA = "term_id bigint, axis string, term string, term_en string"
CELLS = "src string, row_id bigint, field string, axis string, value string, score int, part string"


def test_accepts_and_rejects(spark):
    terms = spark.createDataFrame(TERMS, SCHEMA)
    typed = {"Bright  Red": 1, "brigth red": 1, "red, bright": 1, "แดงดส": 1, "light_pink": 2, "ชมพูออน": 2, "ซีดขาว (pale white)": 3, "dusky purlpe.": 4, "the usual": 0, "olive": 0, "กินข้าวมา": 0, "bυrnt umber": 5, "น้ําตาลไหม้": 5}
    rows = [("t", i, "color", "color", v, 1, "x") for i, v in enumerate(typed)]
    rows += [("t", 90, "color", "color", None, 1, "x"), ("t", 91, "color", "color", "", 1, "x"), ("t", 92, "color", "color", "-", 1, "x"), ("t", 93, "color", "color", "bright red", 1, "x"), ("t", 94, "none", "none", "bright rd", 1, "x")]
    rows += [("t", 95, "other", "other", "O. senvedica", 1, "x"), rows[0]]
    got = {r["row_id"]: r["term_id"] for r in map_cells(spark.createDataFrame(rows, CELLS), terms).collect()}
    assert got == {**{i: x for i, x in enumerate(typed.values())}, 94: 0, 95: 6}


def test_wrappings_are_learned(spark):
    terms = spark.createDataFrame(TERMS, SCHEMA)
    values = [("color", f"i believe it could perhaps be {t[3]}") for t in TERMS[:5]]
    got = match_values(spark.createDataFrame(values, "axis string, value string"), terms).collect()
    assert all(r["score"] > 0.99 for r in got) and sorted(r["term_id"] for r in got) == [1, 2, 3, 4, 5]


def test_one_edit_finds_its_term(spark):
    rnd, terms, values, want = random.Random(3), [], [], {}
    for k in range(40):
        name = "".join(rnd.choice("abcdefghijklmnop") for _ in range(10))
        terms.append((k + 1, "a", name, None))
        i = rnd.randrange(9)
        v = rnd.choice([name[:i] + name[i + 1 :], name[:i] + name[i + 1] + name[i] + name[i + 2 :], name[:i] + "z" + name[i + 1 :], name[:i] + name[i] + name[i:]])
        values.append(("a", v))
        want[v] = k + 1
    got = match_values(spark.createDataFrame(values, "axis string, value string"), spark.createDataFrame(terms, SCHEMA))
    assert sum(want[r["value"]] == r["term_id"] for r in got.collect()) >= 39


def test_empty_sides(spark):
    terms = spark.createDataFrame(TERMS, SCHEMA)
    cells = spark.createDataFrame([("t", 1, "f", "color", "rad", 1, "x")], CELLS)
    assert map_cells(cells.limit(0), terms).count() == 0
    assert [r["term_id"] for r in map_cells(cells, terms.limit(0)).collect()] == [0]
