import unicodedata

from looseleaf.llm.plain_form import not_plain, plain_forms

CASES = {
    "Crème": "Crème", "a b‑c": "a b-c", "ＡＢ１２": "AB12", "x​y­z﻿": "xyz", "Тongue": "Tongue", "covеrs": "covers",
    "Жгучий Лист": "Жгучий Лист", "Жгучий Лиcт": "Жгучий Лист", "β-Kalunin": "β-Kalunin", "а curled": "a curled", "เเก้ว": "แก้ว", "น้ําค้าง": "น้ำค้าง", "คํา": "คำ",
    "plain (2) ": "plain (2) ", "": "", "ｖāｔａ": "vāta", "ṩ": "ṩ", "q̣̇": "q̣̇", "ο": "ο", "οf it": "of it",
}


def forms(spark, values):
    return {r["value"]: r["plain"] for r in plain_forms(spark.createDataFrame([(v, 1) for v in values], "value string, k int")).collect()}


def test_cases(spark):
    assert forms(spark, [*CASES, *CASES]) == CASES


def test_canonical_composition_equals_the_standard(spark):
    texts = [unicodedata.normalize("NFD", x) for x in ("čŏṩệñ", "Ǖx", "й", "ΐ")] + ["ậ", "ậ", "́x", "é́", "ó̧"]
    assert forms(spark, texts) == {x: unicodedata.normalize("NFC", x) for x in texts}


def test_cells(spark):
    rows = [("s", 1, "f", "a"), ("s", 2, "f", "a\u00a0b"), ("s", 2, "f", "a\u00a0b"), ("s", 3, "f", None), ("s", 4, "f", "")]
    df = spark.createDataFrame(rows, "src string, row_id bigint, field string, value string")
    assert [tuple(r) for r in not_plain(df).collect()] == [("s", 2, "f")]
    assert not_plain(df.limit(0)).count() == 0


def test_very_long_text(spark):
    text = "ab" * 50_000 + "｡" + "é"
    assert forms(spark, [text])[text] == unicodedata.normalize("NFC", "ab" * 50_000 + "。" + "é")
