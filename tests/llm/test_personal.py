from pyspark.sql import functions as F

from looseleaf.llm.personal import mention_rows, mentions, redact

CASES = [
    ("write to a.b-c@mail.example. ok", ["email"]),
    ("ส่งที่ a_b (at) post dot example ได้", ["email"]),
    ("A.B@X.EXAMPLE and c [at] d.example", ["email", "email"]),
    ("9 caps @ bedtime", []),
    ("call 081-234-5678 or (+66)81-234-5678, +66 81 234 5678, (02) 123 4567, ๐๘๑-๒๓๔-๕๖๗๘", ["phone"] * 5),
    ("photo P-0823-0041, 30 กรัม, 2025-01-02, น. 204-211, 2-3-2", []),
    ("ID card 9-4183-15121-08-1 lot 8855059254467", ["id_number"]),
    ("เลข passport ZX6722024 ค่ะ", ["id_number"]),
    ("I live at 47 Blue Heron Street, Apt 32, Chakabua valley, ok", ["address"]),
    ("บ้าน 75 ถ.ดอนระฆัง ตำบลหนองหมอก อำเภอนิมิต โทร", ["address"]),
    ("อยู่ที่ บ้านเลขที่ 187/95 ซอยคลองเมฆ 14 ถนนบ้านไร่", ["address"]),
    ("at 12 Moo 3, Kiln Lane, Orasa Lomrangsi here", ["address", "person_name"]),
    ("ถนนลื่นเดินลำบาก near Praosaravi canal", []),
    ("this is Mrs. Dao Sen, Dr. said rest", ["person_name"]),
    ("the sister of Orasa Lomrangsi. Malai Lomwilai here", ["person_name", "person_name"]),
    ("ฝากบอก นายศิริดา แสงสมมุติวงศ์ ด้วย สมุนไพรคุณภาพดี คุณแม่ก็เป็น หมอให้พัก", ["person_name"]),
    ("น.ส.นลิดา เป็นคนถาม", ["person_name"]),
    ("", []),
    ("x" * 100 + "@mail.example", ["email"]),
    ("write mailto:a.b@mail.example or tel:+14155550199 please", ["email", "phone"]),
    ("+1 415 555 0199 or +44 20 7946 0958", ["phone", "phone"]),
    ("SSN 123-45-6789 but lot 123-45-6789", ["id_number"]),
    ("IBAN GB82 WEST 1234 5698 7654 32 and card 4539 1488 0343 6467, not 4539 1488 0343 6468", ["account_number", "account_number"]),
    ("account no. 123-456-7890-1 is mine", ["account_number"]),
    ("My name is John Smith", ["person_name"]),
    ("at 12  Baker Street now", ["address"]),
    ("at 12 " + "Very " * 40 + "Long Street now", ["address"]),
]


def test_cases():
    for text, kinds in CASES:
        assert [k for k, _, _ in mentions(text)] == kinds, text


def test_the_filter_lets_every_mention_pass(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "row_id bigint, value string").withColumn("src", F.lit("s"))
    got = {}
    for r in mention_rows(df).collect():
        got[r["row_id"]] = got.get(r["row_id"], 0) + 1
    assert got == {i: len(kinds) for i, (_, kinds) in enumerate(CASES) if kinds}


def test_spans_do_not_overlap_and_lie_inside():
    for text, _ in CASES:
        end = 0
        for _, s, e in mentions(text * 3):
            assert end <= s < e <= len(text * 3)
            end = e


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "x a@b.example, โทร 081-234-5678 y", "k"), (1, "x a@b.example, โทร 081-234-5678 y", "k"), (2, None, "k"), (3, "", "k"), (4, "no data", "k")]
    df = spark.createDataFrame(rows, "id int, text string, mentions string")
    got = redact(df, "text")
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "x [EMAIL], โทร [PHONE] y", "k")] * 2 + [(2, None, "k"), (3, "", "k"), (4, "no data", "k")], key=repr)


def test_rows_count_by_kind(spark):
    df = spark.createDataFrame([("s", 1, "a@b.example c@d.example 081-234-5678"), ("s", 2, None), ("s", 3, "z " * 200_000 + "a@b.example")], "src string, row_id bigint, value string")
    got = sorted(map(tuple, mention_rows(df).collect()))
    assert got == [("s", 1, "email", 1), ("s", 1, "email", 2), ("s", 1, "phone", 1), ("s", 3, "email", 1)]
    assert mention_rows(df.limit(0)).count() == 0


def test_common_words_are_no_names(spark):
    rows = ["we like green tea and holy basil", "green tea, holy basil", "- Green Tea", "this is Holy Basil", "this is Orasa Lomrangsi", "My name is John Smith", "Holy days told me so", None, ""]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(rows)], "src string, row_id bigint, value string")
    assert sorted((r["row_id"], r["kind"]) for r in mention_rows(df).collect()) == [(4, "person_name"), (5, "person_name")]


#: Written by hand, with nothing of the test tables in them: text and the mentions in it.
HELD_OUT = [
    ("Reach Anna Kowalski's office at anna.kowalski+work@clinic.example.org or 0049 30 901820.", {"email": 1, "phone": 1}),
    ("Please wire it to DE89 3704 0044 0532 0130 00, thanks.", {"account_number": 1}),
    ("Dr. Okafor saw me; my card is 4111 1111 1111 1111.", {"person_name": 1, "account_number": 1}),
    ("We moved to 221 Baker Street last May.", {"address": 1}),
    ("Call me on (02) 555 0147 or +61 2 9374 4000", {"phone": 2}),
    ("ติดต่อ คุณสมหญิง ใจดีวงศ์ โทร 089 123 4567", {"person_name": 1, "phone": 1}),
    ("passport AB1234567 was lost in Lyon", {"id_number": 1}),
    ("My SSN is 219-09-9999.", {"id_number": 1}),
    ("signed, Maria Lopez", {"person_name": 1}),
    ("my name is Wei Chen, account number 1234567890", {"person_name": 1, "account_number": 1}),
    ("lot 4111111111111112 expires 2025-10-11, dose 500-1000 mg", {}),
    ("Chapter 12 runs on pages 120-134; see photo P-1234-5678.", {}),
    ("take 3 tablets @ noon, 100 ml each", {}),
    ("ISBN 978-3-16-148410-0 costs 1,234,567 baht", {}),
]


def test_precision_and_recall_on_held_out_cases():
    true = found = both = 0
    for text, want in HELD_OUT:
        got = {}
        for k, _, _ in mentions(text):
            got[k] = got.get(k, 0) + 1
        true += sum(want.values())
        found += sum(got.values())
        both += sum(min(n, got.get(k, 0)) for k, n in want.items())
        if got != want:
            print(text, got, want)
    assert both / found >= 0.9 and both / true >= 0.85
