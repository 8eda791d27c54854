"""Personal information in free text: anchors found by Aho-Corasick, grown by local parsers.

One automaton finds at-signs, schemes, digits, titles, cue words and parts of addresses. Around each anchor a small
deterministic parser grows the mention and validates it: addresses of mail need a domain, citizen numbers their check
digit, phone numbers a dialling prefix (of other countries a plus sign and a fitting length), account numbers and cards
their check sum, places a house number, names a title, a family name or two capitalised words beside a cue, unless both
are words that the corpus mostly writes in lower case ("this is Holy Basil"). Mentions have no greatest length: a parser
walks from its anchor as far as the mention goes.

Scale: a narrow projection. Texts without an anchor are answered in the JVM, by a pattern made from the same list of
anchors; the others pass through one Arrow batch function that returns spans, and the placeholders are put in by Spark
expressions. Only the counts of words are shuffled; of them the tasks get a filter of fixed size (2**COMMON_BITS bits).
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Titles and cue words, as they are written in Thai and English.
TITLES_EN = ["Mr.", "Mrs.", "Ms.", "Ms", "Miss", "Dr.", "Khun"]
TITLES_TH = ["คุณ", "นางสาว", "นาย", "นาง", "น.ส.", "หมอ", "ป้า", "ลุง"]
NAME_BEFORE = ["asking for ", "sister of ", "brother of ", "mother of ", "father of ", "wife of ", "husband of ", "my name is ", "this is ", "signed, ", "signed ", "- ", "ฝากบอก ", "แม่ของ ", "พ่อของ ", "ลงชื่อ ", "ชื่อ ", "ถามแทน "]
NAME_AFTER = [" told me", " here", " เป็นคนถาม", " กับลูก"]
FAMILY_ENDINGS = ["วงศ์", "พงศ์", "กุล", "ทอง", "ศรี", "ทิพย์", "วัลย์", "พันธ์", "รัตน์", "สุข", "ชัย", "เจริญ"]
AT_SIGNS = ["@", "＠", "[at]", "(at)"]
PLACES = ["ซอย", "หมู่", "ถนน", "ถ.", "ตำบล", "ต.", "Soi ", "Moo ", " Street", " Road", " Lane", " Avenue"]
PASSPORTS = ["passport", "Passport", "พาสปอร์ต", "หนังสือเดินทาง"]
LOTS = ("lot ", "ล็อต ", "lot no. ", "batch ")
DIGITS = "0123456789๐๑๒๓๔๕๖๗๘๙"
SCHEMES = ["mailto:", "tel:"]
ACCOUNTS = ["iban", "account", "acct", "card", "บัญชี", "บัตร"]
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "account_number": "[ACCOUNT]", "address": "[ADDRESS]", "person_name": "[NAME]"}

_ASCII = str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._+\-]*[A-Za-z0-9])?$")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| dot )[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"(?:(?:\(\+66\)|\+66)[ -]?[0-9]{1,2}[-. ]?[0-9]{3}[-. ]?[0-9]{4}|\(0[0-9]{1,2}\) ?[0-9]{3}[-. ]?[0-9]{4}|0[0-9]{2}[-. ]?[0-9]{3}[-. ]?[0-9]{4}|0[2-7][-. ]?[0-9]{3}[-. ]?[0-9]{4})(?![0-9])")
_ABROAD = re.compile(r"(?:\+|00)[1-9][0-9]{0,2}(?:[-. ]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])")
_DIALLED = re.compile(r"\+?[0-9](?:[-. ()]?[0-9]){5,14}(?![0-9])")
_SOCIAL = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CARD = re.compile(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
_ACCOUNT = re.compile(r"(?:\s*(?:no\.?|number|เลขที่|is|:))*\s*([0-9](?:[- ]?[0-9]){7,17})(?![0-9])", re.I)
_CITIZEN = re.compile(r"(?:[0-9]{13}|[0-9]([- ])[0-9]{4}\1[0-9]{5}\1[0-9]{2}\1[0-9])(?![0-9])")
_PASSPORT = re.compile(r"\s*(?:no\.?\s*|เลขที่\s*)?([A-Z]{1,2}[0-9]{6,8})(?![0-9])")
_TH = "ก-ฺเ-๎"
_NAME = r"[A-Z][a-z]+"
_HOUSE = re.compile(r"(?:(?:บ้านเลขที่|เลขที่)\s*)?(?<![0-9/])[0-9]{1,4}(?:/[0-9]{1,4})?\s+(?:[A-Z][a-z]+ )*(?:[A-Z][a-z]+)?$")
_PART_TH = rf"(?:หมู่(?:ที่)? ?[0-9]+|ซอย[{_TH}]+(?: [0-9]+)?|(?:ถนน|ถ\.) ?[{_TH}]+|(?:ตำบล|ต\.|แขวง) ?[{_TH}]+|(?:อำเภอ|อ\.|เขต) ?[{_TH}]+|(?:จังหวัด|จ\.) ?[{_TH}]+)"
_PLACE_TH = re.compile(rf"{_PART_TH}(?: {_PART_TH})+(?: [0-9]{{5}}(?![0-9]))?|{_PART_TH}")
_PART_EN = rf"(?:Moo [0-9]+|Soi (?:{_NAME} )+[0-9]+|(?:{_NAME} )+(?:Street|Road|Lane|Avenue)|Apt\.? [0-9]+)"
_PLACE_EN = re.compile(rf"(?:(?:{_NAME} )*{_NAME})?\s?(?:Street|Road|Lane|Avenue|Moo [0-9]+|Soi (?:{_NAME} )+[0-9]+)(?:,? {_PART_EN})*(?:, (?!Mr|Mrs|Ms|Miss|Dr|Khun){_NAME}\b(?: (?:village|hill|canal|delta|valley)|(?! [A-Z])))?(?: [0-9]{{5}}(?![0-9]))?")
_TITLE_EN = "(?:" + "|".join(map(re.escape, TITLES_EN)) + ")"
_TITLE_TH = "(?:" + "|".join(map(re.escape, TITLES_TH)) + ")"
_FAMILY = rf"[{_TH}]*(?:{'|'.join(FAMILY_ENDINGS)})(?![{_TH}])"
_PERSON = re.compile(rf"{_TITLE_EN} ?{_NAME}(?: {_NAME})?|{_NAME} {_NAME}|{_TITLE_TH} ?[{_TH}]{{2,}} {_FAMILY}|{_TITLE_TH} ?[{_TH}]{{2,}}|[{_TH}]{{2,}} {_FAMILY}")
_BEFORE = re.compile(rf"(?:{_TITLE_EN} ?{_NAME}(?: {_NAME})?|{_NAME} {_NAME}|{_TITLE_TH} ?[{_TH}]{{2,}} {_FAMILY}|(?<![{_TH}]){_TITLE_TH} ?[{_TH}]{{2,}}|(?<![{_TH}])[{_TH}]{{2,}} {_FAMILY})$")
_TITLED = re.compile(rf"{_TITLE_EN} ?{_NAME}(?: {_NAME})?|{_TITLE_TH} ?[{_TH}]{{2,}} {_FAMILY}")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._+-")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: Kind of each anchor; found whatever the case of its Latin letters, which the parsers look at.
ANCHORS = {"at": AT_SIGNS, "scheme": SCHEMES, "account": ACCOUNTS, "before": NAME_BEFORE, "after": NAME_AFTER, "title": [*(t + " " for t in TITLES_EN), *TITLES_TH], "place": PLACES, "passport": PASSPORTS}


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in [("digit", [*DIGITS, "+", "(+66", "(0"]), *ANCHORS.items()]:
        for w in words:
            a.add_word(w.translate(_LOWER), (kind, len(w)))
    a.make_automaton()
    return a


#: What a text must hold to have an anchor that a parser can grow, for the JVM: an anchor, or seven digits with what stands between digits.
ANCHORED = "(?i)" + "|".join(["[0-9๐-๙](?:[-. ()]{0,2}[0-9๐-๙]){6}", "[a-z]{2}[0-9๐-๙]{2} ?[a-z0-9]{4}", *map(re.escape, dict.fromkeys(w.translate(_LOWER) for words in ANCHORS.values() for w in words))])


def _before_house(plain: str, start: int) -> int:
    """Where a house number, and capitalised words after it, begin before a street."""
    i = start
    while i > 0:
        j = i
        while j > 0 and plain[j - 1].isspace():
            j -= 1
        k = j
        while k > 0 and plain[k - 1].isascii() and plain[k - 1].isalpha():
            k -= 1
        if k == j:
            while k > 0 and (plain[k - 1].isdigit() or plain[k - 1] == "/"):
                k -= 1
            return max(0, k - 14)
        if not re.fullmatch("[A-Z][a-z]+", plain[k:j]):
            return j
        i = k
    return 0


def _before_name(text: str, start: int) -> int:
    """Where four words before a place begin."""
    i = start
    for _ in range(4):
        while i > 0 and text[i - 1].isspace():
            i -= 1
        while i > 0 and not text[i - 1].isspace():
            i -= 1
    return i


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def _iban(text: str) -> bool:
    x = text.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _check_digit(d: str) -> bool:
    return (11 - sum(int(d[i]) * (13 - i) for i in range(12)) % 11) % 10 == int(d[12])


#: Size of the filter of common words, as a power of two; independent of the data.
COMMON_BITS = 24


def common_words(texts: DataFrame, column: str) -> np.ndarray:
    """Filter of the words that stand in lower case at least as often as not, over all texts; parts of addresses of mail don't count."""
    word = F.explode(F.regexp_extract_all(column, F.lit(r"(?<![\w.+@-])[A-Za-z]{2,}(?![\w+@-]|\.\w|\s?[(\[]at)"), F.lit(0)))
    each = texts.where(F.col(column).isNotNull()).select(word.alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    low = F.sum(F.when(F.col("w") == F.lower("w"), F.col("n")).otherwise(0))
    common = each.groupBy(F.lower("w").alias("word")).agg(low.alias("low"), F.sum("n").alias("n")).where("2 * low >= n")
    at = [F.conv(F.substring(F.md5("word"), 1 + 6 * i, 6), 16, 10).cast("bigint") for i in range(2)]
    bits = common.select(F.explode(F.array(*at)).alias("p")).select(F.shiftright("p", 5).alias("at"), F.expr("shiftleft(1L, cast(p & 31 as int))").alias("bit"))
    rows = bits.groupBy("at").agg(F.bit_or("bit").alias("v")).toPandas()  # 2**(COMMON_BITS - 5) rows at most
    out = np.zeros(1 << (COMMON_BITS - 5), np.uint32)
    out[rows["at"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64).astype(np.uint32)
    return out


def _is_common(word: str, common: np.ndarray) -> bool:
    digest = hashlib.md5(word.lower().encode()).hexdigest()
    return all(common[p >> 5] >> np.uint32(p & 31) & 1 for p in (int(digest[:6], 16), int(digest[6:12], 16)))


def mentions(text: str, common: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every mention, in order of start; mentions don't overlap. common: a filter of common_words."""

    def is_name(span: str) -> bool:
        return common is None or re.fullmatch(f"{_NAME} {_NAME}", span) is None or not all(_is_common(w, common) for w in span.split())

    plain = text.translate(_ASCII)
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in PLACEHOLDERS}
    for last, (kind, size) in _automaton().iter(text.translate(_LOWER)):
        start, end = last - size + 1, last + 1
        if kind == "at":
            loose = text[start] in "[("
            stop = start
            while loose and stop > 0 and text[stop - 1] == " ":
                stop -= 1
            begin = stop
            while begin > 0 and text[begin - 1] in _LOCAL_CHARS:
                begin -= 1
            m = _LOCAL.search(text[begin:stop])
            d = _DOMAIN.match(text, end + (loose and text[end : end + 1] == " "))
            if m and d and "." in d.group().replace(" dot ", "."):
                found["email"].append((begin + m.start(), d.end()))
        elif kind == "scheme":
            if text[start:end].lower() == "tel:" and (m := _DIALLED.match(plain, end)):
                found["phone"].append((end, m.end()))
        elif kind == "account":
            if (m := _ACCOUNT.match(plain, end)) and not _CITIZEN.match(plain, m.start(1)) and not _PHONE.match(plain, m.start(1)):
                found["account_number"].append(m.span(1))
        elif kind == "digit":
            if start and (plain[start - 1].isdigit() or plain[start - 1] in "/"):
                continue
            joined = start and (plain[start - 1].isalpha() and plain[start - 1].isascii() or plain[start - 1] == "-")
            lot = text[max(0, start - 8) : start].lower().endswith(LOTS)
            if m := _CITIZEN.match(plain, start):
                if _check_digit(re.sub("[- ]", "", m.group())) and not lot:
                    found["id_number"].append((start, m.end()))
            if not joined and (m := _PHONE.match(plain, start)):
                found["phone"].append((start, m.end()))
            elif not joined and not re.search("[0-9][ -]$", plain[max(0, start - 2) : start]) and (m := _ABROAD.match(plain, start)) and 8 <= len(re.sub("[^0-9]", "", m.group())) - 2 * m.group().startswith("00") <= 15 and not lot and (m.group()[0] == "+" or " " in m.group()):
                found["phone"].append((start, m.end()))
            if not joined and not lot and (m := _SOCIAL.match(plain, start)):
                found["id_number"].append((start, m.end()))
            if not joined and not lot and (m := _CARD.match(plain, start)) and 14 <= len(re.sub("[ -]", "", m.group())) <= 19 and _luhn(re.sub("[ -]", "", m.group())):
                found["account_number"].append((start, m.end()))
            if start > 1 and text[start - 2 : start].isupper() and not (start > 2 and text[start - 3].isalnum()) and (m := _IBAN.match(plain, start - 2)) and _iban(m.group()):
                found["account_number"].append((start - 2, m.end()))
        elif kind == "passport":
            if m := _PASSPORT.match(plain, end):
                found["id_number"].append(m.span(1))
        elif kind == "place":
            back = _before_house(plain, start)
            if h := _HOUSE.search(plain[back:start]):
                thai = text[start] > "~"
                # a street named by words before its kind is matched again from the first of them
                words = re.search(r"(?:[A-Z][a-z]+ )*(?:[A-Z][a-z]+)?$", plain[back:start])
                at = start if thai else back + words.start()
                m = (_PLACE_TH if thai else _PLACE_EN).match(plain, at)
                named = text[start:end].strip() in ("Street", "Road", "Lane", "Avenue") and words.group() != ""  # a whole address in itself
                if m and (m.end() > end + 1 or named and m.end() == end) and (not thai or " " in m.group() or h.group().startswith(("บ้านเลขที่", "เลขที่"))):
                    found["address"].append((back + h.start(), m.end()))
        elif kind == "before":
            if start and text[start] == "-" and text[start - 1] not in " \n":
                continue
            if (m := _PERSON.match(text, end)) and is_name(m.group()):
                found["person_name"].append(m.span())
        elif kind == "after":
            back = _before_name(text, start)
            if (m := _BEFORE.search(text[back:start])) and is_name(m.group()):
                found["person_name"].append((back + m.start(), start))
        elif kind == "title" and not (start and (text[start - 1].isalpha() or "ัฺ" <= text[start - 1] <= "๎")):
            if m := _TITLED.match(text, start):
                found["person_name"].append(m.span())
    out: list[tuple[str, int, int]] = []
    for kind in PLACEHOLDERS:
        for s, e in sorted(set(found[kind]), key=lambda x: (x[0], -x[1])):
            if all(e <= a or b <= s for _, a, b in out):
                out.append((kind, s, e))
    return sorted(out, key=lambda x: x[1])


def with_mentions(df: DataFrame, column: str, to: str = "mentions") -> DataFrame:
    """df with an array of (kind, start from 0, size) of the mentions in a text; empty for null and empty texts."""
    sent = df.sparkSession.sparkContext.broadcast(common_words(df, column))

    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "start": s, "size": e - s} for k, s, e in mentions(t, sent.value)])

    kind = "array<struct<kind: string, start: int, size: int>>"
    asked = F.when(F.col(column).rlike(ANCHORED), F.col(column)).otherwise("")
    return df.withColumn(to, F.coalesce(F.when(asked != "", F.pandas_udf(spans, kind)(asked)), F.array().cast(kind)))


def redacted(text: Column, spans: Column) -> Column:
    """The text with a typed placeholder in the place of each mention and all else unchanged; null stays null."""
    holder = lambda k: F.element_at(F.create_map(*(F.lit(x) for kv in PLACEHOLDERS.items() for x in kv)), k)
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))
    fold = F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), holder(s["kind"])).alias("done"), (s["start"] + s["size"]).alias("at")),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(fold["done"], F.substring(text, fold["at"] + 1, F.length(text))))


def redact(df: DataFrame, column: str) -> DataFrame:
    """df with the column redacted; other columns, repeated rows and the order of columns stay."""
    out = with_mentions(df, column, "_mentions")
    return out.withColumn(column, redacted(F.col(column), F.col("_mentions"))).select(*df.columns)


def mention_rows(cells: DataFrame) -> DataFrame:
    """(src, row_id, kind, nth) for cells (src, row_id, value); nth counts the mentions of a kind in a record from 1."""
    each = with_mentions(cells, "value").where(F.col("value").rlike(ANCHORED)).select("src", "row_id", F.explode(F.array(*map(F.lit, PLACEHOLDERS))).alias("kind"), "mentions")
    n = F.size(F.filter("mentions", lambda m: m["kind"] == F.col("kind")))
    return each.withColumn("n", n).where("n > 0").select("src", "row_id", "kind", F.explode(F.sequence(F.lit(1), "n")).alias("nth"))
