"""Noise in text from scanned pages: broken words, misread characters, running titles and page numbers.

Lines. Boosted and logistic classifiers decide which lines are furniture. A line is a running title if the classifier of
repeated lines says so, from whether it equals a known title of its book, the pages and books it returns on, its styling
and its place; half of the known titles it is fitted on are shown to it as unknown ones. A line that shows a number is the
page's number if the classifier of a line and its neighbours says that it is furniture, and the number is that of a page
of the text. A line pair of which the first ends in a hyphen or dash is no break, a broken word, or a compound broken at
its own hyphen, by a classifier of line pairs over what the corpus holds of both writings and both halves.

Words. See misread.py: candidates from character q-gram indexes, chosen by a boosted ranker. They are looked for in the
text without furniture and with broken words joined.

Scale: everything is grouped by record, by distinct line of a book or by distinct word. What is fitted on is a bounded
sample (SAMPLE rows of each kind); counts, candidates and decisions cover all text. Nothing but model parameters reaches
the driver, and a filter of fixed size.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from looseleaf.llm.misread import SAMPLE, corrections, fitted, probability
from looseleaf.session import checkpointed

HYPHENS = "\\-‐‑¬\u00ad"
DASHES = HYPHENS + "–—"
_LETTER = r"\p{L}\p{M}\p{N}\ue000-\uf8ff�|!"
_ASCII_DIGITS = ("๐๑๒๓๔๕๖๗๘๙", "0123456789")
_EDGE = r"^[\p{Punct}“”«»‘’–—¬]*|[\p{Punct}“”«»‘’–—¬]*$"


def _digits(c: Column) -> Column:
    return F.translate(c, *_ASCII_DIGITS)


def fold(c: Column) -> Column:
    """Letters and digits alone, in lower case: the same for every styling of a title."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}]", "")


def page_lines(pages: DataFrame) -> DataFrame:
    """Lines of texts (src, row_id, book, first, last, titles, text), with what classifies them.

    k: place in the text, of `lines`; core: the line without a page number before or after; number: the number that the
    line shows as furniture, -1 if none; style: whether it is spaced out, in capitals, in marks or beside a number; runs_on
    and goes_on: whether the line before ends, and the line after begins, in the middle of a sentence.
    """
    split = F.split("text", r"\r?\n")
    near = F.transform(F.col("ls"), lambda x, i: F.struct(i.alias("k"), x.alias("line"), F.get(F.col("ls"), i - 1).alias("above"), F.get(F.col("ls"), i + 1).alias("below")))
    x = pages.where("text is not null").select("src", "row_id", "book", "first", "last", split.alias("ls"))
    x = x.select("src", "row_id", "book", "first", "last", F.size("ls").alias("lines"), F.explode(near).alias("l")).select("src", "row_id", "book", "first", "last", "lines", "l.*")
    plain = _digits(F.trim(F.regexp_replace("line", r"[\s\u00a0]+$", "")))
    alone = F.regexp_extract(plain, r"(?i)^[^\p{L}\p{N}]*(?:(?:หน้า|page|p\.?|pp\.?)\s*)?([0-9]{1,5})[^\p{L}\p{N}]*$", 1)
    before = F.regexp_extract(plain, r"^([0-9]{1,5})(?:\s*\||\t|\s{2,})", 1)
    after = F.regexp_extract(plain, r"(?:\|\s*|\t\s*|\s{2,})([0-9]{1,5})$", 1)
    number = F.when(alone != "", alone).when(before != "", before).when(after != "", after)
    core = F.trim(F.regexp_replace(F.trim("line"), r"^[0-9๐-๙]{1,5}(?:\s*\|\s*|\t\s*|\s{2,})|(?:\s*\|\s*|\t\s*|\s{2,})[0-9๐-๙]{1,5}$", ""))
    x = x.withColumn("core", F.when(alone != "", "").otherwise(core)).withColumn("number", F.coalesce(number.cast("int"), F.lit(-1))).withColumn("alone", alone != "")
    x = x.withColumn("fold", fold(F.col("core")))
    spaced = F.col("core").rlike(r"^(?:\S\s+){4,}\S$")
    capital = F.col("core").rlike(r"[A-Z]{3}") & (F.upper("core") == F.col("core"))
    x = x.withColumn("style", spaced | capital | F.col("core").rlike("[«»]") | ((F.col("number") >= 0) & (F.col("core") != "")))
    x = x.withColumn("stops", F.col("line").rlike(r"[.,;]\s*$")).withColumn("marked", F.col("line").rlike(r"^\s*[^\p{L}\p{N}\s]"))
    return x.withColumn("runs_on", F.col("above").rlike(r"[\p{L}\p{M},;\-]\s*$")).withColumn("goes_on", F.col("below").rlike(r"^\s*[\p{Ll}ก-๎]")).drop("above", "below")


def title_folds(pages: DataFrame, lines: DataFrame, known: tuple[str, ...], sample: int = SAMPLE) -> DataFrame:
    """(src, book, fold) of lines that the classifier holds for titles.

    Fitted on known titles, of which half are shown as unknown, and on other lines of the sources in known, whose titles
    are all given. A line that is no known title and stands on one page only isn't repeated and no candidate.
    """
    given = pages.select("src", "book", F.explode("titles").alias("t")).where("t is not null").distinct().select("src", "book", fold(F.col("t")).alias("fold")).where("length(fold) > 3").distinct()
    one = lines.where("length(fold) > 3")
    number = lambda c: F.avg(F.col(c).cast("double"))
    stats = one.groupBy("src", "book", "fold").agg(
        F.countDistinct("first").alias("pages"),
        F.count(F.lit(1)).alias("n"),
        number("style").alias("styled"),
        F.avg((F.col("lines") == 1).cast("double")).alias("alone_share"),
        F.avg((F.col("k") == 0).cast("double")).alias("first_share"),
        number("stops").alias("stops"),
    )
    elsewhere = one.groupBy("src", "fold").agg(F.countDistinct("book").alias("books"))
    stats = stats.join(given.withColumn("given", F.lit(1)), ["src", "book", "fold"], "left").fillna(0, ["given"]).where("given = 1 or pages > 1 and length(fold) > 5")
    stats = checkpointed(stats.join(elsewhere, ["src", "fold"]).withColumn("size", F.length("fold")))
    features = ["given", "pages", "n", "styled", "alone_share", "first_share", "stops", "books", "size"]
    order = F.xxhash64("src", "book", "fold")
    yes = stats.where("given = 1").orderBy(order).limit(sample).withColumn("label", F.lit(1))
    yes = yes.withColumn("given", F.when((order % 2 == 0) & (F.col("pages") > 1), 0).otherwise(1))
    no = stats.where("given = 0").where(F.col("src").isin(*known)).orderBy(order).limit(sample).withColumn("label", F.lit(0))
    model = fitted(yes.unionByName(no), features)
    if model is None:  # nothing to tell titles from
        return given
    return probability(model, stats, features, "p").where("p >= 0.5").select("src", "book", "fold").distinct()


def _logistic(rows: DataFrame, features: list[str], label: str):
    """A logistic classifier (of as many classes as label has), or None if the rows show one class only."""
    data = VectorAssembler(inputCols=features, outputCol="_f").transform(rows.select(*(F.col(c).cast("double").alias(c) for c in [*features, label])))
    data = checkpointed(data.select("_f", label).coalesce(2))  # a bounded sample
    if data.agg(F.countDistinct(label)).first()[0] < 2:
        return None
    return LogisticRegression(featuresCol="_f", labelCol=label, maxIter=20, regParam=0.001).fit(data)


def _predicted(model, rows: DataFrame, features: list[str], to: str) -> DataFrame:
    cast = rows.select(*rows.columns, *(F.col(c).cast("double").alias(f"_{c}") for c in features))
    return model.transform(VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_f").transform(cast)).select(*rows.columns, F.col("prediction").cast("int").alias(to))


def classified_lines(pages: DataFrame, known: tuple[str, ...] = ("source_notes",), sample: int = SAMPLE) -> DataFrame:
    """page_lines with header and page_number, whether the line is a running title or shows its page's number, or both."""
    lines = checkpointed(page_lines(pages))  # read several times below
    titles = title_folds(pages, lines, known, sample).withColumn("is_title", F.lit(True))
    marked = lines.join(titles, ["src", "book", "fold"], "left").fillna(False, ["is_title"]).withColumn("header", F.col("is_title") & (F.col("fold") != ""))
    # numbers: furniture by the line and its neighbours, where numbers of pages show what furniture looks like
    own = (F.col("number") >= F.col("first")) & (F.col("number") <= F.col("last"))
    features = ["alone", "header", "ends", "marked", "runs_on", "goes_on", "style", "size"]
    ends = (F.col("k") == 0) | (F.col("k") == F.col("lines") - 1)
    marked = marked.withColumn("ends", ends).withColumn("size", F.length("core")).fillna(False, ["runs_on", "goes_on"])
    shown = marked.where("number >= 0").withColumn("label", own.cast("int"))
    model = _logistic(shown.orderBy(F.xxhash64("src", "row_id", "k")).limit(sample), features, "label")
    marked = marked.withColumn("_furniture", F.lit(1)) if model is None else _predicted(model, marked, features, "_furniture")
    numbered = (F.col("_furniture") == 1) & (F.col("number") >= 0) & own & (F.col("alone") | F.col("header"))
    return marked.withColumn("page_number", F.coalesce(numbered, F.lit(False))).withColumn("furniture", F.col("header") | F.col("page_number")).drop("_furniture", "ends", "size")


def bodies(lines: DataFrame) -> DataFrame:
    """(src, row_id, ls): the lines of each text that aren't furniture, as (k, line) in order.

    Blank lines stay, as ends of paragraphs, but for those beside furniture.
    """
    gone = F.transform(F.filter(F.col("every"), lambda x: x["furniture"]), lambda x: x["k"])
    beside = lambda x: F.array_contains(gone, x["k"] - 1) | F.array_contains(gone, x["k"] + 1)
    kept = F.filter("every", lambda x: ~x["furniture"] & ~((F.trim(x["line"]) == "") & (F.size(gone) > 0) & beside(x)))
    every = lines.groupBy("src", "row_id").agg(F.array_sort(F.collect_list(F.struct("k", "line", "furniture"))).alias("every"))
    return every.select("src", "row_id", F.transform(kept, lambda x: F.struct(x["k"].alias("k"), x["line"].alias("line"))).alias("ls"))


def token_counts(body: DataFrame) -> DataFrame:
    """(word, n) of the blank-separated words of bodies, without punctuation at their ends."""
    word = F.explode(F.split(F.concat_ws(" ", F.col("ls.line")), r"\s+")).alias("w")
    return body.select(word).select(F.regexp_replace("w", _EDGE, "").alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


#: Features of a line pair.
PAIR = ["hyphen", "dash", "apart", "letter", "n_together", "n_hyphened", "n_left", "n_right", "long_left", "long_right"]


def line_pairs(body: DataFrame, counts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(src, row_id, k, join): line pairs whose first ends in a hyphen; join is 0 for no broken word, 1 if the hyphen goes, 2 if it stays.

    A logistic classifier of three classes over the signs between the lines, and how often the corpus holds both writings
    and both halves. It is fitted on pairs of which the corpus holds one writing, and on pairs of lines without a hyphen.
    """
    two = F.transform(F.slice("ls", 2, F.size("ls")), lambda y, i: F.struct(F.col("ls")[i]["k"].alias("k"), F.col("ls")[i]["line"].alias("a"), y["line"].alias("b")))
    pairs = body.where(F.size("ls") > 1).select("src", "row_id", F.explode(two).alias("p")).select("src", "row_id", "p.*").where("trim(a) <> '' and trim(b) <> ''")
    tail = F.regexp_extract("a", rf"[{DASHES}]+[\s]*$", 0)
    pairs = pairs.withColumn("hyphen", F.col("a").rlike(rf"[{_LETTER}][{HYPHENS}]\s*$")).withColumn("dash", tail != "").withColumn("apart", F.col("a").rlike(rf"(?:^|\s)[{DASHES}]+\s*$"))
    pairs = pairs.withColumn("letter", F.col("b").rlike(rf"^\s*[{_LETTER}]")).withColumn("left", F.regexp_extract("a", rf"(\S*?)[{DASHES}]*\s*$", 1)).withColumn("right", F.regexp_extract("b", r"^\s*([^\s.,;:!?)]+)", 1))
    order = F.xxhash64("src", "row_id", "k")
    asked = pairs.where("dash").unionByName(pairs.where("not dash").orderBy(order).limit(sample)).drop("a", "b")
    asked = checkpointed(asked.withColumn("id", F.xxhash64("src", "row_id", "k")))
    forms = F.array(*(F.struct(F.lit(n).alias("of"), F.regexp_replace(w, _EDGE, "").alias("word")) for n, w in (("together", F.concat("left", "right")), ("hyphened", F.concat("left", F.lit("-"), "right")), ("left", F.col("left")), ("right", F.col("right")))))
    met = asked.select("id", F.explode(forms).alias("f")).select("id", "f.*").join(counts, "word").groupBy("id").agg(*(F.max(F.when(F.col("of") == n, F.log1p("n"))).alias(f"n_{n}") for n in ("together", "hyphened", "left", "right")))
    x = asked.join(met, "id", "left").fillna(0.0, ["n_together", "n_hyphened", "n_left", "n_right"]).withColumn("long_left", F.length("left")).withColumn("long_right", F.length("right"))
    one = F.when((F.col("n_hyphened") > 0) & (F.col("n_together") == 0), 2).when((F.col("n_together") > 0) & (F.col("n_hyphened") == 0), 1)
    x = checkpointed(x.withColumn("label", F.when(~F.col("dash") | F.col("apart") | ~F.col("letter"), 0).when(F.col("hyphen"), one)))
    model = _logistic(x.where("label is not null").orderBy("id").limit(3 * sample), PAIR, "label")
    broken = x.where("dash")
    if model is None:
        return broken.select("src", "row_id", "k", F.coalesce("label", F.lit(1)).alias("join"))
    return _predicted(model, broken, PAIR, "join").select("src", "row_id", "k", "join")


def joined_texts(body: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, row_id, text): the lines of bodies as continuous paragraphs; broken words are whole."""
    how = pairs.where("join > 0").groupBy("src", "row_id").agg(F.map_from_entries(F.collect_set(F.struct("k", "join"))).alias("how"))
    x = body.join(how, ["src", "row_id"], "left").withColumn("how", F.coalesce("how", F.create_map().cast("map<int,int>")))
    bare = lambda l: F.trim(F.regexp_replace(l["line"], r"[\s\u00a0]+", " "))

    def piece(l: Column) -> Column:
        joined = F.try_element_at(F.col("how"), l["k"])
        cut = F.regexp_replace(bare(l), rf"[{HYPHENS}]\s*$", "")
        return F.when(bare(l) == "", "\n\n").when(joined == 1, cut).when(joined == 2, F.concat(cut, F.lit("-"))).otherwise(F.concat(bare(l), F.lit(" ")))

    text = F.array_join(F.transform("ls", piece), "")
    return x.select("src", "row_id", F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s*\n\n\s*", "\n\n")), r"^\s+|\s+$", "")).alias("text"))


def _read(pages: DataFrame, known: tuple[str, ...], sample: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, pairs, texts): classified lines, line pairs, and the joined text of each record."""
    lines = checkpointed(classified_lines(pages, known, sample).select("src", "row_id", "k", "line", "header", "page_number", "furniture"))
    body = checkpointed(bodies(lines))
    pairs = checkpointed(line_pairs(body, token_counts(body), sample))
    return lines, pairs, checkpointed(joined_texts(body, pairs))


def noise_kinds(pages: DataFrame, known: tuple[str, ...] = ("source_notes",), sample: int = SAMPLE) -> DataFrame:
    """(src, row_id, kind): the kinds of noise in each text, of hyphenation, misread, running_header and page_number.

    pages: (src, row_id, book, first, last, titles, text); first and last are the pages a text runs over. Null and empty
    texts have none; null titles are taken from other rows of the book where there are any; repeated rows count once.
    """
    lines, pairs, texts = _read(pages.dropDuplicates(["src", "row_id"]), known, sample)
    kinds = [
        pairs.where("join > 0").select("src", "row_id", F.lit("hyphenation").alias("kind")),
        corrections(texts, sample).select("src", "row_id", F.lit("misread").alias("kind")),
        lines.where("header").select("src", "row_id", F.lit("running_header").alias("kind")),
        lines.where("page_number").select("src", "row_id", F.lit("page_number").alias("kind")),
    ]
    out = kinds[0]
    for x in kinds[1:]:
        out = out.unionByName(x)
    return out.distinct()


def corrected(texts: DataFrame, wrong: DataFrame) -> DataFrame:
    """texts (src, row_id, text) with the corrections (src, row_id, at, size, x) in their places; of two that overlap the first counts."""
    per = wrong.groupBy("src", "row_id").agg(F.array_sort(F.collect_set(F.struct("at", "size", "x"))).alias("cs"))
    apart = F.filter("cs", lambda c, i: (i == 0) | (c["at"] >= F.get(F.col("cs"), i - 1)["at"] + F.get(F.col("cs"), i - 1)["size"]))
    x = texts.join(per.withColumn("cs", apart), ["src", "row_id"], "left")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.col("cs")[i - 1]["at"] + F.col("cs")[i - 1]["size"])
    pieces = F.transform("cs", lambda c, i: F.concat(F.substring(F.col("text"), begin(i) + 1, c["at"] - begin(i)), c["x"]))
    last = F.col("cs")[F.size("cs") - 1]
    whole = F.concat(F.array_join(pieces, ""), F.substring(F.col("text"), last["at"] + last["size"] + 1, F.length("text")))
    return x.select("src", "row_id", F.when(F.size("cs") > 0, whole).otherwise(F.col("text")).alias("text"))


def repaired(pages: DataFrame, known: tuple[str, ...] = ("source_notes",), sample: int = SAMPLE) -> DataFrame:
    """(src, row_id, text): continuous paragraphs, without furniture, broken words and misread characters.

    One row for each (src, row_id) with a text; a text of furniture only becomes empty; repeated rows give one. Blank
    lines end paragraphs.
    """
    pages = pages.dropDuplicates(["src", "row_id"])
    _, _, texts = _read(pages, known, sample)
    return corrected(texts, corrections(texts, sample))
