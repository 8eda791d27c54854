"""Column functions on text: repair of doubled marks, structural metrics, names, paths and rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Thai marks that extraction doubles, glyphs it leaves behind them, and the classes of marks and letters.
DOUBLED = "ัำิีึืฺุู็่้๊๋์ํ๎"
STACK_GLYPHS = "�ˠˣ"
ABOVE_VOWELS = "ัิีึื็ํ"
TONES = "่้๊๋"
SILENCER = "์"
CONSONANTS = "ก-ฮ"
LEADING_VOWELS = "เแโใไ"
#: Characters that file names can't hold.
INVALID_IN_NAMES = '/\\:*?"<>|'


def repair(text: Column) -> Column:
    """Both patterns are fixed by what the extraction leaves behind. The glyph after a doubled mark is dropped, then doubled marks are single; all else, and clean text, stays."""
    return F.regexp_replace(F.regexp_replace(text, f"([{DOUBLED}])\\1(\\s*)[{STACK_GLYPHS}]", "$1$1$2"), f"([{DOUBLED}])\\1", "$1")


def doubled(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"([{DOUBLED}])\\1"))


def illegal_pairs(text: Column) -> Column:
    """Marks above a letter followed by another, but for a vowel under a tone or silencer."""
    above = ABOVE_VOWELS + TONES + SILENCER
    return F.regexp_count(text, F.lit(f"[{above}](?=[{above}])")) - F.regexp_count(text, F.lit(f"[{ABOVE_VOWELS}](?=[{TONES}{SILENCER}])"))


def orphan_marks(text: Column) -> Column:
    """Marks that follow neither a consonant nor another mark nor a leading vowel."""
    return F.regexp_count(text, F.lit(f"(?<![{CONSONANTS}{DOUBLED}{LEADING_VOWELS}])[{DOUBLED}]"))


def unmapped(text: Column) -> Column:
    """Places, from 0, of characters lost in extraction."""
    at = F.transform(F.filter(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)) == "�"), lambda i: i - 1)
    return F.when(F.contains(text, F.lit("�")), at).otherwise(F.array().cast("array<int>"))


def context(text: Column, at: Column, before: int = 25, after: int = 15) -> Column:
    """The text around a place, cut at its ends."""
    start = F.greatest(at - before, F.lit(0))
    return F.substring(text, start + 1, at + after - start)


def lines(text: Column) -> Column:
    """Lines of a text under any line end; a last line end opens no line."""
    return F.split(F.regexp_replace(text, "(\r\n|\n|\r)$", ""), "\r\n|\n|\r")


def field(text: Column, label: str) -> Column:
    """What follows a label on its line; null if it is missing or blank."""
    return F.nullif(F.trim(F.regexp_extract(text, f"{label}[ \\t]*(.*)", 1)), F.lit(""))


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def stem(path: Column) -> Column:
    """File name without its folder and `.md`."""
    return F.regexp_replace(basename(path), r"\.md$", "")


def safe_name(name: Column) -> Column:
    """Each character that a file name can't hold as an underscore."""
    return F.translate(name, INVALID_IN_NAMES, "_" * len(INVALID_IN_NAMES))


def yaml_scalar(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def squeezed(name: Column) -> Column:
    """A name without blanks, in lower case."""
    return F.lower(F.regexp_replace(name, r"\s+", ""))


def bar(share: Column, width: int = 20) -> Column:
    """A bar for a share between 0 and 1."""
    return F.repeat(F.lit("█"), F.round(share * width).cast("int"))


def collapse_blank_lines(text: Column) -> Column:
    """At most one blank line in a row, none at the end."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"\s+$", ""))


def page_pair(text: Column) -> Column:
    """`[a, b]`, the fixed form of page ranges in notes, as a struct of two numbers; null for anything else."""
    first, last = (F.regexp_extract(text, r"^\[\s*(\d+)\s*,\s*(\d+)\s*\]$", i).try_cast("int") for i in (1, 2))
    return F.when(first.isNotNull() & last.isNotNull(), F.struct(first.alias("first"), last.alias("last")))
