"""Cleaning, splitting and filtering of raw text.

Blanks are those of Unicode and the separators U+001C to U+001F; lengths are code points. Null text gives null from the scalar
functions and no rows from those that split; empty text gives no sentences.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = r"(?U)[\s\x{1c}-\x{1f}]+"
ENDS = "。！？；\n"  # fixed value: marks that end a sentence


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed form of Unicode; there is no built-in for it."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def strip(c: Column) -> Column:
    """Blanks off both ends, every kind of blank."""
    return F.regexp_replace(c, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def collapse_blanks(c: Column) -> Column:
    """Runs of blanks become one U+0020; none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def normalize(c: Column) -> Column:
    return collapse_blanks(nfc(c))


def split_keep(c: Column, ends: str = ENDS) -> Column:
    """Sentences with the marks that end them; a run of marks stays together, blanks before it and around are dropped."""
    parts = F.regexp_extract_all(c, F.lit(f"[^{ends}]*[{ends}]+|[^{ends}]+$"), F.lit(0))
    clean = F.transform(parts, lambda x: F.regexp_replace(strip(x), rf"(?U)[\s\x{{1c}}-\x{{1f}}]+(?=[{ends}]+$)", ""))
    return F.filter(clean, lambda x: x != "")


def split_drop(c: Column, ends: str = ENDS) -> Column:
    """Sentences without the marks between them."""
    return F.filter(F.transform(F.split(c, f"[{ends}]+"), strip), lambda x: x != "")


def size_without_spaces(c: Column) -> Column:
    return F.length(F.replace(c, F.lit(" ")))


def is_valid(c: Column, low: int = 5, high: int = 200) -> Column:
    return size_without_spaces(c).between(low, high)


def split_table(df: DataFrame, text: str = "text", keep: bool = True, ends: str = ENDS) -> DataFrame:
    """One row per sentence, with its place ``pos`` from 0; other columns stay, one named ``sentence`` or ``pos`` is replaced."""
    rest = [c for c in df.columns if c not in ("sentence", "pos", text)]
    cell = collapse_blanks(F.col(text)) if "\n" not in ends else F.col(text)
    return df.select(*rest, F.posexplode((split_keep if keep else split_drop)(cell, ends)).alias("pos", "sentence"))


def first_of_each(df: DataFrame, text: str, *order: str) -> DataFrame:
    """Exact copies by md5 of the text: the first row in the order stays. Null texts are one value.

    The smallest row per text is found by an aggregate that is combined before the shuffle, so a text that a third of all
    rows share is no burden.
    """
    cols = df.columns
    key = F.md5(F.col(text))
    best = df.groupBy(key.alias("__fp")).agg(F.min(F.struct(*[F.col(c) for c in order], F.struct(*cols))).alias("__row"))
    at = f"col{len(order) + 1}"
    return best.select(F.col(f"__row.{at}.*"))


def reject_reasons(df: DataFrame, text: str, *order: str, low: int = 5, high: int = 200) -> DataFrame:
    """Adds ``reason``: too_short, too_long, duplicate (of an earlier row of right length) or kept; the first that holds.

    ``order`` must be unique. The first row of each text comes from an aggregate and is joined back, so a text that a third of
    all rows share is spread by the skew join.
    """
    n = size_without_spaces(F.coalesce(F.col(text), F.lit("")))
    marked = df.withColumn("__n", n).withColumn("__fp", F.when(n.between(low, high), F.md5(F.col(text)))).withColumn("__o", F.struct(*order))
    first = marked.filter("__fp IS NOT NULL").groupBy("__fp").agg(F.min("__o").alias("__first"))
    both = marked.join(first, "__fp", "left")
    reason = F.when(F.col("__n") < low, "too_short").when(F.col("__n") > high, "too_long").when(F.col("__o") != F.col("__first"), "duplicate").otherwise("kept")
    return both.withColumn("reason", reason).select(*df.columns, "reason")


def length_histogram(lengths: DataFrame, col: str) -> DataFrame:
    """(bucket, n) over [0,20) [20,50) [50,100) [100,150) [150,200); other lengths are in none."""
    c = F.col(col)
    edges = (0, 20, 50, 100, 150, 200)
    bucket = None
    for lo, hi in zip(edges, edges[1:], strict=False):
        cond = (c >= lo) & (c < hi)
        bucket = F.when(cond, f"{lo}-{hi}") if bucket is None else bucket.when(cond, f"{lo}-{hi}")
    return lengths.withColumn("bucket", bucket).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def punct_labels(df: DataFrame, key: str, text: str, marks: str = "，。、；：？！", ends: str = "。？！") -> DataFrame:
    """(key, para, sent, idx, token, label): characters of each paragraph, labelled with the mark that follows.

    Blanks are no characters; blank lines part paragraphs; of a run of marks the first counts; a mark that nothing precedes
    is dropped; a sentence ends where an end mark was given as a label.
    """
    paras = df.select(key, F.posexplode(F.split(F.col(text), r"\n\s*\n")).alias("para", "__p"))
    # a sentence ends after a character and the end mark that follows it at once
    sents = paras.select(key, "para", F.posexplode(F.split(F.regexp_replace("__p", BLANKS, ""), f"(?<=[^{marks}][{ends}])")).alias("sent", "__s"))
    chars = sents.select(key, "para", "sent", F.filter(F.split("__s", ""), lambda x: x != "").alias("__c"))
    is_mark = lambda x: F.instr(F.lit(marks), x) > 0
    label = lambda i: F.when(is_mark(F.get("__c", i + 1)), F.get("__c", i + 1)).otherwise("O")
    each = F.filter(F.transform("__c", lambda x, i: F.struct(x.alias("token"), label(i).alias("label"))), lambda x: ~is_mark(x["token"]))
    return chars.select(key, "para", "sent", F.posexplode(each).alias("__i", "x")).select(key, "para", "sent", (F.col("__i") + 1).alias("idx"), "x.token", "x.label")


# scalar helpers
def mask_digits(c: Column, by: str = "#") -> Column:
    return F.regexp_replace(c, r"(?U)\d", by)


def clamp_score(c: Column) -> Column:
    """A score outside [0, 1] becomes 1."""
    return F.when(c.between(0, 1), c).otherwise(F.lit(1.0))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def key_values(c: Column) -> Column:
    """``K=V|K=V`` as a map with lower-case keys; ``_`` and null are empty."""
    entries = F.filter(F.split(c, r"\|"), lambda x: F.instr(x, "=") > 0)
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(F.lower(F.split(x, "=")[0]), F.split(x, "=")[1])))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def first_words(c: Column, n: int = 200) -> Column:
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def seconds_to_stamp(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd-HH-mm-ss")


def stamp_to_seconds(c: Column) -> Column:
    return F.unix_timestamp(F.to_timestamp(c, "yyyy-MM-dd-HH-mm-ss"))


def is_punct(c: Column) -> Column:
    """Whether every character is punctuation."""
    return c.rlike(r"^\p{P}+$")


def is_full_width(c: Column) -> Column:
    """Whether every character takes a full column: East Asian scripts, full-width forms and their marks."""
    return c.rlike(r"^[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF01}-\x{FF60}\x{FFE0}-\x{FFE6}\x{20000}-\x{3FFFD}]+$")


def is_latin(c: Column) -> Column:
    """Whether every character is a Latin letter."""
    return c.rlike(r"^\p{IsLatin}+$")
