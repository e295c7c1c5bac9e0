"""Tag schemes, spans and chunks over token tables ``(keys..., idx, text, tag[, score])``.

Each function takes the columns that name a sentence; tokens are in the order of ``idx``. A null tag counts as ``O``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix(c: Column) -> Column:
    return F.when(c.contains("-"), F.substring_index(c, "-", 1)).otherwise(c)


def kind(c: Column) -> Column:
    """What follows the first hyphen; empty for O."""
    return F.regexp_extract(c, "^[^-]*-(.*)$", 1)


def _w(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("idx")


def repair_bio(df: DataFrame, keys: list[str], tag: str = "tag") -> DataFrame:
    """``I-x`` becomes ``B-x`` at the start, after O and after another type. A sentence with a tag of another scheme stays as it is."""
    t = F.coalesce(F.col(tag), F.lit("O"))
    good = F.min(F.when(t.rlike("^(O|[BI]-.*)$"), 1).otherwise(0)).over(Window.partitionBy(*keys))
    last = F.lag(t).over(_w(keys))
    broken = t.startswith("I-") & (last.isNull() | (last == "O") | (F.substring(last, 2, 10000) != F.substring(t, 2, 10000)))
    return df.withColumn("__g", good).withColumn("__l", broken).withColumn(tag, F.when((F.col("__g") == 1) & F.col("__l"), F.concat(F.lit("B"), F.substring(t, 2, 10000))).otherwise(t)).drop("__g", "__l")


def bio_to_bioes(df: DataFrame, keys: list[str], tag: str = "tag") -> DataFrame:
    """B is S, and I is E, unless an I follows, of whatever type."""
    t = F.col(tag)
    more = F.coalesce(F.lead(t).over(_w(keys)).startswith("I"), F.lit(False))
    rest = F.substring(t, 2, 10000)
    new = F.when(t.startswith("B-") & ~F.col("__m"), F.concat(F.lit("S"), rest)).when(t.startswith("I-") & ~F.col("__m"), F.concat(F.lit("E"), rest)).otherwise(t)
    return df.withColumn("__m", more).withColumn(tag, new).drop("__m")


def bioes_to_bio(c: Column) -> Column:
    return F.when(c.startswith("S-"), F.concat(F.lit("B"), F.substring(c, 2, 10000))).when(c.startswith("E-"), F.concat(F.lit("I"), F.substring(c, 2, 10000))).otherwise(c)


def write_bi(df: DataFrame, keys: list[str], types: list[str], tag: str = "tag") -> DataFrame:
    """Tags for output: only the named types; ``I-`` where the type goes on, else ``B-``."""
    k = F.when(kind(F.col(tag)).isin(types), kind(F.col(tag))).otherwise("")
    rows = df.withColumn("__k", k)
    last = F.coalesce(F.lag("__k").over(_w(keys)), F.lit(""))
    return rows.withColumn("__l", last).withColumn(tag, F.when(F.col("__k") == "", "O").when(F.col("__k") == F.col("__l"), F.concat(F.lit("I-"), F.col("__k"))).otherwise(F.concat(F.lit("B-"), F.col("__k")))).drop("__k", "__l")


def spans(df: DataFrame, keys: list[str], tag: str = "tag", score: str = "score", min_score: float = -1.0) -> DataFrame:
    """(keys, start, stop, tag, score, text) of each span of any scheme, broken ones too.

    O and empty tags lie outside; B and S begin a span, and so does a tag of another type after a span's S; a tag without prefix
    counts as S. The type is a vote in which what begins a span weighs 1.1 and the first seen wins a tie; the score is the mean.
    """
    t = F.coalesce(F.col(tag), F.lit(""))
    full = F.when(t.isin("", "O", "_"), "O").when(t.rlike("^[BIOES]-"), t).otherwise(F.concat(F.lit("S-"), t))
    rows = df.withColumn("__t", full).withColumn("__k", kind(full)).withColumn("__p", F.substring(full, 1, 1))
    w = _w(keys)
    rows = rows.withColumn("__lt", F.lag("__t").over(w)).withColumn("__lk", F.lag("__k").over(w)).withColumn("__lp", F.lag("__p").over(w))
    inside = F.col("__t") != "O"
    begins = inside & (F.col("__p").isin("B", "S") | F.col("__lt").isNull() | (F.col("__lt") == "O") | ((F.col("__lp") == "S") & (F.col("__lk") != F.col("__k"))))
    rows = rows.withColumn("__b", begins.cast("int")).filter(inside).withColumn("__s", F.sum("__b").over(w))
    weight = F.when(F.col("__b") == 1, 1.1).otherwise(1.0)
    # first per type within a span, then per span: both in the partitioning of the windows, without a join
    types = rows.groupBy(*keys, "__s", "__k").agg(F.round(F.sum(weight), 3).alias("__v"), F.min("idx").alias("__first"), F.max("idx").alias("__last"), F.sum(score).alias("__sum"), F.count(score).alias("__n"), F.collect_list(F.struct("idx", "text")).alias("__x"))
    whole = types.groupBy(*keys, "__s").agg(
        F.min("__first").alias("start"), F.max("__last").alias("stop"), F.max_by("__k", F.struct(F.col("__v"), -F.col("__first"))).alias("tag"), F.round(F.sum("__sum") / F.sum("__n"), 6).alias("score"),
        F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("__x"))), lambda x: x["text"]), " ").alias("text"),
    )
    return whole.filter(F.col("score") > min_score).drop("__s").select(*keys, "start", "stop", "score", "text", "tag")


def chunk_edges(df: DataFrame, keys: list[str], tag: str, out: str) -> DataFrame:
    """Adds ``<out>_begin`` and ``<out>_end``: whether a chunk begins at, or ended before, the token."""
    t = F.coalesce(F.col(tag), F.lit("O"))
    rows = df.withColumn("__t", t).withColumn("__p", F.substring(t, 1, 1)).withColumn("__k", kind(t))
    w = _w(keys)
    rows = rows.withColumn("__lp", F.coalesce(F.lag("__p").over(w), F.lit("O"))).withColumn("__lk", F.coalesce(F.lag("__k").over(w), F.lit("")))
    p, lp, k, lk = (F.col(c) for c in ("__p", "__lp", "__k", "__lk"))
    inner = lp.isin("B", "I")
    ends = (inner & p.isin("B", "O", "S")) | lp.isin("E", "S") | ((lp != "O") & (lk != k))
    begins = p.isin("B", "S") | (p.isin("I", "E") & lp.isin("E", "S", "O")) | ((p != "O") & (lk != k))
    return rows.withColumn(f"{out}_begin", begins & (p != "O")).withColumn(f"{out}_end", ends & (lp != "O")).drop("__t", "__p", "__k", "__lp", "__lk")


def chunks(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """(keys, start, stop, kind) of the chunks that tags make."""
    rows = chunk_edges(df, keys, tag, "c").withColumn("__n", F.sum(F.col("c_begin").cast("int")).over(_w(keys))).filter(F.coalesce(F.col(tag), F.lit("O")) != "O")
    return rows.groupBy(*keys, "__n").agg(F.min("idx").alias("start"), F.max("idx").alias("stop"), F.min_by(kind(F.col(tag)), "idx").alias("kind")).drop("__n")


def space_after(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Adds ``space_after``: none before closing marks, clitics and closing quotes, none after an opening bracket or quote."""
    w = _w(keys)
    nxt = F.lead(text).over(w)
    quotes = F.sum((F.col(text) == '"').cast("int")).over(w)
    rows = df.withColumn("__n", nxt).withColumn("__q", quotes)
    closing = F.col("__n").isin(".", ":", ",", ";", ")", "n't", "!", "?") | F.col("__n").startswith("'")
    quote = F.when(F.col(text) == '"', F.col("__q") % 2 == 1).otherwise(False) | F.when(F.col("__n") == '"', F.col("__q") % 2 == 1).otherwise(False)
    tight = F.coalesce(closing, F.lit(False)) | F.coalesce(quote, F.lit(False)) | (F.col(text) == "(")
    return rows.withColumn("space_after", ~tight).drop("__n", "__q")
