"""Ordered sequences: token offsets, documents and sentences in line streams, windows, language-model pairs, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.ranking import running_total


def words(c: Column) -> Column:
    """Tokens parted by runs of U+0020."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def tokens(df: DataFrame, keys: list[str], text: str = "text", offsets: bool = True) -> DataFrame:
    """(keys, idx from 1, token, start_pos, end_pos): offsets are those in the tokens joined by one blank. Null text has no tokens.

    All is local to a row: nothing is shuffled. Without ``offsets`` the last two columns are left out.
    """
    w = words(F.col(text))
    if not offsets:
        return df.select(*keys, F.posexplode(w).alias("__p", "token")).select(*keys, (F.col("__p") + 1).alias("idx"), "token")
    none = F.array().cast("array<struct<idx:int,token:string,start_pos:int,end_pos:int>>")
    one = lambda acc, x: F.struct((F.size(acc["out"]) + 1).alias("idx"), x.alias("token"), acc["at"].alias("start_pos"), (acc["at"] + F.length(x)).alias("end_pos"))
    fold = F.aggregate(w, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["out"], F.array(one(acc, x))).alias("out")), lambda acc: acc["out"])
    return df.select(*keys, F.inline(fold))


def tagged_tokens(df: DataFrame, keys: list[str], text: str, tags: str, mode: str = "pad") -> DataFrame:
    """(keys, idx, token, tag). A sentence with too few tags: ``pad`` gives empty ones, ``drop`` drops the tokens, ``null`` leaves null."""
    t, g = words(F.col(text)), words(F.coalesce(F.col(tags), F.lit("")))
    rows = df.select(*keys, F.posexplode(F.arrays_zip(t.alias("token"), g.alias("tag"))).alias("__p", "x")).select(*keys, (F.col("__p") + 1).alias("idx"), "x.token", "x.tag").filter("token IS NOT NULL")
    if mode == "pad":
        return rows.fillna("", ["tag"])
    return rows.filter("tag IS NOT NULL") if mode == "drop" else rows


def lines(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, line from 0, value)."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("line", "value"))


def sentence_ids(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds ``sent`` from 0 to the lines that aren't blank: it rises at the first line after blank ones."""
    w = Window.partitionBy(*keys).orderBy("line")
    blank = ~F.col(value).rlike(r"(?U)\S")
    first = (~blank & F.coalesce(F.lag(blank).over(w), F.lit(True))).cast("int")
    return rows.withColumn("__b", blank).withColumn("__f", first).withColumn("sent", (F.sum("__f").over(w) - 1).cast("int")).filter(~F.col("__b")).drop("__b", "__f")


def document_ids(rows: DataFrame, keys: list[str], order: str, mark: Column) -> DataFrame:
    """Adds ``doc``: how many marks stood up to here within the keys; rows that are a mark get ``start``. ``order`` must be unique.

    The count is a running total over the whole table less what stood before the keys began, so that a key with a third of
    all rows is spread like the others.
    """
    marked = rows.withColumn("__m", F.coalesce(mark, F.lit(False)).cast("int"))
    total = running_total(marked, *[F.asc_nulls_first(k) for k in keys], F.col(order), value=F.col("__m"), name="__t")
    base = total.groupBy(*keys).agg(F.min(F.col("__t") - F.col("__m")).alias("__b"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = total.alias("a").join(base.alias("b"), same)
    doc = F.when(F.col("a.__m") == 1, "start").otherwise((F.col("a.__t") - F.col("b.__b")).cast("string"))
    return both.select(*[F.col(f"a.{c}") for c in rows.columns], doc.alias("doc"))


def context_window(df: DataFrame, keys: list[str], text: str = "text", size: int = 4) -> DataFrame:
    """(keys, idx, token, context): each token with up to ``size`` others on either side; local to a row."""
    rows = df.select(*keys, words(F.col(text)).alias("__w"))
    low = lambda i: F.greatest(i - size, F.lit(1))
    each = F.transform(F.col("__w"), lambda x, i: F.struct((i + 1).alias("idx"), x.alias("token"), F.array_join(F.slice("__w", low(i + 1), i + 1 + size - low(i + 1) + 1), " ").alias("context")))
    return rows.select(*keys, F.inline(each))


def character_window(df: DataFrame, keys: list[str], text: str = "text", size: int = 10) -> DataFrame:
    """(keys, idx, token, before, after): each token with up to ``size`` characters of the tokens joined by a blank on either side."""
    rows = tokens(df.withColumn("__t", F.array_join(words(F.col(text)), " ")), [*keys, "__t"], text)
    low = F.greatest(F.col("start_pos") - size, F.lit(0))
    return rows.select(*keys, "idx", "token", F.col("__t").substr(low + 1, F.col("start_pos") - low).alias("before"), F.col("__t").substr(F.col("end_pos") + 1, F.lit(size)).alias("after"))


def language_model_pairs(df: DataFrame, keys: list[str], text: str, reverse: bool = False) -> DataFrame:
    """(keys, pos, char, target): each character and the next one; the last has none and is dropped. Local to a row."""
    c = F.reverse(F.col(text)) if reverse else F.col(text)
    rows = df.select(*keys, F.filter(F.split(c, ""), lambda x: x != "").alias("__c"))
    pairs = F.transform(F.slice("__c", 1, F.greatest(F.size("__c") - 1, F.lit(0))), lambda x, i: F.struct(i.alias("pos"), x.alias("char"), F.get("__c", i + 1).alias("target")))
    return rows.select(*keys, F.inline(pairs))


def fold_columns(df: DataFrame, keys: list[str], chars: str, batch: int) -> DataFrame:
    """(keys, row, col, char): a character sequence folded into ``batch`` columns of equal length, the rest cut off."""
    rows = df.select(*keys, F.filter(F.split(chars, ""), lambda x: x != "").alias("__c")).withColumn("__n", F.floor(F.size("__c") / batch).cast("int"))
    each = F.transform(F.slice("__c", 1, F.col("__n") * batch), lambda x, i: F.struct((i % F.col("__n")).alias("row"), F.floor(i / F.col("__n")).cast("int").alias("col"), x.alias("char")))
    return rows.filter("__n > 0").select(*keys, F.inline(each))


def sliding(df: DataFrame, keys: list[str], size: Column, width: int, stride: int) -> DataFrame:
    """(keys, win, low, high): windows over 0..size; the last reaches the end."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((size - width) / stride), F.lit(0)).cast("int"))
    rows = df.filter(size > 0).select(*keys, size.alias("__n"), F.explode(starts).alias("win"))
    return rows.select(*keys, "win", (F.col("win") * stride).alias("low"), F.least(F.col("win") * stride + width, F.col("__n")).alias("high"))


def centres(windows: DataFrame, keys: list[str], width: int, stride: int) -> DataFrame:
    """The windows of ``sliding`` with ``start`` and ``stop``, the part that each answers for: the parts of a sequence follow one another without a gap.

    A window answers for the middle of the stretch that it shares with its neighbours; the first and the last also for the ends.
    """
    half = (width - stride) // 2
    last = F.max("win").over(Window.partitionBy(*keys))
    start = F.when(F.col("win") == 0, F.col("low")).otherwise(F.col("low") + half)
    stop = F.when(F.col("win") == last, F.col("high")).otherwise(F.col("low") + stride + half)
    return windows.withColumn("start", start).withColumn("stop", stop)


def running_best(df: DataFrame, keys: list[str], order: str, score: str) -> DataFrame:
    """Adds ``best`` so far and ``bad``: how many rows in a row brought no better score. Null scores bring none."""
    w = Window.partitionBy(*keys).orderBy(order)
    best = F.max(score).over(w)
    before = F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.coalesce(F.col(score) > before, F.col(score).isNotNull())
    rows = df.withColumn("best", best).withColumn("__g", better.cast("int")).withColumn("__r", F.sum("__g").over(w))
    return rows.withColumn("bad", (F.row_number().over(Window.partitionBy(*keys, "__r").orderBy(order)) - F.when(F.col("__r") > 0, 1).otherwise(0)).cast("int")).drop("__g", "__r")


def trim_curve(df: DataFrame, keys: list[str], order: str, head: int = 10, tail: int = 5) -> DataFrame:
    """Without the first ``head`` and last ``tail`` points."""
    up = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("__u", up).withColumn("__d", down).filter((F.col("__u") > head) & (F.col("__d") > tail)).drop("__u", "__d")
