"""Links between views of a corpus, predictions of several systems, rendering and statistics documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators import text as tx
from quillmill.operators.ranking import global_rank


def link_keyed(source: DataFrame, doc: DataFrame, keys: list[str]) -> DataFrame:
    """Each row of the source view with the row of the document view of equal keys, as structs ``source`` and ``doc`` (null where there is none)."""
    a = source.select(*keys, F.struct(*source.columns).alias("source"))
    b = doc.select(*keys, F.struct(*doc.columns).alias("doc"))
    return a.join(b, keys, "left")


def link_positional(source: DataFrame, doc: DataFrame, order_a: Column, order_b: Column) -> DataFrame:
    """The i-th row of one view with the i-th of the other, as far as both go."""
    a = global_rank(source, order_a, name="__i").select("__i", F.struct(*source.columns).alias("source"))
    b = global_rank(doc, order_b, name="__i").select("__i", F.struct(*doc.columns).alias("doc"))
    return a.join(b, "__i").select(F.col("__i").alias("pos"), "source", "doc")


def truncate_at(tokens: DataFrame, keys: list[str], mark: str = "<EOS>", token: str = "token") -> DataFrame:
    """The tokens of each sentence before the first mark."""
    seen = F.max((F.col(token) == mark).cast("int")).over(Window.partitionBy(*keys).orderBy("idx"))
    return tokens.withColumn("__s", F.coalesce(seen, F.lit(0))).filter("__s = 0").drop("__s")


def attach_systems(tokens: DataFrame, systems: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``preds``, the (system, pred, score) of each token in the order of the system's name."""
    each = systems.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("system", "pred", "score"))).alias("preds"))
    return tokens.join(each, keys, "left")


def vote(systems: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pred, score): the label with the largest sum of scores, the smaller label on a tie, and its softmax share."""
    sums = systems.filter("pred IS NOT NULL").groupBy(*keys, "pred").agg(F.round(F.sum(F.coalesce("score", F.lit(0.0))), 9).alias("s"))
    best = sums.groupBy(*keys).agg(F.min_by("pred", F.struct(-F.col("s"), F.col("pred"))).alias("pred"), F.max("s").alias("top"), F.sum(F.exp("s")).alias("z"))
    return best.select(*keys, "pred", F.round(F.exp("top") / F.col("z"), 6).alias("score"))


def heads(tokens: DataFrame, keys: list[str], idx: str = "dep", head: str = "head", text: str = "token") -> DataFrame:
    """Adds ``head_text``; the root has none."""
    other = tokens.select(*keys, F.col(idx).alias(head), F.col(text).alias("head_text"))
    return tokens.join(other, [*keys, head], "left")


def candidate_spans(tokens: DataFrame, keys: list[str], longest: int | None = None) -> DataFrame:
    """(keys, start, stop) of all spans, or of those up to ``longest`` tokens, from the sentence lengths."""
    n = tokens.groupBy(*keys).agg(F.max("idx").alias("n"))
    starts = n.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("start"))
    last = F.col("n") if longest is None else F.least(F.col("n"), F.col("start") + longest - 1)
    return starts.select(*keys, "start", F.explode(F.sequence(F.col("start"), last)).alias("stop"))


def statistics_json(sentences: DataFrame, by: str, tokens: str) -> DataFrame:
    """(by, stats): documents and token counts as a JSON text."""
    n = F.col(tokens)
    s = sentences.groupBy(by).agg(F.count("*").alias("total"), F.sum(n).alias("tokens"), F.min(n).alias("min"), F.max(n).alias("max"))
    return s.select(by, F.to_json(F.struct("total", "tokens", "min", "max")).alias("stats"))


def plain(tokens: DataFrame, keys: list[str], tag: str | None = None, token: str = "token", sep: str = " ") -> DataFrame:
    """(keys, text): the tokens joined, each followed by ``<tag>`` where there is one other than O."""
    t = F.col(token) if tag is None else F.concat(F.col(token), F.when(F.coalesce(F.col(tag), F.lit("O")).isin("O", ""), "").otherwise(F.concat(F.lit(" <"), F.col(tag), F.lit(">"))))
    rows = tokens.select(*keys, F.struct("idx", t.alias("t")).alias("x"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), sep).alias("text"))


def highlight(spans: DataFrame, text: str = "text", tag: str = "tag") -> Column:
    """A span as HTML, its text escaped."""
    return F.concat(F.lit('<mark class="'), F.col(tag), F.lit('">'), tx.escape_html(F.col(text)), F.lit("</mark>"))


def buckets(c: Column, low: float, high: float, n: int) -> Column:
    """The colour bucket 0 to n - 1 of an activation; values outside go to the ends."""
    return F.least(F.greatest(F.floor((c - low) / (high - low) * n), F.lit(0)), F.lit(n - 1)).cast("int")


def pad_ids(c: Column, size: int | Column, pad: int | str = 0) -> Column:
    """An array of ``size`` at least; a longer one stays whole."""
    size = F.lit(size) if isinstance(size, int) else size
    return F.concat(c, F.array_repeat(F.lit(pad), F.greatest(size - F.size(c), F.lit(0))))


def one_hot(labels: Column, classes: list[str]) -> Column:
    return F.array(*[F.coalesce(F.array_contains(labels, x), F.lit(False)).cast("int") for x in classes])


def clip_long(sentences: DataFrame, size: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The sentences of at most ``most`` tokens, and one row (removed, longest) about all."""
    return sentences.filter(F.col(size) <= most), sentences.agg(F.sum((F.col(size) > most).cast("bigint")).alias("removed"), F.max(size).alias("longest"))
