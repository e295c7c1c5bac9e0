"""Scores of predictions. Intermediate values are rounded to four places where the usual scorer of the field does so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.operators.ranking import running_total


def divide(a: Column, b: Column) -> Column:
    """a / b to four places; 0 where b is 0."""
    return F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))


def f_score(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.round(2 * p * r / (p + r), 4)).otherwise(F.lit(0.0))


def token_confusion(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(class, tp, fp, fn): an equal pair is a hit of its class, another one a false positive and a false negative. A null prediction is O."""
    g, p = F.coalesce(F.col(gold), F.lit("O")), F.coalesce(F.col(pred), F.lit("O"))
    hit = g == p
    each = F.when(hit, F.array(F.struct(g.alias("class"), F.lit("tp").alias("o")))).otherwise(F.array(F.struct(p.alias("class"), F.lit("fp").alias("o")), F.struct(g.alias("class"), F.lit("fn").alias("o"))))
    rows = df.select(F.inline(each))
    count = lambda o: F.sum((F.col("o") == o).cast("bigint")).alias(o)
    return rows.groupBy("class").agg(count("tp"), count("fp"), count("fn"))


def prf(confusion: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 (of the rounded two) and accuracy tp / (tp + fp + fn)."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    rows = confusion.withColumn("precision", divide(tp, tp + fp)).withColumn("recall", divide(tp, tp + fn))
    return rows.withColumn("f1", f_score(F.col("precision"), F.col("recall"))).withColumn("accuracy", divide(tp, tp + fp + fn))


def summary(confusion: DataFrame) -> DataFrame:
    """One row: micro and macro F and accuracy, and the macro values without O."""
    micro = prf(confusion.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))).select(F.col("f1").alias("micro_f1"), F.col("accuracy").alias("micro_accuracy"))
    no_o = F.col("class") != "O"
    macro = prf(confusion).agg(
        F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.avg("accuracy"), 4).alias("macro_accuracy"),
        F.round(F.avg(F.when(no_o, F.col("f1"))), 7).alias("macro_f1_no_o"), F.round(F.avg(F.when(no_o, F.col("accuracy"))), 4).alias("macro_accuracy_no_o"),
    )
    return micro.join(macro)


def multilabel_confusion(df: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """(class, tp, fp, fn, tn) for arrays of labels over a fixed label set."""
    each = F.array(*[F.struct(F.lit(x).alias("class"), F.array_contains(gold, x).alias("g"), F.array_contains(pred, x).alias("p")) for x in labels])
    rows = df.select(F.inline(each)).fillna(False)
    g, p = F.col("g"), F.col("p")
    n = lambda c, name: F.sum(c.cast("bigint")).alias(name)
    return rows.groupBy("class").agg(n(g & p, "tp"), n(~g & p, "fp"), n(g & ~p, "fn"), n(~g & ~p, "tn"))


def span_confusion(gold: DataFrame, pred: DataFrame, on: list[str], kind: str, universe: DataFrame | None = None) -> DataFrame:
    """(class, tp, fp, fn) of two span tables that meet on all of ``on``; equal spans of one side count once.

    With ``universe``, the spans that could have been found (of any class), ``tn`` is added: those that neither side gives this class.
    """
    side = lambda df, g, p: df.select(*on).withColumn("g", F.lit(g)).withColumn("p", F.lit(p))
    both = side(gold, 1, 0).unionByName(side(pred, 0, 1)).groupBy(*on).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    n = lambda c, name: F.sum(c.cast("bigint")).alias(name)
    g, p = F.col("g"), F.col("p")
    found = both.groupBy(F.col(kind).alias("class")).agg(n(g * p, "tp"), n((1 - g) * p, "fp"), n(g * (1 - p), "fn"))
    if universe is None:
        return found
    every = universe.distinct().agg(F.count("*").alias("__n"))  # one row
    return found.join(F.broadcast(every)).select("class", "tp", "fp", "fn", (F.col("__n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))


def token_accuracy(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """(tokens, right, accuracy): tokens with the same whole tag; null is O."""
    same = (F.coalesce(F.col(gold), F.lit("O")) == F.coalesce(F.col(pred), F.lit("O"))).cast("bigint")
    return df.agg(F.count("*").alias("tokens"), F.sum(same).alias("right")).select("tokens", "right", F.round(100 * F.col("right") / F.col("tokens"), 2).alias("accuracy"))


def complete_match(df: DataFrame, keys: list[str], head: str = "head", rel: str = "rel", p_head: str = "p_head", p_rel: str = "p_rel", eps: float = 1e-12) -> DataFrame:
    """(uas, las, ucm, lcm): shares of tokens with the right head, head and relation, and of sentences where all are; ``eps`` guards empty input."""
    u = (F.col(head) == F.col(p_head)).cast("int")
    l = u * (F.col(rel) == F.col(p_rel)).cast("int")  # noqa: E741
    sent = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(u).alias("u"), F.sum(l).alias("l"))
    share = lambda a, b, name: F.round(F.coalesce(a, F.lit(0)) / (F.coalesce(b, F.lit(0)) + eps), 6).alias(name)
    full = lambda c: F.sum((F.col(c) == F.col("n")).cast("int"))
    return sent.agg(share(F.sum("u"), F.sum("n"), "uas"), share(F.sum("l"), F.sum("n"), "las"), share(full("u"), F.count("*"), "ucm"), share(full("l"), F.count("*"), "lcm"))


def grouped_span_scores(confusion: DataFrame) -> DataFrame:
    """Scores per class and overall (class null), by grouping sets."""
    rows = confusion.groupingSets([[F.col("class")], []], "class").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    return prf(rows)


def epsilon_f1(tp: Column, n_gold: Column, n_pred: Column, eps: float = 1e-12) -> Column:
    p, r = tp / (n_pred + eps), tp / (n_gold + eps)
    return 2 * p * r / (p + r + eps)


def regression(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Mean squared and absolute error, Pearson, and Spearman with mean ranks for ties. Rows with a null side are left out."""
    rows = df.select(F.col(gold).cast("double").alias("g"), F.col(pred).cast("double").alias("p")).filter("g IS NOT NULL AND p IS NOT NULL")
    # the rank of a value comes from counts per distinct value, so no task orders all rows
    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count("*").alias("n"))
        return running_total(counts, F.col(c), value=F.col("n")).select(c, (F.col("total") - (F.col("n") - 1) / 2).alias("r" + c))

    wide = rows.join(ranks("g"), "g").join(ranks("p"), "p")
    return wide.agg(F.round(F.avg(F.pow(F.col("g") - F.col("p"), 2)), 6).alias("mse"), F.round(F.avg(F.abs(F.col("g") - F.col("p"))), 6).alias("mae"), F.round(F.corr("g", "p"), 6).alias("pearson"), F.round(F.corr("rg", "rp"), 6).alias("spearman"))


def attachment(df: DataFrame, keys: list[str], head: str = "head", rel: str = "rel", p_head: str = "p_head", p_rel: str = "p_rel", counted: Column | None = None) -> DataFrame:
    """One row: uas, las over the counted tokens and the shares uem, lem of sentences all right, in percent."""
    u = (F.col(head) == F.col(p_head)).cast("int")
    l = u * (F.col(rel) == F.col(p_rel)).cast("int")  # noqa: E741
    rows = df.filter(counted) if counted is not None else df
    sent = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(u).alias("u"), F.sum(l).alias("l"))
    pct = lambda a, b: F.round(100 * F.sum(a) / F.sum(b), 6)
    return sent.agg(pct("u", "n").alias("uas"), pct("l", "n").alias("las"), F.round(100 * F.avg((F.col("u") == F.col("n")).cast("int")), 6).alias("uem"), F.round(100 * F.avg((F.col("l") == F.col("n")).cast("int")), 6).alias("lem"))


def graph_scores(df: DataFrame, gold: str, pred: str, keys: list[str]) -> DataFrame:
    """One row: precision, recall, F1 of edge sets given as arrays per token, and the share of sentences all right."""
    both = F.size(F.array_intersect(gold, pred))
    sent = df.groupBy(*keys).agg(F.sum(both).alias("tp"), F.sum(F.size(gold)).alias("g"), F.sum(F.size(pred)).alias("p"))
    s = sent.agg(F.sum("tp").alias("tp"), F.sum("g").alias("g"), F.sum("p").alias("p"), F.round(F.avg(((F.col("tp") == F.col("g")) & (F.col("tp") == F.col("p"))).cast("int")), 6).alias("exact"))
    return s.select(F.round(F.col("tp") / F.col("p"), 6).alias("precision"), F.round(F.col("tp") / F.col("g"), 6).alias("recall"), F.round(epsilon_f1(F.col("tp"), F.col("g"), F.col("p")), 6).alias("f1"), "exact")


def perplexity(df: DataFrame, p: str) -> DataFrame:
    """exp of the mean negative logarithm of positive probabilities."""
    return df.filter(F.col(p) > 0).agg(F.round(F.exp(F.avg(-F.log(p))), 6).alias("perplexity"))


def mean_score(df: DataFrame, by: str, score: str) -> DataFrame:
    """(by, n, total, mean) of a score per action; null scores don't count."""
    return df.groupBy(by).agg(F.count(score).alias("n"), F.round(F.sum(score), 6).alias("total"), F.round(F.avg(score), 6).alias("mean"))
