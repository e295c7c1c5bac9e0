"""Dense vectors: pooling, cosine, k-means over lengths. Null vectors take no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.ranking import global_rank


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def two_step_lookup(tokens: DataFrame, word: str, lemma: str, table: DataFrame) -> DataFrame:
    """The tokens with ``vec``: that of the word, else of the lemma, of length 1; null where neither is known. ``table`` has (word, vec)."""
    a = table.select(F.col("word").alias(word), F.col("vec").alias("__a"))
    b = table.select(F.col("word").alias(lemma), F.col("vec").alias("__b"))
    return tokens.join(a, word, "left").join(b, lemma, "left").withColumn("vec", normalized(F.coalesce("__a", "__b"))).drop("__a", "__b")


def pool(df: DataFrame, by: str, vec: str, how: str = "mean") -> DataFrame:
    """(by, dim, value): mean, max, min or sum of each dimension; partial sums go over the shuffle, not vectors."""
    f = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[how]
    each = df.select(by, F.posexplode(vec).alias("dim", "x"))
    return each.groupBy(by, "dim").agg(F.round(f(F.col("x").cast("double")), 4).alias("value"))


def nest(pooled: DataFrame, by: str) -> DataFrame:
    """(by, vec) from (by, dim, value)."""
    return pooled.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("vec"))


def pool_weighted(df: DataFrame, by: str, vec: str, weight: str) -> DataFrame:
    """(by, dim, value): sums of weighted dimensions."""
    each = df.select(by, F.col(weight).alias("__w"), F.posexplode(vec).alias("dim", "x"))
    return each.groupBy(by, "dim").agg(F.round(F.sum(F.col("__w") * F.col("x").cast("double")), 4).alias("value"))


def faded(df: DataFrame, by: str, order: str, vec: str, keep: float = 0.5) -> DataFrame:
    """(by, dim, value): a memory that keeps ``keep`` of itself at each occurrence in order.

    In closed form: the i-th vector from the end weighs (1 - keep) * keep ** i, the first of all keep ** (n - 1). Places come from a
    rank over the whole table, so a key that holds a third of all rows is spread like the others.
    """
    rows = df.filter(F.col(vec).isNotNull() & F.col(by).isNotNull())
    ranked = global_rank(rows.select(by, order, vec), F.col(by), F.col(order), name="__r")
    ends = ranked.groupBy(by).agg(F.min("__r").alias("__a"), F.max("__r").alias("__z"))
    back = F.pow(F.lit(keep), (F.col("__z") - F.col("__r")).cast("double"))
    return pool_weighted(ranked.join(ends, by).withColumn("__w0", F.when(F.col("__r") == F.col("__a"), back).otherwise((1 - keep) * back)), by, vec, "__w0")


def teacher_pool(df: DataFrame, by: str, vec: str, score: str) -> DataFrame:
    """(by, dim, value): the mean of several systems' vectors, weighted by the softmax of their scores within ``by``."""
    total = df.groupBy(by).agg(F.sum(F.exp(score)).alias("__z"))
    return pool_weighted(df.join(total, by).withColumn("__s", F.exp(score) / F.col("__z")), by, vec, "__s")


def nearest(queries: DataFrame, corpus: DataFrame, q: str, key: str, vec: str, k: int = 5, block: int = 5_000) -> DataFrame:
    """(q, rank, key, score): the k nearest rows by cosine, exact; every query meets every row, in blocks.

    Blocks have about ``block`` rows on either side, so their number follows the tables; a pair of blocks is one product of matrices and sends
    on only its k best, so that what is shuffled after it is k rows per query and block. Ties fall to the smaller key.
    """
    import numpy as np
    import pandas as pd

    types = dict(corpus.dtypes)
    left = queries.filter(F.col(vec).isNotNull()).select(F.col(q).alias("__id"), F.col(vec).alias("__v"))
    right = corpus.filter(F.col(vec).isNotNull()).select(F.col(key).alias("__id"), F.col(vec).alias("__v"))
    qs, cs = (max(1, -(-x.count() // block)) for x in (left, right))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = lambda n, name: F.pmod(F.xxhash64("__id"), F.lit(n)).cast("int").alias(name)
    a = left.select(own(qs, "qb"), spread(cs, "cb"), "__id", "__v")
    b = right.select(own(cs, "cb"), spread(qs, "qb"), "__id", "__v")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({q: x.get("__id", pd.Series(dtype="int64"))[:0], key: y.get("__id", pd.Series(dtype="int64"))[:0], "score": pd.Series(dtype="float64")})
        unit = lambda v: (m := np.stack(v.to_numpy()).astype(float)) / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        y = y.sort_values("__id", kind="stable")  # so that a stable order by score breaks ties by key
        ids, to = y["__id"].to_numpy(), unit(y["__v"])
        out = []
        for at in range(0, len(x), 500):
            mine = x["__id"].to_numpy()[at : at + 500]
            s = np.round(unit(x["__v"].iloc[at : at + 500]) @ to.T, 5)
            s[mine[:, None] == ids[None, :]] = -2
            least = -np.partition(-s, min(k, s.shape[1]) - 1, axis=1)[:, min(k, s.shape[1]) - 1]
            row, col = np.nonzero((s >= least[:, None]) & (s > -2))  # the k best and those that tie with the last
            order = np.lexsort((col, -s[row, col], row))
            row, col = row[order], col[order]
            n = np.bincount(row, minlength=len(mine))
            ok = np.arange(len(row)) - (np.cumsum(n) - n)[row] < k
            out.append(pd.DataFrame({q: mine[row[ok]], key: ids[col[ok]], "score": s[row[ok], col[ok]]}))
        return pd.concat(out)

    schema = f"{q} {dict(queries.dtypes)[q]}, {key} {types[key]}, score double"
    best = a.groupBy("qb", "cb").cogroup(b.groupBy("qb", "cb")).applyInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy(q).orderBy(F.desc("score"), key))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select(q, "rank", key, "score")


def kmeans_lengths(df: DataFrame, length: str, k: int, rounds: int = 50) -> DataFrame:
    """(length, n, cluster): one-dimensional k-means over distinct lengths weighted by their counts; there are as many rows as lengths.

    The distinct lengths are the only thing a task holds; they are bounded by the longest text. Clusters are in the order of their means.
    """
    import numpy as np
    import pandas as pd

    counts = df.filter(F.col(length).isNotNull()).groupBy(F.col(length).cast("bigint").alias("length")).agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length")
        x, w = pdf["length"].to_numpy(float), pdf["n"].to_numpy(float)
        c = np.quantile(x, (np.arange(min(k, len(x))) + 0.5) / min(k, len(x)))
        for _ in range(rounds):
            own = np.abs(x[:, None] - c[None, :]).argmin(axis=1)
            new = np.array([np.average(x[own == j], weights=w[own == j]) if (own == j).any() else c[j] for j in range(len(c))])
            if np.allclose(new, c):
                break
            c = new
        return pdf.assign(cluster=own.astype("int64"))

    return counts.groupBy(F.lit(1).alias("__g")).applyInPandas(lambda pdf: run(pdf[["length", "n"]]), "length bigint, n bigint, cluster bigint")
