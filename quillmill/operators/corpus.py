"""Vocabularies, dictionaries, statistics, splits and samples of corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.operators.ranking import global_rank, hash_rank


def vocabulary(tokens: DataFrame, token: str, position: list[str], max_tokens: int = -1, min_freq: int = -1) -> DataFrame:
    """(item, idx): ``<unk>`` is 0, then terms by falling frequency, the first seen first; ends at ``max_tokens`` or below ``min_freq``."""
    counted = tokens.groupBy(F.col(token).alias("item")).agg(F.count("*").alias("n"), F.min(F.struct(*position)).alias("first"))
    if min_freq > 0:
        counted = counted.filter(F.col("n") >= min_freq)
    ranked = global_rank(counted, F.desc("n"), F.col("first"), F.col("item"))
    if max_tokens >= 0:
        ranked = ranked.filter(F.col("rank") < max_tokens)
    spark = tokens.sparkSession
    return spark.createDataFrame([("<unk>", 0)], "item string, idx int").unionByName(ranked.select("item", (F.col("rank") + 1).cast("int").alias("idx")))


def first_seen_dictionary(values: DataFrame, item: str, position: list[str], lead: tuple[str, ...] = (), tail: tuple[str, ...] = ()) -> DataFrame:
    """(item, idx) in the order of first appearance, between fixed items."""
    known = values.filter(F.col(item).isNotNull() & ~F.col(item).isin(*lead, *tail, "")) if lead or tail else values.filter(F.col(item).isNotNull() & (F.col(item) != ""))
    seen = known.groupBy(F.col(item).alias("item")).agg(F.min(F.struct(*position)).alias("first"))
    ranked = global_rank(seen, F.col("first"), F.col("item")).select("item", (F.col("rank") + len(lead)).cast("int").alias("idx"))
    spark = values.sparkSession
    if lead:
        ranked = ranked.unionByName(spark.createDataFrame([(x, i) for i, x in enumerate(lead)], "item string, idx int"))
    if tail:
        last = ranked.agg(F.max("idx").alias("m"))
        ends = spark.createDataFrame([(x, i) for i, x in enumerate(tail)], "item string, i int")
        ranked = ranked.unionByName(ends.join(F.broadcast(last)).select("item", (F.col("m") + 1 + F.col("i")).cast("int").alias("idx")))
    return ranked


def sorted_vocabulary(tokens: DataFrame, token: str, min_freq: int = 1, specials: tuple[str, ...] = ("<pad>", "<unk>")) -> DataFrame:
    """(item, idx): specials first, then the terms of enough frequency in binary order."""
    kept = tokens.groupBy(F.col(token).alias("item")).agg(F.count("*").alias("n")).filter((F.col("n") >= min_freq) & ~F.col("item").isin(*specials))
    ranked = global_rank(kept, F.col("item")).select("item", (F.col("rank") + len(specials)).cast("int").alias("idx"))
    return ranked.unionByName(tokens.sparkSession.createDataFrame([(x, i) for i, x in enumerate(specials)], "item string, idx int"))


def encode(tokens: DataFrame, token: str, dictionary: DataFrame, unknown: int = 0) -> DataFrame:
    """Adds ``idx``; unknown items get ``unknown``."""
    return tokens.join(dictionary.select(F.col("item").alias(token), F.col("idx").alias("ident")), token, "left").withColumn("ident", F.coalesce("ident", F.lit(unknown)))


def lookup_with_fallback(words: DataFrame, word: str, table: DataFrame) -> DataFrame:
    """(word, ident, how): exact, else lower case, else digits as #, else digits as 0; null where none is known. One join for all variants."""
    c = F.col("word")
    low = F.lower(c)
    variants = F.array(*[F.struct(F.lit(i).alias("how"), v.alias("item")) for i, v in enumerate((c, low, F.regexp_replace(low, r"(?U)\d", "#"), F.regexp_replace(low, r"(?U)\d", "0")))])
    each = words.select(F.col(word).alias("word")).filter("word IS NOT NULL").distinct().select("word", F.inline(variants))
    hit = each.join(table.select("item", "idx"), "item")
    best = hit.groupBy("word").agg(F.min_by("idx", "how").alias("ident"), F.min("how").alias("how"))
    return each.select("word").distinct().join(best, "word", "left")


def statistics(sentences: DataFrame, by: list[str], tokens: str = "n_tokens") -> DataFrame:
    """Documents and total, least, most and mean tokens per group."""
    n = F.col(tokens)
    return sentences.groupBy(*by).agg(F.count("*").alias("sentences"), F.sum(n).alias("tokens"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


def share(df: DataFrame, label: str) -> DataFrame:
    """(label, n, pct) of all rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # one row per label


def ratio_split(df: DataFrame, key: str, train: float = 0.8, dev: float = 0.1, seed: str = "1") -> DataFrame:
    """Adds ``part``: int(n * train) rows train, int(n * dev) dev, the rest test, in hash order."""
    if train + dev >= 1:
        raise ValueError("train and dev must leave something for test")
    ranked = hash_rank(df, F.col(key), seed)
    n = df.count()
    a, b = int(n * train), int(n * train) + int(n * dev)
    return ranked.withColumn("part", F.when(F.col("rank") < a, "train").when(F.col("rank") < b, "dev").otherwise("test")).drop("rank")


def subset(df: DataFrame, key: str, ratio: float, seed: str = "1", at_least_one: bool = True) -> DataFrame:
    """int(n * ratio) rows without replacement, one at least where there are any."""
    n = int(df.count() * ratio)
    return hash_rank(df, F.col(key), seed).filter(F.col("rank") < max(int(at_least_one), n)).drop("rank")


def downsample(df: DataFrame, key: str, share: float, seed: str = "1") -> DataFrame:
    """round(n * share) rows; halves go to the even number."""
    n = round(df.count() * share)
    return hash_rank(df, F.col(key), seed).filter(F.col("rank") < n).drop("rank")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): 1 / n for sampling with equal classes."""
    return df.groupBy(label).agg(F.count("*").alias("n")).withColumn("weight", F.round(1 / F.col("n"), 8))


def _hex(c: Column, start: int = 1) -> Column:
    """A number of 32 bits from an md5."""
    return F.conv(F.substring(F.md5(c), start, 8), 16, 10).cast("bigint")


def placed(df: DataFrame, key: str, label: str, seed: str = "1") -> DataFrame:
    """Adds ``place`` from 0, random but repeatable, within each label, by ranks over the whole table: no label is one task."""
    mixed = df.filter(F.col(label).isNotNull()).withColumn("__h", F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))))
    ranked = global_rank(mixed, F.col(label), F.col("__h"), F.col(key), name="__r")
    first = ranked.groupBy(label).agg(F.min("__r").alias("__a"))
    return ranked.join(first, label).withColumn("place", F.col("__r") - F.col("__a")).drop("__h", "__r", "__a")


def balanced_sample(df: DataFrame, key: str, label: str, draws: int, seed: int = 1) -> DataFrame:
    """``draws`` draws with replacement in which every class is equally likely: (draw, key, label).

    A draw hashes to a class and to a place within it, so the join is by (class, place) and no class is collected.
    """
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    classes = global_rank(counts, F.col(label), name="class")
    k = classes.count()
    if not k:
        return df.select(F.lit(0).cast("bigint").alias("draw"), key, label).limit(0)
    h = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    drawn = df.sparkSession.range(draws).select(F.col("id").alias("draw"), (_hex(h) % k).alias("class"), _hex(h, 9).alias("h"))
    return drawn.join(classes, "class").withColumn("place", F.col("h") % F.col("n")).join(placed(df, key, label, str(seed)), [label, "place"]).select("draw", key, label)


def drawn_by_temperature(df: DataFrame, key: str, group: str, alpha: float = 0.7, seed: str = "1") -> DataFrame:
    """(key, group, turn): so many draws of each group as ``temperature`` gives it, through its rows in random order, again from the start when they are used up."""
    plan = temperature(df.filter(F.col(group).isNotNull()), group, alpha).select(group, "n", "draws")
    rows = placed(df, key, group, seed).join(plan, group)
    times = F.floor((F.col("draws") - F.col("place") + F.col("n") - 1) / F.col("n")).cast("int")
    return rows.withColumn("__t", times).filter("__t > 0").select(key, group, F.explode(F.sequence(F.lit(1), F.col("__t"))).alias("turn"))


def bucketed_batches(df: DataFrame, size: Column, key: str, buckets: int, budget: int) -> DataFrame:
    """(key, bucket, batch): rows in ``buckets`` of equal width of size; a bucket's batches hold as many rows as its largest size fits into the budget."""
    rows = df.select(key, size.alias("__n")).filter("__n > 0")
    span = rows.agg(F.min("__n").alias("lo"), F.max("__n").alias("hi"))  # one row
    width = F.greatest((F.col("hi") - F.col("lo") + 1) / buckets, F.lit(1.0))
    own = rows.join(F.broadcast(span)).withColumn("bucket", F.least(F.floor((F.col("__n") - F.col("lo")) / width), F.lit(buckets - 1)).cast("int"))
    most = own.groupBy("bucket").agg(F.max("__n").alias("__m"))  # a row per bucket
    ranked = placed(own.select(key, "bucket"), key, "bucket").join(most, "bucket")
    each = F.greatest(F.floor(F.lit(budget) / F.col("__m")), F.lit(1))
    return ranked.select(key, "bucket", F.floor(F.col("place") / each).cast("bigint").alias("batch"))


def rechunked(df: DataFrame, batch: str, key: str, size: int) -> DataFrame:
    """(key, batch, part): batches of more than ``size`` rows in parts of at most so many."""
    return placed(df.select(key, batch), key, batch).select(key, batch, F.floor(F.col("place") / size).cast("int").alias("part"))


def growing_blocks(df: DataFrame, key: str, first: int, factor: float = 2.0) -> DataFrame:
    """(key, block): blocks of consecutive rows, each ``factor`` times as large as the one before."""
    rank = F.col("rank")
    block = F.floor(F.log(1 + rank * (factor - 1) / first) / F.log(F.lit(factor)) + 1e-9) if factor != 1 else F.floor(rank / first)
    return global_rank(df, F.col(key)).select(key, block.cast("bigint").alias("block"))


def temperature(df: DataFrame, group: str, alpha: float = 0.7) -> DataFrame:
    """(group, n, p, draws): probabilities in proportion to (n / N) ** alpha, and int(p * N) draws."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # one row per group
    p = F.pow(F.col("n") / F.sum("n").over(every), F.lit(alpha))
    scaled = counts.withColumn("__p", p).withColumn("p", F.col("__p") / F.sum("__p").over(every))
    return scaled.withColumn("draws", F.floor(F.col("p") * F.sum("n").over(every)).cast("bigint")).withColumn("p", F.round("p", 6)).drop("__p")


def block_shuffle(df: DataFrame, key: str, size: int, seed: str = "1") -> DataFrame:
    """Adds ``block`` and ``place``: blocks of consecutive rows in hash order, rows in order within a block."""
    ranked = global_rank(df, F.col(key)).withColumn("block", F.floor(F.col("rank") / size))
    order = F.md5(F.concat(F.lit(seed + ":"), F.col("block").cast("string")))
    return ranked.withColumn("__o", order).withColumn("place", F.col("rank") % size).drop("rank").withColumnRenamed("__o", "block_order")


def schedule(df: DataFrame, corpus: str, batch: int, seed: str = "1") -> DataFrame:
    """(step, corpus): each corpus as often as it has batches, mixed in hash order."""
    n = df.groupBy(corpus).agg(F.ceil(F.count("*") / batch).cast("int").alias("n")).filter(F.col(corpus).isNotNull())
    each = n.select(corpus, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("turn"))
    mixed = hash_rank(each, F.concat_ws(":", corpus, F.col("turn").cast("string")), seed, "step")
    return mixed.select("step", corpus)


def upsample(df: DataFrame, corpus: str, rate: int) -> DataFrame:
    """Every corpus smaller than the largest is repeated ``rate`` times; adds ``copy`` from 1."""
    n = df.groupBy(corpus).agg(F.count("*").alias("__n"))
    times = n.withColumn("__t", F.when(F.col("__n") < F.max("__n").over(Window.partitionBy()), rate).otherwise(1))
    return df.join(times, corpus).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__t")))).drop("__n", "__t")


def evenly(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Every ``parts``-th row in the order of the key."""
    return global_rank(df, F.col(key)).filter(F.col("rank") % parts == 0).drop("rank")


def fixed_batches(df: DataFrame, *order: Column, size: int) -> DataFrame:
    """Adds ``batch``."""
    return global_rank(df, *order).withColumn("batch", F.floor(F.col("rank") / size).cast("bigint")).drop("rank")


def greedy_batches(df: DataFrame, group: str, key: str, size: str, budget: int) -> DataFrame:
    """Adds ``batch`` within each group: rows by size and key, a batch ends before its sizes pass the budget.

    The fold is sequential within a group, so groups should be bounded, such as one per shard and epoch.
    """

    def fold(pdf):
        pdf = pdf.sort_values([size, key], kind="stable")
        out, total, batch = [], 0, 0
        for n in pdf[size]:
            if total and total + n > budget:
                batch, total = batch + 1, 0
            total += n
            out.append(batch)
        return pdf.assign(batch=out)

    return df.groupBy(group).applyInPandas(fold, ", ".join(f"`{c}` {k}" for c, k in [*df.dtypes, ("batch", "bigint")]))


def with_splits(df: DataFrame, key: str, split: str = "split", share: float = 0.1, seed: str = "1") -> DataFrame:
    """The corpus with the splits it lacks: test, then dev, get round(n * share) training rows in hash order each."""
    have = {r[split]: r["n"] for r in df.groupBy(split).agg(F.count("*").alias("n")).limit(100).collect()}  # a row per split
    for name in ("test", "dev"):
        if not have.get(name) and have.get("train"):
            n = round(have["train"] * share)
            have["train"] -= n
            train = hash_rank(df.filter(F.col(split) == "train"), F.col(key), f"{seed}:{name}")
            moved = train.withColumn(split, F.when(F.col("rank") < n, name).otherwise(F.col(split))).drop("rank")
            df = df.filter(F.col(split).isNull() | (F.col(split) != "train")).unionByName(moved.select(*df.columns))
    return df


def rare_tags(tagged: DataFrame, split: str = "split", tag: str = "tag", most: int = 3) -> DataFrame:
    """One row: how many tags have at most ``most`` training tokens and occur in test."""
    n = tagged.filter(F.col(tag).isNotNull()).groupBy(tag).agg(F.sum((F.col(split) == "train").cast("bigint")).alias("a"), F.sum((F.col(split) == "test").cast("bigint")).alias("b"))
    return n.agg(F.sum(((F.col("a") <= most) & (F.col("b") > 0)).cast("bigint")).alias("rare"))


def field_ids(df: DataFrame, keys: list[str], text: str, dictionary: DataFrame, bos: int, eos: int, unknown: int = 0) -> DataFrame:
    """(keys, ids): the identifiers of the lower-cased tokens of each row between those of its begin and end."""
    from quillmill.operators.sequences import tokens

    rows = tokens(df, keys, text, offsets=False).withColumn("token", F.lower("token"))
    each = encode(rows, "token", dictionary, unknown).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ident"))), lambda x: x["ident"]).alias("ids"))
    return each.withColumn("ids", F.concat(F.array(F.lit(bos)), "ids", F.array(F.lit(eos))))
