"""Problem 8: mixing sources to target shares of the tokens.

Each document gets a hash-random key. Within a source the keys are cut into even ranges; the token sums of the ranges give,
by a prefix sum, where each range begins, and a prefix sum within a range where each document does. A source's budget is then
a cut at an exact number of tokens, in the epoch that the budget ends in; all epochs before are whole. As keys are
random, the ranges of a source that holds a third of all documents are as even as those of any other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
ROWS_PER_RANGE = 20_000


@cache
def encoding(path: str):
    """The byte-level BPE of a rank file; the same on every worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixture", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoding(path).encode_ordinary
        for batch in batches:
            n = np.fromiter((len(count(x)) if x else 0 for x in batch["text"].to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["id"], batch["source"], pa.array(n)], names=["id", "source", "tokens"])

    return run


def vocabulary_of(df: DataFrame) -> str:
    """The rank file that the session names in ``spark.quillmill.vocabulary``; it must lie at this path on every worker."""
    return df.sparkSession.conf.get("spark.quillmill.vocabulary", VOCABULARY)


def token_counts(df: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, tokens) of each document; null and empty texts have 0 tokens."""
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col("source"), F.col(text_col).alias("text")).mapInArrow(_count(vocabulary or vocabulary_of(df)), "id bigint, source string, tokens bigint")


class Mixture:
    """The plan of one mixture: ``uses`` and ``report``.

    ``total`` is the wanted size in tokens; left out, it is the largest at which every source that has tokens can hold its share
    within its repeats. A source that can't fill its budget gives all it may, and the report shows the shares reached. Documents
    without source, of a source without target, or without tokens take no part; ids delivered twice count once.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str | None = None, seed: int = 7, rows_per_range: int = ROWS_PER_RANGE):
        targets = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.greatest(F.lit(0), F.coalesce(F.col("max_repeats"), F.lit(0))).alias("max_repeats")).filter("source IS NOT NULL AND target_share > 0")
        counted = token_counts(documents, vocabulary).filter("id IS NOT NULL AND source IS NOT NULL AND tokens > 0").dropDuplicates(["id"])
        self.keyed = cut(counted.withColumn("key", F.xxhash64(F.col("id"), F.lit(seed))), "mixture-tokens")
        size = self.keyed.count()
        self.bits = max(0, int(np.ceil(np.log2(max(1, size / rows_per_range)))))
        have = self.keyed.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("docs"))
        plan = targets.join(have, "source", "left").fillna(0, ["have", "docs"])
        cap = F.col("have") * F.col("max_repeats")
        whole = F.lit(total) if total is not None else F.floor(F.min(F.when(cap > 0, cap / F.col("target_share"))).over(Window.partitionBy()))
        budget = F.least(cap, F.floor(F.coalesce(whole, F.lit(0)) * F.col("target_share"))).cast("bigint")
        # one row per source: as many as there are targets
        self.plan = plan.withColumn("budget", budget).withColumn("epochs", F.when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have"))).otherwise(0).cast("int")).withColumn("rest", (F.col("budget") - F.col("epochs") * F.col("have")).cast("bigint"))

    def placed(self) -> DataFrame:
        """Each document with the tokens of its source before it in the order of keys."""
        part = F.shiftrightunsigned(F.col("key"), 64 - self.bits) if self.bits else F.lit(0).cast("bigint")
        rows = self.keyed.withColumn("range", part)
        sums = rows.groupBy("source", "range").agg(F.sum("tokens").alias("t"))
        before = sums.select("source", "range", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        within = F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1))
        placed = rows.withColumn("within", F.coalesce(within, F.lit(0)))
        return placed.join(before, ["source", "range"]).withColumn("before", F.col("base") + F.col("within")).drop("base", "within", "range", "key")

    def uses(self) -> DataFrame:
        """(source, epoch, doc_id, tokens, use_tokens): each use of a document; the one at the cut gives only its first use_tokens."""
        plan = self.plan.filter("budget > 0").select("source", "epochs", "rest")
        rows = self.placed().join(plan, "source")
        last = F.greatest(F.lit(0), F.least("tokens", F.col("rest") - F.col("before"))).cast("bigint")
        rows = rows.withColumn("last", last).withColumn("n", F.col("epochs") + F.when(F.col("last") > 0, 1).otherwise(0)).filter("n > 0")
        rows = rows.select("source", "id", "tokens", "last", "epochs", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("epoch"))
        return rows.select("source", "epoch", F.col("id").alias("doc_id"), "tokens", F.when(F.col("epoch") > F.col("epochs"), F.col("last")).otherwise(F.col("tokens")).alias("use_tokens"))

    def report(self) -> DataFrame:
        """One row per target: the share wanted and reached, tokens and documents used, the most uses of a document."""
        used = self.uses().groupBy("source").agg(F.sum("use_tokens").alias("used_tokens"), F.countDistinct("doc_id").alias("used_docs"), F.max("epoch").alias("most_uses"))
        all_used = F.sum("used_tokens").over(Window.partitionBy())
        wide = self.plan.join(used, "source", "left").fillna(0, ["used_tokens", "used_docs", "most_uses"])
        return wide.select("source", "target_share", F.round(F.when(all_used > 0, F.col("used_tokens") / all_used).otherwise(F.lit(0.0)), 6).alias("reached_share"), F.col("have").alias("have_tokens"), "used_tokens", "used_docs", "most_uses", "max_repeats")
