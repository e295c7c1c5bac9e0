"""Problem 2: how often each distinct term occurs, and in how many records.

Every task counts its block of rows. The terms of all blocks give one dictionary of dense integers: terms are spread by
hash, ranked within a part, and the parts are set one after another by a prefix sum. Blocks are encoded by it, added up
as arrays by range of identifiers within each task, and the arrays of a range are added over the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.session import cut

RANGE_BITS = 16
BLOCK_TERMS = 500_000  # distinct terms a task holds before it sends a block
RARE, COMMON_PERCENT = 2, 5


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occ, rec, rows = Counter(), Counter(), 0

    def out() -> pa.RecordBatch:
        terms = list(occ)
        return pa.RecordBatch.from_arrays([pa.array([*terms, None], pa.string()), pa.array([*(occ[t] for t in terms), 0], pa.int64()), pa.array([*(rec[t] for t in terms), rows], pa.int64())], names=["term", "occ", "rec"])

    for batch in batches:
        for text in batch["text"].to_pylist():
            terms = text.split(" ")
            occ.update(terms)
            rec.update(set(terms))
        rows += batch.num_rows
        for c in (occ, rec):
            c.pop("", None)
        if len(occ) > BLOCK_TERMS:
            yield out()
            occ, rec, rows = Counter(), Counter(), 0
    yield out()


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the encoded blocks of a task; one row per range of identifiers."""
    held = [np.zeros((3, 0), np.int64)]

    def out() -> Iterator[pa.RecordBatch]:
        ident, occ, rec = np.concatenate(held, axis=1)
        ids, at = np.unique(ident, return_inverse=True)
        sums = [np.zeros(len(ids), np.int64) for _ in range(2)]
        np.add.at(sums[0], at, occ)
        np.add.at(sums[1], at, rec)
        span = ids >> RANGE_BITS
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), span[1:] != span[:-1]]))
        cols = [[x[a:b].tobytes() for a, b in zip(start, [*start[1:], len(ids)], strict=True)] for x in (ids, *sums)]
        yield pa.RecordBatch.from_arrays([pa.array(span[start]), *(pa.array(c, pa.binary()) for c in cols)], names=["span", "ids", "occ", "rec"])

    for batch in batches:
        held.append(np.stack([batch[k].to_numpy() for k in ("ident", "occ", "rec")]))
        if sum(x.shape[1] for x in held) > 2_000_000:
            yield from out()
            held = [np.zeros((3, 0), np.int64)]
    yield from out()


def _sum_range(table: pa.Table) -> pa.Table:
    span = table["span"][0].as_py()
    total = np.zeros((2, 1 << RANGE_BITS), np.int64)
    for ids, occ, rec in zip(*(table[k].to_pylist() for k in ("ids", "occ", "rec")), strict=True):
        at = np.frombuffer(ids, np.int64) & ((1 << RANGE_BITS) - 1)
        total[0, at] += np.frombuffer(occ, np.int64)
        total[1, at] += np.frombuffer(rec, np.int64)
    have = np.flatnonzero(total[1])
    return pa.table({"ident": have + (span << RANGE_BITS), "occurrences": total[0, have], "records": total[1, have]})


def dictionary(terms: DataFrame, parts: int | None = None) -> DataFrame:
    """(term, ident): dense identifiers from 0 for distinct terms."""
    parts = parts or int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = terms.distinct().withColumn("part", F.expr(f"pmod(xxhash64(term), {4 * parts})"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1)
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))  # 4 * parts rows
    base = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return ranked.join(F.broadcast(base), "part").select("term", (F.col("base") + F.col("rank")).alias("ident"))


def term_counts(df: DataFrame, id_col: str = "sentence_id", text_col: str = "text") -> DataFrame:
    """(term, occurrences, records, mark) of every distinct term of all rows.

    A term is a maximal run of characters other than U+0020, compared as stored. mark is ``rare`` for terms in at most 2
    records, ``common`` for terms in more than 5 % of the records with text, else null. A row delivered twice counts once; rows
    with null text or id take no part; an empty table gives no terms. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["id"])
    blocks = cut(rows.select("text").mapInArrow(_blocks, "term string, occ bigint, rec bigint"), "term-blocks")
    total = blocks.filter("term IS NULL").agg(F.sum("rec").alias("n"))
    named = blocks.filter("term IS NOT NULL")
    terms = cut(dictionary(named.select("term")), "term-ids")
    encoded = named.join(terms, "term").select("ident", "occ", "rec")
    spans = encoded.mapInArrow(_by_range, "span bigint, ids binary, occ binary, rec binary")
    sums = spans.groupBy("span").applyInArrow(_sum_range, "ident bigint, occurrences bigint, records bigint")
    n = total.collect()[0][0] or 0
    mark = F.when(F.col("records") <= RARE, "rare").when(F.col("records") * 100 > F.lit(n * COMMON_PERCENT), "common")
    return sums.join(terms, "ident").select("term", "occurrences", "records", mark.alias("mark"))
