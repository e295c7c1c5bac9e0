"""Problem 7: held-out passages that stand whole or in part in a corpus, by q-gram filtering and banded alignment.

The q-grams of the passages form an index. Every document is scanned once; hits are counted per passage in overlapping
bands of diagonals; by the q-gram lemma a stretch of L characters with at most e edits shares at least L - q + 1 - q * e
q-grams within its band, so only such regions are aligned. The alignment runs over all regions of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import codepoints as cp
from quillmill.session import cut

Q = 8
FILTER = 1 << 22
HITS = 5_000_000  # q-gram hits that are counted at a time
BLOCK_CHARS = 2_000_000  # characters of passages that are sent to the workers at a time


class Index:
    """The q-grams of a block of passages; passages whose needed stretch is short form groups with a smaller q."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, offs: np.ndarray, edits: int):
        self.ids, self.codes, self.offs, self.edits = ids, codes, offs, edits
        n = np.diff(offs)
        self.need = (n + 1) // 2
        q = np.clip(self.need // (edits + 1), 1, Q)
        self.groups = []
        for value in np.unique(q[n > 0]).tolist():
            rows = np.flatnonzero((q == value) & (n > 0))
            c, o = cp.take_rows(codes, offs, rows)
            h, go = cp.gram_hashes(c, o, value)
            item = rows[cp.row_of(go)]
            place = np.arange(len(h)) - np.repeat(go[:-1], np.diff(go))
            order = np.argsort(h, kind="stable")
            some = np.zeros(FILTER, bool)
            some[(h >> np.uint64(42)).astype(np.int64)] = True
            self.groups.append((value, h[order], item[order], place[order], some))

    def regions(self, codes: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document row, passage, lowest diagonal) of bands with enough hits."""
        for group in self.groups:
            yield from self._regions(codes, offs, group)

    def _regions(self, codes: np.ndarray, offs: np.ndarray, group: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for q, grams, item, place, some in (group,):
            h, go = cp.gram_hashes(codes, offs, q)
            at = np.flatnonzero(some[(h >> np.uint64(42)).astype(np.int64)])
            lo, hi = np.searchsorted(grams, h[at], "left"), np.searchsorted(grams, h[at], "right")
            ok = hi > lo
            at, lo, n = at[ok], lo[ok], (hi - lo)[ok]
            if not len(at):
                continue
            rows = len(offs) - 1
            if n.sum() > HITS and rows > 1:  # passages that share much: half of the documents at a time
                for a, b in ((0, rows // 2), (rows // 2, rows)):
                    part = codes[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                    for r, i, low in self._regions(*part, (q, grams, item, place, some)):
                        yield r + a, i, low
                continue
            row = np.searchsorted(go, at, "right") - 1
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, it = np.repeat(row, n), item[which]
            diagonal = np.repeat(at - go[row[np.cumsum(n) - n]], n) - place[which]
            width = self.edits + 1
            band = np.floor_divide(diagonal, width)
            if self.edits:  # a band and the next: each hit counts in two overlapping bands
                row, it, band = np.tile(row, 2), np.tile(it, 2), np.concatenate([band, band - 1])
            order = np.lexsort((band, it, row))
            row, it, band = row[order], it[order], band[order]
            first = np.concatenate([[True], (row[1:] != row[:-1]) | (it[1:] != it[:-1]) | (band[1:] != band[:-1])])
            start = np.flatnonzero(first)
            count = np.diff(np.append(start, len(row)))
            ok = count >= np.maximum(1, self.need[it[start]] - q + 1 - q * self.edits)
            start = start[ok]
            yield row[start], it[start], band[start] * width

    def longest(self, codes: np.ndarray, offs: np.ndarray, row: np.ndarray, item: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The longest stretch of the passage that aligns within the band with at most ``edits`` edits (0: an unbroken run)."""
        width = 1 if not self.edits else 2 * (self.edits + 1) + 2 * self.edits
        low = low - (self.edits if self.edits else 0)
        n, size = np.diff(self.offs)[item], np.diff(offs)[row]
        run = np.zeros((self.edits + 1, len(row), width + 2), np.int32)
        best = np.zeros(len(row), np.int32)
        lanes = np.arange(width)
        for i in range(int(n.max(initial=0))):
            live = np.flatnonzero(i < n)
            d = low[live, None] + lanes + i
            inside = (d >= 0) & (d < size[live, None])
            there = codes[np.where(inside, offs[row[live], None] + d, 0)]
            same = inside & (there == self.codes[self.offs[item[live]] + i, None])
            old = run[:, live].copy()
            for k in range(self.edits + 1):
                now = np.where(same, old[k, :, 1:-1] + 1, 0)
                if k:
                    miss = np.maximum(np.where(inside, old[k - 1, :, 1:-1] + 1, 0), old[k - 1, :, 2:] + 1)
                    for lane in range(width):  # a document character that the passage lacks
                        skip = run[k - 1, live, lane]
                        now[:, lane] = np.maximum(now[:, lane], np.maximum(np.where(same[:, lane], 0, miss[:, lane]), skip))
                run[k, live, 1:-1] = now
            np.maximum.at(best, live, run[-1, live, 1:-1].max(axis=1))
        return best


def _scan(index) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = Index(*index.value)
        for batch in cp.slices(batches, "text"):
            codes, offs = cp.core(*cp.flatten(batch["text"]))
            ids = batch["id"].to_numpy(zero_copy_only=False)
            for row, item, low in ix.regions(codes, offs):
                for at in range(0, len(row), 20_000):
                    part = slice(at, at + 20_000)
                    best = ix.longest(codes, offs, row[part], item[part], low[part])
                    ok = best >= ix.need[item[part]]
                    if ok.any():
                        yield pa.RecordBatch.from_arrays([pa.array(ids[row[part][ok]]), pa.array(ix.ids[item[part][ok]]), pa.array(best[ok])], names=["doc_id", "item_id", "run"])

    return run


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in cp.slices(batches, "text"):
        c, o = cp.core(*cp.flatten(batch["text"]))
        yield pa.RecordBatch.from_arrays([batch["id"], cp.unflatten(c, o)], names=["id", "c"])


def leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", edits: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, run): documents that hold at least half of a passage, rounded up, with the longest stretch found.

    Both sides are compared by their cores. Null texts and ids and passages without a letter, mark or digit take no part; a
    document delivered twice counts once. With ``edits`` above 0 the stretch may have so many edits. The passages are the
    query set: they are sent to the workers in blocks of at most about ``block_chars`` characters, and all documents are
    scanned for each block, so no size of the set breaks a worker. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    held = items.select(F.col(item_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["id"])
    total = held.agg(F.sum(F.length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    held = held.withColumn("block", F.expr(f"pmod(xxhash64(id), {blocks})"))
    found = []
    for block in range(blocks):
        got = held.filter(F.col("block") == block).select("id", "text").mapInArrow(_passages, "id bigint, c string").toArrow()
        codes, offs = cp.flatten(got["c"])
        index = spark.sparkContext.broadcast((got["id"].to_numpy(), codes, offs, edits))
        found.append(cut(docs.mapInArrow(_scan(index), "doc_id bigint, item_id bigint, run int"), "leaks"))
        index.destroy()  # one block of passages is held at a time
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))
