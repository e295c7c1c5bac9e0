"""Problem 1: records of evaluation splits that stand, whole or almost, in the training split.

The cores of the evaluation records are sharded, and of each shard an Aho-Corasick automaton is built. Every automaton scans all
training texts where they lie: the automata go to the texts, and no training text is moved.

Pairs: the patterns are the distinct 3-character pieces of the shard, numbered from the rarest on. What an automaton finds in
a training core are its pieces that the shard has; those that it lacks can't be shared and count as the rarest. A pair of
similarity t shares at least t of the pieces of either record, so whatever the edits are, the first of the pieces that it shares
stands in the first part of both (all but t of the pieces, and one more). Records that meet there and whose bitmaps of pieces
don't show that too many are lost are compared exactly; nothing that is similar enough is lost, repeats or not.

Coverage: the patterns are the segments of half a stretch that the evaluation cores are cut into. Any common stretch holds one
whole, so around each match the windows of a full stretch are looked up; the matched intervals of an evaluation record, in
whichever training records, are merged.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import codepoints as cp
from quillmill.session import cut

LOW, HIGH = 12, 300
SHARD_CHARS = 6_000_000  # characters of evaluation cores in one automaton; some 20 bytes each go to the workers
SCAN_BYTES = 1_000_000  # bytes of training texts that are scanned at a time
EXPANDED = 200_000  # meetings that are counted at a time
PAIRS = 8_000  # pairs that are compared at a time
MEET = 1  # pieces of the first part that a pair must share
WORDS = 4  # 64-bit words of a bitmap
STRETCH = 12  # characters of the shortest stretch that covers
LOW_BITS = 0xFFFFFFFF


def _cores(low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cp.slices(batches, "text"):
            ids, codes, offs = _batch(batch, low, high)
            yield pa.RecordBatch.from_arrays([pa.array(ids), cp.unflatten(codes, offs)], names=["id", "c"])

    return run


def _batch(batch: pa.RecordBatch, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    c, o = cp.core(*cp.flatten(batch["text"]))
    n = np.diff(o)
    ok = (n >= low) & (n <= high)
    return batch["id"].to_numpy(zero_copy_only=False)[ok], *cp.select_rows(c, o, ok)


def _starts(offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each run of ``size`` characters."""
    n = np.maximum(np.diff(offs) - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(np.arange(len(n)), n), np.arange(out[-1]) + np.repeat(offs[:-1] - out[:-1], n)


def _number(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A piece as a number: three code points of 21 bits."""
    c = codes.astype(np.int64)
    return c[at] << 42 | c[at + 1] << 21 | c[at + 2]


def _bitmaps(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bitmaps of the pieces of each row, word by word."""
    h, _ = cp.gram_hashes(codes, offs, 3)
    row, _ = _starts(offs, 3)
    out = np.zeros((WORDS, len(offs) - 1), np.uint64)
    np.bitwise_or.at(out, ((h >> np.uint64(62)).astype(np.int64), row), np.uint64(1) << (h & np.uint64(63)))
    return out


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper and lower half of the distinct numbers, in order."""
    key.sort()
    key = key[np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])]
    return key >> 32, key & LOW_BITS


def _strings(codes: np.ndarray, at: np.ndarray, size: int) -> list[str]:
    return cp.unflatten(codes[at[:, None] + np.arange(size)].ravel(), np.arange(0, size * len(at) + 1, size)).to_pylist()


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for k, word in enumerate(words):
        machine.add_word(word, k)
    machine.make_automaton()
    return machine


def _matches(machine: ahocorasick.Automaton, codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place of the last character, and pattern of every match in the rows; one pass over all of them, parted by a character that no core holds."""
    rows = len(offs) - 1
    wide = np.zeros(len(codes) + rows, np.uint32)
    row = cp.row_of(offs)
    wide[np.arange(len(codes)) + row] = codes
    found = machine.iter(wide.tobytes().decode("utf-32-le", "surrogatepass"))
    end, word = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2).T
    row = np.searchsorted(offs[1:] + np.arange(rows), end, "right")
    return row, end - row, word


class Pairs:
    """The pieces of a shard of evaluation cores."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, offs: np.ndarray, tenths: int):
        self.ids, self.codes, self.offs, self.tenths = ids, codes, offs, tenths
        row, at = _starts(offs, 3)
        number, first, place = np.unique(_number(codes, at), return_index=True, return_inverse=True)
        key = np.unique(row << 32 | place)
        holders = np.bincount(key & LOW_BITS, minlength=len(number))
        order = np.argsort(holders, kind="stable")  # new number -> old
        rank = np.empty(len(number), np.int64)
        rank[order] = np.arange(len(number))
        key = np.sort(key >> 32 << 32 | rank[key & LOW_BITS])
        row, piece = key >> 32, key & LOW_BITS
        self.size = np.bincount(row, minlength=len(ids))
        self.least = -(-tenths * self.size // 10)
        ok = np.arange(len(row)) - (np.cumsum(self.size) - self.size)[row] < (self.size - self.least + MEET)[row]
        row, piece = row[ok], piece[ok]
        # the holders of a piece in the order of their sizes, so that only those of a fitting size are met
        self.stride = int(self.size.max(initial=0)) + 2
        at_size = piece * self.stride + self.size[row]
        order_of = np.argsort(at_size, kind="stable")
        self.owner, self.at_size = row[order_of].astype(np.int32), at_size[order_of]
        self.bits = _bitmaps(codes, offs)
        self.machine = _automaton(_strings(codes, at[first[order]], 3)) if len(number) else None

    def scan(self, ids: np.ndarray, codes: np.ndarray, offs: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        """(held, train, shared, all_pieces) of every pair of similarity of at least ``tenths`` / 10."""
        rows = len(ids)
        if self.machine is None or not rows:
            return
        row, end, piece = _matches(self.machine, codes, offs)
        lacking, at = _starts(offs, 3)
        known = np.zeros(len(codes), bool)
        known[end] = True
        lacking, at = lacking[~known[at + 2]], at[~known[at + 2]]
        order = np.lexsort((number := _number(codes, at), lacking))
        lacking, number = lacking[order], number[order]
        new = np.concatenate([np.ones(min(1, len(number)), bool), (number[1:] != number[:-1]) | (lacking[1:] != lacking[:-1])])
        absent = np.bincount(lacking[new], minlength=rows)
        row, piece = _distinct(row << 32 | piece)
        have = np.bincount(row, minlength=rows)
        size = have + absent
        least = -(-self.tenths * size // 10)
        most = np.where(absent <= size - least, size - least + MEET - absent, 0)
        ok = np.arange(len(row)) - (np.cumsum(have) - have)[row] < most[row]
        row, piece = row[ok], piece[ok]
        low, high = -(-self.tenths * size // 10)[row], np.minimum(10 * size // self.tenths, self.stride - 1)[row]
        first = np.searchsorted(self.at_size, piece * self.stride + np.minimum(low, self.stride - 1), "left")
        n = np.searchsorted(self.at_size, piece * self.stride + high, "right") - first
        bits = _bitmaps(codes, offs)
        # whole rows, so many that about EXPANDED meetings are counted at a time
        meetings = np.concatenate([[0], np.cumsum(np.bincount(row, weights=n, minlength=rows).astype(np.int64))])
        edges = np.searchsorted(row, np.concatenate([[0], np.flatnonzero(np.diff(meetings[:-1] // EXPANDED)) + 1, [rows]]))
        left = np.zeros(0, np.int64)
        for lo, hi in zip(edges, edges[1:], strict=False):
            m = n[lo:hi]
            where = np.repeat(first[lo:hi], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            a, b = self.owner[where], np.repeat(row[lo:hi], m)
            both = self.size[a] + size[b]
            shared = -(-self.tenths * both // (10 + self.tenths))  # the least number of pieces that two of such sizes must share
            spare_a, spare_b = self.size[a] - shared, size[b] - shared
            for mine, other in zip(self.bits, bits, strict=True):
                x, y = mine[a], other[b]
                spare_a, spare_b = spare_a - np.bitwise_count(x & ~y), spare_b - np.bitwise_count(y & ~x)
                ok = np.flatnonzero((spare_a >= 0) & (spare_b >= 0))
                a, b, spare_a, spare_b = a[ok], b[ok], spare_a[ok], spare_b[ok]
            left = np.concatenate([left, np.unique(b << 32 | a)])
            if len(left) < PAIRS and hi < len(row):
                continue
            for low in range(0, len(left), PAIRS):
                j, i = left[low : low + PAIRS] >> 32, left[low : low + PAIRS] & LOW_BITS
                inter, union = cp.shared_trigrams(cp.take_rows(self.codes, self.offs, i), cp.take_rows(codes, offs, j))
                good = 10 * inter >= self.tenths * union
                yield {"held": self.ids[i[good]], "train": ids[j[good]], "shared": inter[good], "all_pieces": union[good]}
            left = left[:0]


class Cover:
    """The segments and windows of a shard of evaluation cores."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, offs: np.ndarray, stretch: int):
        self.ids, self.stretch, self.half = ids, stretch, stretch // 2
        row, at = _starts(offs, self.half)
        at = at[(at - offs[row]) % self.half == 0]
        self.machine = _automaton(list(dict.fromkeys(_strings(codes, at, self.half)))) if len(at) else None
        h, _ = cp.gram_hashes(codes, offs, stretch)
        row, at = _starts(offs, stretch)
        order = np.argsort(h, kind="stable")
        self.hash, self.row, self.place = h[order], row[order], (at - offs[row])[order]
        self.seen = np.zeros(len(h), bool)

    def scan(self, ids: np.ndarray, codes: np.ndarray, offs: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        """Nothing by batch: the windows met are marked until ``rest``."""
        if self.machine is not None and len(ids) and len(self.hash):
            row, end, _ = _matches(self.machine, codes, offs)
            near = np.zeros(len(codes), bool)
            for back in range(self.half - 1, self.stretch):
                start = end - back
                near[start[(start >= offs[row]) & (start + self.stretch <= offs[row + 1])]] = True
            h, go = cp.gram_hashes(codes, offs, self.stretch)
            _, at = _starts(offs, self.stretch)
            h = np.unique(h[near[at]])
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            edge = np.zeros(len(self.hash) + 1, np.int64)
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
            self.seen |= np.cumsum(edge[:-1]) > 0
        yield from ()

    def rest(self) -> Iterator[dict[str, np.ndarray]]:
        """(rid, start, stop) of the stretches met, merged as far as they touch."""
        row, start = self.row[self.seen], self.place[self.seen]
        self.seen[:] = False
        order = np.lexsort((start, row))
        row, start = row[order], start[order]
        first = np.concatenate([np.ones(min(1, len(row)), bool), (row[1:] != row[:-1]) | (start[1:] > start[:-1] + self.stretch)])
        last = np.append(first[1:], np.ones(min(1, len(row)), bool))
        yield {"rid": self.ids[row[first]], "start": start[first], "stop": start[last] + self.stretch}


def _build(make: Callable):
    def run(table: pa.Table) -> pa.Table:
        ids = table["rid"].to_numpy()
        return pa.table({"shard": table["shard"][:1], "index": pa.array([pickle.dumps(make(ids, *cp.flatten(table["c"])), 5)], pa.binary())})

    return run


_LOADED: dict = {}


def _scan(sent, names: list[str], low: int, high: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _LOADED.get("name") != name:  # a worker that runs several tasks loads a shard once
            _LOADED.update(name=name, index=pickle.loads(sent.value))
        index = _LOADED["index"]
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[k].astype(np.int64)) for k in names], names=names)
        for batch in cp.slices(batches, "text", SCAN_BYTES):
            yield from map(out, index.scan(*_batch(batch, low, high)))
        if hasattr(index, "rest"):
            yield from map(out, index.rest())

    return run


class CrossSplit:
    """Evaluation records against training records.

    Null texts, ids and splits and texts whose core has fewer than ``low`` or more than ``high`` characters take no part; a
    row delivered twice counts once; equal cores of evaluation records are looked up once; other columns are ignored; where
    a side is empty there are no pairs.
    """

    def __init__(self, df: DataFrame, id_col: str = "sentence_id", text_col: str = "text", split_col: str = "split", train: str = "train", held: tuple[str, ...] = ("dev", "test"), tenths: int = 7, low: int = LOW, high: int = HIGH, shard_chars: int = SHARD_CHARS):
        self.tenths, self.low, self.high, self.shard_chars = tenths, low, high, shard_chars
        rows = df.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        of = lambda x: x.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        self.train = of(rows.filter(F.col(split_col) == train))
        self.held = cut(of(rows.filter(F.col(split_col).isin(*held))).mapInArrow(_cores(low, high), "id bigint, c string").distinct(), "cross-held")
        self.reps = self.held.groupBy("c").agg(F.min("id").alias("rid"))

    def _scanned(self, make: Callable, names: list[str]) -> DataFrame:
        """What the automata of all shards find. A shard is built by one task, sent to the workers and taken back before the next."""
        spark = self.train.sparkSession
        chars = self.held.agg(F.sum(F.length("c"))).first()[0] or 0
        shards = max(1, -(-chars // self.shard_chars))
        reps = self.reps.withColumn("shard", F.expr(f"pmod(xxhash64(c), {shards})"))
        built = cut(reps.groupBy("shard").applyInArrow(_build(make), "shard bigint, index binary"), "cross-automata")
        schema = ", ".join(f"{k} bigint" for k in names)
        found = []
        for shard in range(shards):
            got = built.filter(F.col("shard") == shard).select("index").toArrow()["index"]
            if len(got):
                sent = spark.sparkContext.broadcast(got[0].as_py())
                found.append(cut(self.train.mapInArrow(_scan(sent, names, self.low, self.high), schema), "cross-found"))
                sent.destroy()
        return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)

    def pairs(self) -> DataFrame:
        """(id_held, id_train, shared, all_pieces) of all rows of similarity of at least ``tenths`` / 10."""
        tenths = self.tenths
        found = self._scanned(lambda i, c, o: Pairs(i, c, o, tenths), ["held", "train", "shared", "all_pieces"]).distinct()
        member = self.held.join(self.reps, "c").select("rid", F.col("id").alias("id_held"))
        return found.join(member, found.held == member.rid).select("id_held", F.col("train").alias("id_train"), "shared", "all_pieces")

    def coverage(self, stretch: int = STRETCH) -> DataFrame:
        """(id, n_chars, covered): for each evaluation record, the characters of its core in stretches of at least ``stretch`` that stand in training records."""
        cover = self._scanned(lambda i, c, o: Cover(i, c, o, stretch), ["rid", "start", "stop"]).distinct()
        w = Window.partitionBy("rid").orderBy("start", "stop")
        seen = F.coalesce(F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        merged = cover.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), seen))).groupBy("rid").agg(F.sum("new").alias("covered"))
        own = self.held.join(self.reps, "c").select("rid", "id", F.length("c").alias("n_chars"))
        return own.join(merged, "rid", "left").select("id", "n_chars", F.coalesce("covered", F.lit(0)).cast("bigint").alias("covered"))


def report(df: DataFrame, pairs: DataFrame, id_col: str = "sentence_id", split_col: str = "split", source_col: str = "source", held: tuple[str, ...] = ("dev", "test")) -> DataFrame:
    """(split, source, records, overlapping, pairs) per evaluation split and source; a missing source is its own group."""
    rows = df.filter(F.col(split_col).isin(*held)).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.min(split_col).alias("split"), F.min(source_col).alias("source"))
    hit = pairs.groupBy(F.col("id_held").alias("id")).agg(F.count("*").alias("n"))
    return rows.join(hit, "id", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
