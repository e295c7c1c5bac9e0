"""Problem 3: groups of texts that share most of their 3-character pieces, found with signature trees.

Texts are reduced to their core and equal cores are folded into one representative first, so copies cost nothing. Each
representative enters the trees of its rarest runs of six characters. A tree is built over the representatives that
hold one run: its leaves are records with a bitmap of their 3-character pieces and their size, inner nodes hold the OR of
the bitmaps below and the range of sizes. Each tree is traversed against itself; a pair of nodes is dropped when the
sizes or the largest overlap the bitmaps allow can't reach the threshold. The pairs of leaves that are left are checked
exactly.

How many runs a record needs: let a pair have similarity t = |A n B| / |A u B|, and let the pieces of A that B lacks form e
gaps along A. A gap loses at least two pieces and each junction adds at least two to B, so with m lost pieces
m + 2te <= (1-t)|A| and m >= 2e; a gap of k pieces breaks k+3 runs of six characters, hence at most
m + 3e <= 5(1-t)/(2(1+t)) |A| runs are broken. Longer runs have fewer holders, but of seven a similar pair of twelve characters
may have none in common. A record therefore enters as many trees as may be broken, and two more, taken in
one global order (rare first), as in prefix filtering. The argument takes it that a gap isn't filled by chance by equal
pieces from elsewhere in the text, which fails for texts over few letters and for texts that repeat themselves. Such texts
also enter trees of single pieces, all but t of theirs and one more; every other record enters those of these trees that its
own first pieces name. There a pair meets by the set bound alone, so no pair with such a text can be lost.

Routing: trees are spread over parts by the least of the pieces of their run, and runs are taken in the order of that
piece, so that neighbouring runs of a record go to one part and carry its bitmap once. What a record costs is bounded by that,
however many parts there are; their number follows from the number of runs alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import codepoints as cp
from quillmill.llm import cores
from quillmill.session import cut, partitions

RUN = 6  # characters of a routing run
PIECE = 3
FAN = 8  # children of a tree node
BITS, PIECE_BITS = 22, 20
BUCKETS, PIECES = 1 << BITS, 1 << PIECE_BITS  # of the tables of run counts and of piece counts
HEAVY = 1 / 16000  # share of the representatives from which a run counts as frequent
WORDS = 4  # 64-bit words of a full bitmap
CHUNK = 30_000  # representatives that a worker routes at a time; row numbers have 15 bits
TREE_CAP = 30_000  # a larger tree is built in parts that are traversed pairwise
PART = 250_000  # tree entries of one part
FRONTIER = 1_000_000  # node pairs held at a time
LOW, HIGH = 12, 300
EXACT = 1 << 23  # marks the number of a tree of pieces


def _cores(id_col: str, text_col: str, low: int, high: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cp.slices(batches, text_col):
            text = batch[text_col]
            c, o = cp.core(*cp.flatten(text))
            n = np.diff(o)
            ok = (n >= low) & (n <= high) & ~np.asarray(text.is_null()) & ~np.asarray(batch[id_col].is_null())
            if not ok.any():
                continue
            c, o = cp.select_rows(c, o, ok)
            mask = pa.array(ok)
            k = cores.cards(text.filter(mask))
            ids = batch[id_col].filter(mask).cast(pa.int64())
            h1, h2 = (cp.as_int64(cp.row_hash(c, o, s)) ^ k for s in (1, 2))
            cols = [ids, pa.array(h1), pa.array(h2), pa.array(k)]
            if with_text:
                cols.append(cp.unflatten(c, o))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "h1", "h2", "k", "c"][: len(cols)])

    return run


def core_rows(df: DataFrame, id_col: str, text_col: str, low: int = LOW, high: int = HIGH, with_text: bool = True) -> DataFrame:
    """(id, h1, h2, k, c) of the rows whose core has ``low`` to ``high`` characters; h1 and h2 identify core and card key."""
    schema = "id bigint, h1 bigint, h2 bigint, k bigint" + ", c string" * with_text
    return df.select(id_col, text_col).mapInArrow(_cores(id_col, text_col, low, high, with_text), schema)


def _first(x: np.ndarray) -> np.ndarray:
    """Marks the first of equal neighbours."""
    return np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])


def _grams(c: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each run, and the least hash of its pieces; the hash of each piece, whose rows follow from the lengths."""
    h, go = cp.gram_hashes(c, o, RUN)
    piece, po = cp.gram_hashes(c, o, PIECE)
    row = cp.row_of(go)
    at = np.arange(len(h)) - go[row] + po[row]
    least = np.minimum.reduce([piece[at + i] for i in range(RUN - PIECE + 1)]) if len(h) else h
    return row, h, least, piece


def _distinct_of_row(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Row and upper 49 bits of the hash of each distinct piece, as one sorted number."""
    key = row.astype(np.uint64) << np.uint64(49) | h >> np.uint64(15)
    key.sort()
    return key[_first(key)]


def _few(c: np.ndarray, o: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Marks texts over few letters for their size, and texts that repeat themselves: there a gap may be filled by chance."""
    letters = _distinct_of_row(cp.row_of(o), c.astype(np.uint64) << np.uint64(15))
    n = np.bincount((letters >> np.uint64(49)).astype(np.int64), minlength=len(o) - 1)
    return (20 * pieces > n**3) | (2 * pieces < np.diff(o) - 2)


def _first_pieces(key: np.ndarray, pieces: np.ndarray, t: float) -> np.ndarray:
    """Marks those of the sorted distinct pieces that a record must look up: all but t of them and one more, in the order of hashes."""
    row = (key >> np.uint64(49)).astype(np.int64)
    rank = np.arange(len(key)) - (np.cumsum(pieces) - pieces)[row]
    return rank <= np.floor((1 - t) * pieces + 1e-9).astype(np.int64)[row]


def _broken(t: float) -> float:
    """The share of its pieces that a record may have in broken runs."""
    return (RUN - 1) * (1 - t) / (2 * (1 + t))


def _count_runs(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least, piece, active, rows, runs = np.zeros(BUCKETS, np.int64), np.zeros(PIECES, np.int64), np.zeros(PIECES, np.int64), np.zeros(PIECES, bool), 0, 0
        for batch in (x.slice(at, CHUNK) for x in batches for at in range(0, x.num_rows, CHUNK)):
            c, o = cp.flatten(batch["c"])
            _, h, low, p = _grams(c, o)
            total += np.bincount((h >> np.uint64(64 - BITS)).astype(np.int64), minlength=BUCKETS)
            least += np.bincount((low >> np.uint64(64 - PIECE_BITS)).astype(np.int64), minlength=PIECES)
            key = _distinct_of_row(np.repeat(np.arange(len(o) - 1), np.maximum(np.diff(o) - PIECE + 1, 0)), p)
            cell = (key >> np.uint64(49 - PIECE_BITS)).astype(np.int64) & (PIECES - 1)
            piece += np.bincount(cell, minlength=PIECES)
            pieces = np.bincount((key >> np.uint64(49)).astype(np.int64), minlength=len(o) - 1)
            few = _few(c, o, pieces)
            active[cell[few[(key >> np.uint64(49)).astype(np.int64)] & _first_pieces(key, pieces, t)]] = True
            rows, runs = rows + batch.num_rows, runs + len(h)
        out = [np.array([0, 1]), np.array([rows, runs])], [np.flatnonzero(total >= max(4, 2 * runs / BUCKETS + rows * HEAVY / 2)), total], [np.flatnonzero(least > 100), least], [np.flatnonzero(piece > 100), piece], [np.flatnonzero(active), active]
        kind = np.repeat(np.arange(5), [len(x[0]) for x in out])
        n = np.concatenate([out[0][1], *(x[1][x[0]] for x in out[1:])]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([x[0] for x in out])), pa.array(n)], names=["kind", "bucket", "n"])

    return run


class Counts:
    """What the routing knows of all records: levels of runs, which least pieces and pieces are frequent, pieces of texts over few letters.

    The level of a bucket of runs is 0 for rare ones; each level more is twice as frequent. All rows are counted. Buckets below a
    bound in a partition aren't sent, so that a count may be too low; levels only give the order in which runs are taken, and any
    order is right.
    """

    def __init__(self, rows: int, runs: int, level: np.ndarray, crowded: np.ndarray, piece: np.ndarray, active: np.ndarray):
        self.rows, self.runs, self.level, self.crowded, self.piece, self.active = rows, runs, level, crowded, piece, active

    @classmethod
    def of(cls, reps: DataFrame, t: float) -> Counts:
        """At most BUCKETS + 3 * PIECES small rows come to the driver, however many records there are."""
        got = reps.select("c").mapInArrow(_count_runs(t), "kind bigint, bucket bigint, n bigint").groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
        kind, bucket, n = (got[k].to_numpy() for k in ("kind", "bucket", "n"))
        rows, runs = (int(n[(kind == 0) & (bucket == k)].sum()) for k in (0, 1))
        of = lambda k, size: np.bincount(bucket[kind == k], weights=n[kind == k], minlength=size)
        return cls(rows, runs, levels_of(bucket[kind == 1], n[kind == 1], rows, runs), of(2, PIECES) > PART, np.ceil(of(3, PIECES) / TREE_CAP).astype(np.int32), of(4, PIECES) > 0)


def levels_of(bucket: np.ndarray, n: np.ndarray, rows: int, runs: int) -> np.ndarray:
    level = np.zeros(BUCKETS, np.uint8)
    often = n >= max(8, rows * HEAVY + 2 * runs / BUCKETS)
    level[bucket[often]] = np.clip(1 + np.log2(n[often] / max(1.0, rows * HEAVY)), 1, 40)
    return level


def _bitmaps(key: np.ndarray, rows: int) -> np.ndarray:
    """Bitmaps of 256 bits of the distinct pieces of each row."""
    cell = (key >> np.uint64(47)).astype(np.int64)  # row and word
    out = np.zeros(rows * WORDS, np.uint64)
    start = np.flatnonzero(_first(cell))
    if len(start):
        out[cell[start]] = np.bitwise_or.reduceat(np.uint64(1) << (key & np.uint64(63)), start)
    return out.reshape(-1, WORDS)


def _widths(pieces: np.ndarray) -> np.ndarray:
    """Words of the bitmap that is sent for a record of so many pieces; a narrower one is the OR of the parts of the full one."""
    return np.where(pieces <= 42, 1, np.where(pieces <= 85, 2, WORDS))


def _fold(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(len(bits), bits.shape[1] // words, words), axis=1)


def _pack(ids: np.ndarray, pieces: np.ndarray, few: np.ndarray, bits: np.ndarray, count: np.ndarray, tree: np.ndarray) -> bytes:
    """Records in the order of ids, each with its bitmap once, and the trees that each enters."""
    w = _widths(pieces)
    near = [np.diff(ids, prepend=ids[:1]), pieces.astype(np.uint16), count.astype(np.uint16), few]
    near[0] = near[0].astype(np.uint32 if not len(ids) or near[0].max() < 1 << 32 else np.uint64)
    small = zstandard.compress(b"".join(x.tobytes() for x in near), 1)
    three = np.ascontiguousarray(tree.astype("<u4")).view(np.uint8).reshape(-1, 4)[:, :3]
    head = np.array([len(ids), len(tree), (w == 1).sum(), (w == 2).sum(), near[0].itemsize, ids[0], len(small)], np.int64)
    return b"".join([head.tobytes(), small, *(_fold(bits[w == k], k).tobytes() for k in (1, 2, WORDS)), three.tobytes()])


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    """ids, pieces, few, bitmaps of 4, 2 and 1 words (as wide as sent, wider ones left empty), entries of each record, trees."""
    n, entries, n1, n2, step, base, size = np.frombuffer(raw, np.int64, 7).tolist()
    at = 56 + size
    near = zstandard.decompress(raw[56:at])
    delta = np.frombuffer(near, np.uint32 if step == 4 else np.uint64, n).astype(np.int64)
    pieces, count = (np.frombuffer(near, np.uint16, n, n * (step + k)).astype(np.int64) for k in (0, 2))
    few = np.frombuffer(near, bool, n, n * (step + 4))
    w = _widths(pieces)
    four, two, one = (np.zeros((n, k), np.uint64) for k in (WORDS, 2, 1))
    for k, m, out in ((1, n1, one), (2, n2, two), (WORDS, n - n1 - n2, four)):
        out[w == k] = np.frombuffer(raw, np.uint64, m * k, at).reshape(-1, k)
        at += 8 * m * k
    two[w == WORDS] = _fold(four[w == WORDS], 2)
    one[w > 1] = _fold(two[w > 1], 1)
    three = np.frombuffer(raw, np.uint8, 3 * entries, at).reshape(-1, 3).astype(np.uint32)
    return np.cumsum(delta) + base, pieces, few, four, two, one[:, 0], count, three[:, 0] | three[:, 1] << np.uint32(8) | three[:, 2] << np.uint32(16)


def _route(t: float, parts: int, counts: Counts):
    lose = _broken(t)
    if parts > 1 << 25:
        raise ValueError("more tree entries than 2**25 parts can hold")

    def run_entries(row: np.ndarray, h: np.ndarray, least: np.ndarray, pieces: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, spreading number, tree number) of the runs that each record is routed by."""
        lv = counts.level[(h >> np.uint64(64 - BITS)).astype(np.int64)]
        # row, level, least piece and run in one number: its order is the order in which runs are taken
        run = row.astype(np.uint64) << np.uint64(49) | lv.astype(np.uint64) << np.uint64(43) | least >> np.uint64(43) << np.uint64(22) | h >> np.uint64(42)
        run.sort()
        run = run[_first(run)]
        row = (run >> np.uint64(49)).astype(np.int64)
        have = np.bincount(row, minlength=len(ids))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)
        ok = rank < np.floor(lose * pieces).astype(np.int64)[row] + 2
        row, run = row[ok], run[ok] & np.uint64((1 << 49) - 1)
        lv = (run >> np.uint64(43)).astype(np.int64)
        run &= np.uint64((1 << 43) - 1)
        low = run >> np.uint64(22)
        spread = np.where(counts.crowded[(low >> np.uint64(21 - PIECE_BITS)).astype(np.int64)], run, low)
        # trees of frequent runs are built in parts; a record enters each pair of parts that holds its own
        split = np.maximum(1, np.ceil(np.where(lv > 0, counts.rows * HEAVY * np.exp2(lv), 0) / TREE_CAP)).astype(np.int64)
        if (split > 1).any():
            own = (cp.mix(ids.view(np.uint64))[row] % split.astype(np.uint64)).astype(np.int64)
            again = np.repeat(np.arange(len(row)), split)
            j = np.arange(split.sum()) - np.repeat(np.cumsum(split) - split, split)
            lo, hi = np.minimum(own[again], j), np.maximum(own[again], j)
            row, run, spread = row[again], run[again], spread[again]
            pair = np.where(split[again] > 1, cp.mix((lo << 32 | hi).astype(np.uint64) + np.uint64(1)), np.uint64(0))
            run, spread = run ^ pair, spread ^ pair
        return row, cp.mix(spread), cp.mix(run) & np.uint64(EXACT - 1)

    def piece_entries(key: np.ndarray, pieces: np.ndarray, few: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for trees of pieces: of texts over few letters, and of records that name one of theirs."""
        cell = (key >> np.uint64(49 - PIECE_BITS)).astype(np.int64) & (PIECES - 1)
        key, cell = (x[counts.active[cell] & _first_pieces(key, pieces, t)] for x in (key, cell))
        row, h = (key >> np.uint64(49)).astype(np.int64), key & np.uint64((1 << 49) - 1)
        # a frequent piece has several trees: a text over few letters enters each of them, another record one
        split = np.maximum(1, counts.piece[cell]).astype(np.int64)
        times = np.where(few[row], split, 1)
        again = np.repeat(np.arange(len(row)), times)
        j = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        row, h, split = row[again], h[again], split[again]
        salt = np.where(few[row], j, (cp.mix(ids.view(np.uint64))[row] % split.astype(np.uint64)).astype(np.int64))
        h = cp.mix(h ^ cp.mix(salt.astype(np.uint64)))
        return row, h, h >> np.uint64(41) | np.uint64(EXACT)

    def blobs(ids: np.ndarray, c: np.ndarray, o: np.ndarray) -> Iterator[tuple[int, bytes]]:
        order = np.argsort(ids, kind="stable")
        ids, (c, o) = ids[order], cp.take_rows(c, o, order)
        row, h, least, piece = _grams(c, o)
        key = _distinct_of_row(np.repeat(np.arange(len(ids)), np.maximum(np.diff(o) - PIECE + 1, 0)), piece)
        bits, pieces = _bitmaps(key, len(ids)), np.bincount((key >> np.uint64(49)).astype(np.int64), minlength=len(ids))
        few = _few(c, o, pieces) if counts.active.any() else np.zeros(len(ids), bool)
        made = [run_entries(row, h, least, pieces, ids)]
        if counts.active.any():
            made.append(piece_entries(key, pieces, few, ids))
        row, spread, tree = (np.concatenate(x) for x in zip(*made, strict=True))
        entry = spread % np.uint64(parts) << np.uint64(39) | row.astype(np.uint64) << np.uint64(24) | tree
        entry.sort()
        part, row, tree = (entry >> np.uint64(39)).astype(np.int64), (entry >> np.uint64(24)).astype(np.int64) & 0x7FFF, entry & np.uint64(0xFFFFFF)
        edge = np.append(np.flatnonzero(_first(part)), len(part))
        for lo, hi in zip(edge, edge[1:], strict=False):
            start = np.flatnonzero(_first(row[lo:hi]))
            mine = row[lo:hi][start]
            yield int(part[lo]), _pack(ids[mine], pieces[mine], few[mine], bits[mine], np.diff(np.append(start, hi - lo)), tree[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([x.column("rid").to_numpy(zero_copy_only=False) for x in held])
            c, o = cp.flatten(pa.chunked_array([x.column("c") for x in held]))
            p, b = zip(*blobs(ids, c, o), strict=True) if len(ids) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(b, pa.binary())], names=["p", "blob"])

        for batch in (x.slice(at, CHUNK) for x in batches for at in range(0, x.num_rows, CHUNK)):
            if n + batch.num_rows > CHUNK:
                yield from out()
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from out()

    return run


class _Part:
    """All records and trees of one routing part."""

    def __init__(self, blobs: list[bytes]):
        got = [_unpack(x) for x in blobs]
        self.ids, self.size, self.few, self.four, self.two, self.one, count, tree = (np.concatenate(x) for x in zip(*got, strict=True))
        self.width = _widths(self.size)
        self.slack = np.maximum(self.size - np.bitwise_count(self.one), 0).astype(np.int32)
        row = np.repeat(np.arange(len(self.ids)), count)
        # by tree, size and bitmap: alike records come to lie in one node
        order = np.argsort(tree.astype(np.uint64) << np.uint64(32) | self.size[row].astype(np.uint64) << np.uint64(20) | self.one[row] >> np.uint64(44))
        self.key, self.row = tree[order], row[order].astype(np.int32)
        self._keep(lambda n: n > 1)  # a run that one record holds has no tree

    def _keep(self, good) -> None:
        n = np.diff(np.append(np.flatnonzero(_first(self.key)), len(self.key)))
        ok = np.repeat(good(n), n)
        self.key, self.row = self.key[ok], self.row[ok]

    def split_off(self, cap: int) -> Iterator[bytes]:
        """Takes out the trees of more than ``cap`` records, as parts for pairs of their blocks."""
        edge = np.append(np.flatnonzero(_first(self.key)), len(self.key))
        for lo, hi in zip(edge, edge[1:], strict=False):
            if hi - lo > cap:
                blocks = -(-2 * (hi - lo) // cap)
                rows = np.unique(self.row[lo:hi])
                rows = rows[np.argsort(self.ids[rows], kind="stable")]
                own = np.arange(len(rows)) % blocks
                for i in range(blocks):
                    for j in range(i + 1, blocks):
                        r = rows[(own == i) | (own == j)]
                        wide = np.zeros((len(r), WORDS), np.uint64)
                        for k, bits in ((1, self.one[:, None]), (2, self.two), (WORDS, self.four)):  # _pack folds to the width sent
                            at = self.width[r] == k
                            wide[at, :k] = bits[r[at]]
                        yield _pack(self.ids[r], self.size[r], self.few[r], wide, np.ones(len(r), np.int64), np.full(len(r), self.key[lo]))
        self._keep(lambda n: n <= cap)

    def levels(self) -> list[dict]:
        """The trees, level by level: level 0 are the records, ordered by size within each tree."""
        start = np.flatnonzero(_first(self.key))
        edge = np.append(start, len(self.key))
        # in a tree of pieces only pairs with a text over few letters count
        live = self.few[self.row] | (self.key < EXACT)
        level = {"or": self.one[self.row], "lo": self.size[self.row], "hi": self.size[self.row], "slack": self.slack[self.row], "live": live, "edge": edge, "child": None}
        out = [level]
        while (n := np.diff(level["edge"])).size and n.max() > 1:
            nodes = -(-n // FAN)
            edge = np.concatenate([[0], np.cumsum(nodes)])
            tree = np.repeat(np.arange(len(n)), nodes)
            first = level["edge"][:-1][tree] + FAN * (np.arange(edge[-1]) - edge[:-1][tree])
            child = np.append(first, level["edge"][-1])
            ends = {"or": np.bitwise_or, "lo": np.minimum, "hi": np.maximum, "slack": np.maximum, "live": np.logical_or}
            level = {**{k: f.reduceat(level[k], first) for k, f in ends.items()}, "edge": edge, "child": child}
            out.append(level)
        return out

    def pairs(self, t: float) -> np.ndarray:
        """Pairs of record numbers (as one number) that no bound excludes."""
        levels, found, need = self.levels(), [], t / (1 + t)
        if not len(self.key):
            return np.zeros(0, np.int64)
        top = np.arange(len(levels[-1]["edge"]) - 1)
        stack = [(len(levels) - 1, top, top)]
        kept = 0
        while stack:
            depth, x, y = stack.pop()
            if depth == 0:
                found.append(self.leaves(self.row[x], self.row[y], need))
                kept += len(found[-1])
                if kept > 8 * FRONTIER:
                    found, kept = [np.unique(np.concatenate(found))], 0
                continue
            up, down = levels[depth], levels[depth - 1]
            wide = np.diff(up["child"])
            nx, ny = wide[x], wide[y]
            n = nx * ny
            total = int(n.sum())
            if total > FRONTIER and len(x) > 1:
                half = len(x) // 2
                stack += [(depth, x[:half], y[:half]), (depth, x[half:], y[half:])]
                continue
            k = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            by = np.repeat(ny, n)
            cx = np.repeat(up["child"][x], n) + k // by
            cy = np.repeat(up["child"][y], n) + k % by
            # records are ordered by size within a tree: cy's are the larger ones
            low, high = down["lo"][cx], down["lo"][cy]
            ok = (cx < cy if depth == 1 else cx <= cy) & (down["hi"][cx] >= t * high - 1e-6) & (down["live"][cx] | down["live"][cy])
            cx, cy, low, high = cx[ok], cy[ok], low[ok], high[ok]
            shared = np.bitwise_count(down["or"][cx] & down["or"][cy]) + np.minimum(down["slack"][cx], down["slack"][cy])
            ok = shared >= need * (low + high) - 1e-6
            cx, cy = cx[ok], cy[ok]
            if len(cx):
                stack.append((depth - 1, cx, cy))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def leaves(self, x: np.ndarray, y: np.ndarray, need: float) -> np.ndarray:
        """Records that may reach the threshold: at most |a| less the bits of a that b lacks can be shared."""

        def test(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            sx, sy = self.size[x], self.size[y]
            lost = lambda p, q: np.bitwise_count(p & ~q) if p.ndim == 1 else np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int32)
            return np.minimum(sx - lost(a, b), sy - lost(b, a)) >= need * (sx + sy) - 1e-6

        ok = x != y
        x, y = x[ok], y[ok]
        ok = test(x, y, self.one[x], self.one[y])
        x, y = x[ok], y[ok]
        least = np.minimum(self.width[x], self.width[y])
        for words, bits in ((2, self.two), (WORDS, self.four)):
            at = np.flatnonzero(least >= words)
            if len(at):
                u, v = x[at], y[at]
                good = test(u, v, bits[u], bits[v])
                ok = np.ones(len(x), bool)
                ok[at[~good]] = False
                x, y, least = x[ok], y[ok], least[ok]
        return np.minimum(x, y).astype(np.int64) << 32 | np.maximum(x, y)


def _join(t: float, cap: int | None):
    def run(table: pa.Table) -> pa.Table:
        part = _Part(table.column("blob").to_pylist())
        rest = list(part.split_off(cap)) if cap else []
        found = part.pairs(t)
        a, b = part.ids[found >> 32], part.ids[found & 0xFFFFFFFF]
        ok = a != b
        a, b = a[ok], b[ok]
        none = [None] * len(rest)
        # a part's number and the number of the pair of blocks name the part of a second round
        p = int(table["p"][0].as_py()) << 32
        return pa.table({
            "id_a": pa.array([*np.minimum(a, b).tolist(), *none], pa.int64()), "id_b": pa.array([*np.maximum(a, b).tolist(), *none], pa.int64()),
            "p": pa.array([None] * len(a) + [p + i for i in range(len(rest))], pa.int64()), "blob": pa.array([None] * len(a) + rest, pa.binary()),
        })

    return run


def memberships(df: DataFrame, id_col: str = "sent_id", text_col: str = "text", low: int = LOW, high: int = HIGH) -> DataFrame:
    """(rid, id): the rows that each representative, the smallest id of equal core and card key, stands for, itself included.

    Only hashes are moved; a set of copies that holds a third of all rows is split by the skew join.
    """
    rows = core_rows(df, id_col, text_col, low, high, with_text=False).select("id", "h1", "h2")
    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("rid"))
    return rows.join(first, ["h1", "h2"]).select("rid", "id")


def representatives(df: DataFrame, members: DataFrame, id_col: str = "sent_id", text_col: str = "text", low: int = LOW, high: int = HIGH) -> DataFrame:
    """(rid, k, c): card key and core of each representative, in buckets of rid. Texts are moved once, to where the joins on rid need them."""
    n = partitions(df.sparkSession)
    rows = core_rows(df, id_col, text_col, low, high).select(F.col("id").alias("rid"), "k", "c").repartition(n, "rid")
    chosen = members.filter("id = rid").select("rid").distinct()
    # a row delivered again is the same row
    return rows.join(chosen, "rid", "left_semi").groupBy("rid").agg(F.min("k").alias("k"), F.min("c").alias("c"))


def candidates(reps: DataFrame, t: float, per_part: int = PART, cap: int = TREE_CAP) -> DataFrame:
    """Distinct pairs of representatives that the signature trees can't exclude.

    The number of parts is in proportion to the number of tree entries. A tree that turns out larger than ``cap`` is sent on
    in pairs of blocks and traversed in a second round, by as many tasks as it has pairs.
    """
    counts = Counts.of(reps, t)
    parts = max(1, int(np.ceil(counts.runs * _broken(t) / per_part)))
    schema = "id_a bigint, id_b bigint, p bigint, blob binary"
    routed = reps.select("rid", "c").mapInArrow(_route(t, parts, counts), "p bigint, blob binary")
    found = cut(routed.groupBy("p").applyInArrow(_join(t, cap), schema), "near-candidates")
    rest = found.filter("blob IS NOT NULL").select("p", "blob").groupBy("p").applyInArrow(_join(t, None), schema)
    return found.filter("blob IS NULL").unionByName(rest).select("id_a", "id_b").distinct()


def representative_pairs(reps: DataFrame, tenths: int) -> DataFrame:
    """(id_a, id_b, shared, all_pieces): pairs of representatives with 10 * shared >= tenths * union and another card key."""
    cand = candidates(reps, tenths / 10)
    a = reps.select(F.col("rid").alias("id_a"), F.col("c").alias("c_a"), F.col("k").alias("k_a"))
    b = reps.select(F.col("rid").alias("id_b"), F.col("c").alias("c_b"), F.col("k").alias("k_b"))
    both = cand.join(a, "id_a").join(b, "id_b").filter("k_a = 0 OR k_b = 0 OR k_a <> k_b")
    return both.select("id_a", "id_b", "c_a", "c_b").mapInArrow(cores.verify(tenths), "id_a bigint, id_b bigint, shared int, all_pieces int")


def near_duplicate_pairs(df: DataFrame, id_col: str = "sent_id", text_col: str = "text", tenths: int = 6, expand: bool = True) -> DataFrame:
    """Pairs (id_a < id_b) of rows whose sets of 3-character pieces have similarity of at least ``tenths`` / 10.

    Null texts and ids, and texts with a core of under 12 or over 300 characters, take no part; rows delivered twice count
    once; rows equal in core and card key are no pair. With ``expand`` false the pairs are those of representatives (the
    smallest id of each set of equal rows), and ``memberships`` says which rows each stands for. An empty table gives none.
    Other columns are ignored.
    """
    members, pairs = _found(df, id_col, text_col, tenths)
    if not expand:
        return pairs
    a = members.select(F.col("rid").alias("ra"), F.col("id").alias("x"))
    b = members.select(F.col("rid").alias("rb"), F.col("id").alias("y"))
    wide = pairs.join(a, pairs.id_a == a.ra).join(b, F.col("id_b") == b.rb).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return wide.distinct()


def _found(df: DataFrame, id_col: str, text_col: str, tenths: int) -> tuple[DataFrame, DataFrame]:
    members = cut(memberships(df, id_col, text_col), "near-members")
    reps = cut(representatives(df, members, id_col, text_col), "near-reps", by="rid")
    return members, cut(representative_pairs(reps, tenths), "near-pairs")


def version_groups(df: DataFrame, id_col: str = "sent_id", text_col: str = "text", tenths: int = 6) -> DataFrame:
    """(id, group, links): every id once, with the smallest id of its group and the number of other texts it is a version of.

    Equal rows share a group and count as one text. Rows that take no part in the join, null texts among them, are groups of their own.
    """
    from quillmill.llm.groups import components

    members, pairs = _found(df, id_col, text_col, tenths)
    ends = pairs.select(F.col("id_a").alias("rid")).unionByName(pairs.select(F.col("id_b").alias("rid"))).groupBy("rid").agg(F.count("*").alias("links"))
    named = components(pairs).withColumnRenamed("id", "rid")
    members = members.groupBy("id").agg(F.min("rid").alias("rid"))
    every = df.select(F.col(id_col).cast("bigint").alias("id")).filter("id IS NOT NULL").distinct()
    wide = every.join(members, "id", "left").join(named, "rid", "left").join(ends, "rid", "left")
    return wide.select("id", F.coalesce("group", "rid", "id").alias("group"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
