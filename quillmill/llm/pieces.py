"""Problem 6: cutting long texts into pieces under a limit, at natural boundaries, each repeating the end of the last.

A text, or a file too large to load, is read in byte ranges with halos. Every range finds the boundaries it sees and, near
either edge, the anchor at which the ranges meet; both neighbours see the same characters there and so agree without a
word. Between its anchors a range cuts its pieces alone, and gives them by offset. Piece numbers come from prefix sums over the
ranges. The ranges of a file are read by different tasks; those of a text of a table, which lies in memory anyway, one after
another where it lies.

Bytes that aren't UTF-8 are a character each, shown as U+FFFD in the piece; offsets count them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions import codepoints as cp
from quillmill.session import cut

# Marks after which a text may be cut, the strongest first.
SENTENCE_MARKS = "。！？；!?.;\n\r"
CLAUSE_MARKS = "，、：,:｜|—…"
CLOSERS = "」』》”’）)]\"'"
RANGE = 65_536


def _ranks() -> np.ndarray:
    rank = np.zeros(cp.LIMIT, np.int8)
    for ch in (" ", "\t", "　", "\xa0", " ", " "):
        rank[ord(ch)] = 1
    for n, marks in ((2, CLAUSE_MARKS), (3, SENTENCE_MARKS)):
        for ch in marks:
            rank[ord(ch)] = n
    return rank


_RANKS = _ranks()
_CLOSE = np.array([ord(c) for c in CLOSERS], np.uint32)


def boundaries(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (before which a cut may be made) and their ranks. Closing marks stay with what they close; of a run only the end counts; a stop within a number or word is none."""
    rank = _RANKS[codes]
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    keep, _ = cp.core_tables()
    letter = keep[codes]
    inner = np.zeros(n, bool)
    inner[1:-1] = np.isin(codes[1:-1], np.array([0x2E, 0x2C, 0x3A], np.uint32)) & letter[:-2] & letter[2:]
    rank = np.where(inner, 0, rank)
    closing = np.isin(codes, _CLOSE)
    for i in np.flatnonzero(closing[1:] & (rank[:-1] > 1)) + 1:
        rank[i] = rank[i - 1]
    last = np.append((rank[:-1] > 0) & ((rank[1:] == 0) | (rank[1:] < rank[:-1]) & (rank[1:] != 1)), rank[-1] > 0)
    # blanks after a mark go with the mark
    run = np.concatenate([[True], (rank[1:] == 0) | (rank[:-1] == 0)]).cumsum()
    best = np.zeros(run[-1] + 1, np.int8)
    np.maximum.at(best, run, rank)
    at = np.flatnonzero(last)
    return at + 1, best[run[at]]


def _best(at: np.ndarray, rank: np.ndarray, low: int, high: int) -> int:
    """The cut in (low, high]: the last of the strongest in the second half, else the last at all, else ``high``."""
    i, j = np.searchsorted(at, [low, high], "right")
    if i == j:
        return high
    half = np.searchsorted(at, (low + high) // 2, "right")
    if half >= j:
        return int(at[j - 1])
    k = max(i, half)
    r = rank[k:j]
    return int(at[j - 1 - np.argmax(r[::-1])])


def cut_points(codes: np.ndarray, low: int, high: int, first: bool, last: bool, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of the range whose nominal edges are ``low`` and ``high`` within the characters ``codes``."""
    at, rank = boundaries(codes)
    step = limit - overlap
    begin = low if first else _best(at, rank, max(0, low - step), low)
    end = high if last else _best(at, rank, max(0, high - step), high)
    out, done = [], begin
    start = begin if first else begin - overlap
    while done < end:
        most = start + limit
        to = end if end <= most else _best(at, rank, max(done, start + overlap), most)
        out.append((start, to))
        done, start = to, to - overlap
    return out


def _decoded(raw: bytes, inner: bool) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a window, and the offset of each and of the end; a window that begins within a file leaves out the rest of a character cut there."""
    skip = 0
    while inner and skip < min(3, len(raw)) and raw[skip] & 0xC0 == 0x80:
        skip += 1
    codes = np.frombuffer(raw[skip:].decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    bad = (codes >= 0xDC80) & (codes < 0xDD00)
    wide = np.where(bad, 1, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
    return np.where(bad, 0xFFFD, codes).astype(np.uint32), np.concatenate([[0], np.cumsum(wide)]) + skip


def range_pieces(read, n: int, lo: int, hi: int, limit: int, overlap: int) -> tuple[list[int], list[int], list[str]]:
    """Byte offsets and text of the pieces of the range ``lo`` to ``hi`` of ``n`` bytes; ``read(a, b)`` gives bytes."""
    halo = 4 * limit + 8
    frm, to = max(0, lo - halo), min(n, hi + halo)
    codes, place = _decoded(read(frm, to), frm > 0)
    place = place + frm
    edge = lambda x: int(np.searchsorted(place, x, "right") - 1) if x < n else len(codes)
    got = cut_points(codes, edge(lo) if lo else 0, edge(hi), lo == 0, hi == n, limit, overlap)
    text = codes.tobytes().decode("utf-32-le")
    return [int(place[a]) for a, _ in got], [int(place[b]) for _, b in got], [text[a:b] for a, b in got]


def _text_pieces(limit: int, overlap: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cp.slices(batches, "text"):
            out: list[tuple] = []
            for ident, value in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                raw = memoryview(value.as_buffer())
                done = at = no = 0  # characters before byte ``at``
                for lo in range(0, len(raw), size):
                    parts = zip(*range_pieces(lambda a, b, raw=raw: bytes(raw[a:b]), len(raw), lo, min(len(raw), lo + size), limit, overlap), strict=True)
                    for a, _, piece in parts:
                        lead = np.frombuffer(raw[min(a, at) : max(a, at)], np.uint8)
                        done += int(np.count_nonzero(lead & 0xC0 != 0x80)) * (1 if a >= at else -1)
                        at, no = a, no + 1
                        out.append((ident, no, done, done + len(piece), piece))
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4])], names=["id", "piece_no", "start", "stop", "piece"])

    return run


def _checked(limit: int, overlap: int, size: int) -> None:
    if not 0 <= overlap < limit // 2 or size < 16 * limit:
        raise ValueError("overlap must be under half the limit and a range hold several pieces")


def split_texts(df: DataFrame, id_col: str = "sent_id", text_col: str = "text", limit: int = 300, overlap: int = 30, size: int = RANGE) -> DataFrame:
    """(id, piece_no, start, stop, piece) of each text of more than ``limit`` characters; piece_no counts from 1, start and stop are offsets in characters.

    Every piece has at most ``limit`` characters and all but the first begin with the last ``overlap`` characters of the one
    before. Null texts and ids and shorter texts give nothing; a row delivered twice counts once; other columns are ignored.
    """
    _checked(limit, overlap, size)
    long = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > limit).filter("id IS NOT NULL")
    return long.dropDuplicates(["id"]).mapInArrow(_text_pieces(limit, overlap, size), "id bigint, piece_no bigint, start bigint, stop bigint, piece string")


def _numbered(found: DataFrame, by: list[str], step: int = 1 << 20) -> DataFrame:
    """Adds piece_no: prefix sums over the counts of blocks of offsets, then the rank within a block."""
    found = cut(found.withColumn("block", F.floor(F.col("start") / step)), "pieces")
    counts = found.groupBy(*by, "block").agg(F.count("*").alias("m"))
    before = counts.withColumn("before", F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    rank = F.row_number().over(Window.partitionBy(*by, "block").orderBy("start"))
    return found.join(before, [*by, "block"]).select(*by, (F.col("before") + rank).alias("piece_no"), "start", "stop", "piece")


def _file_pieces(limit: int, overlap: int):
    import pyarrow.fs as fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(row["path"])
                with system.open_input_file(path) as f:
                    start, stop, piece = range_pieces(lambda a, b, f=f: f.read_at(b - a, a), row["n"], row["low"], row["high"], limit, overlap)
                if start:
                    yield pa.RecordBatch.from_pydict({"path": [row["path"]] * len(start), "start": start, "stop": stop, "piece": piece})

    return run


def split_files(spark: SparkSession, path: str | list[str], limit: int = 300, overlap: int = 30, size: int = 8 << 20, suffix: str = "*") -> DataFrame:
    """(path, piece_no, start, stop, piece) of UTF-8 files and of those in folders, read in byte ranges with halos; start and stop are byte offsets.

    No file is loaded whole, and the list of files and ranges stays a table. An empty file gives no pieces.
    """
    _checked(limit, overlap, size)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path).select("path", F.col("length").alias("n")).filter("n > 0")
    low = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(size).cast("bigint"))).alias("low")
    ranges = files.select("path", "n", low).withColumn("high", F.least(F.col("n"), F.col("low") + size)).repartition("path", "low")
    return _numbered(ranges.mapInArrow(_file_pieces(limit, overlap), "path string, start bigint, stop bigint, piece string"), ["path"])


def own_part(piece_no: str = "piece_no", piece: str = "piece", overlap: int = 30) -> Column:
    """What a piece adds to the one before."""
    return F.when(F.col(piece_no) == 1, F.col(piece)).otherwise(F.substring(piece, overlap + 1, 1 << 30))
