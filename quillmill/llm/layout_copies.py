"""Problem 4: copies hidden by formatting, found by progressive refinement of a partition.

All rows start in one class. The first refinement takes what is cheap: the length and the letter histogram of the core, both
blind to blanks, case, marks and the order of the fields of a card. Only rows of classes with several members go on to
the costlier key, the core in order, or for a card its sorted fields. Counts are combined before each shuffle, so a class that
holds a third of all rows is no more work than another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import codepoints as cp
from quillmill.llm import cores
from quillmill.session import cut


def _core(batch: pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.RecordBatch]:
    c, o = cp.core(*cp.flatten(batch["text"]))
    ok = (np.diff(o) >= max(1, least)) & ~np.asarray(batch["text"].is_null()) & ~np.asarray(batch["id"].is_null())
    mask = pa.array(ok)
    return *cp.select_rows(c, o, ok), mask, batch.filter(mask)


def _cheap(least: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cp.slices(batches, "text"):
            c, o, _, kept = _core(batch, least)
            hist = cp.row_sums(cp.mix(c.astype(np.uint64) + np.uint64(7)), o)
            cols = [kept["id"], pa.array(np.diff(o).astype(np.int32)), pa.array(cp.as_int64(hist))]
            yield pa.RecordBatch.from_arrays([*cols, kept["text"]][: 3 + with_text], names=["id", "n", "hist", "text"][: 3 + with_text])

    return run


def _costly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in cp.slices(batches, "text"):
        c, o, _, kept = _core(batch, 1)
        k = cores.cards(kept["text"])
        order = [np.where(k != 0, np.int64(s), cp.as_int64(cp.row_hash(c, o, s))) for s in (1, 2)]
        keys = [order[0] ^ k, order[1] ^ cp.as_int64(cp.mix(k.view(np.uint64))), k]
        yield pa.RecordBatch.from_arrays([kept["id"], *map(pa.array, keys)], names=["id", "k1", "k2", "k3"])


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))


def _classes(df: DataFrame, least: int) -> DataFrame:
    cheap = df.mapInArrow(_cheap(least, False), "id bigint, n int, hist bigint")
    return cheap.groupBy("n", "hist").agg(F.min("id").alias("first"), F.max("id").alias("last"))


def refined(df: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """(id, k1, k2, k3, keep): rows of classes with several ids, with the costly key and the smallest id of its class."""
    source = _source(df, id_col, text_col)
    several = _classes(source, least).filter("first < last").select("n", "hist")
    rows = source.mapInArrow(_cheap(least, True), "id bigint, n int, hist bigint, text string")
    suspects = rows.join(several, ["n", "hist"]).select("id", "text")
    keyed = cut(suspects.mapInArrow(_costly, "id bigint, k1 bigint, k2 bigint, k3 bigint").distinct(), "layout-keys")
    first = keyed.groupBy("k1", "k2", "k3").agg(F.min("id").alias("keep"), F.count("*").alias("copies"))
    return keyed.join(first, ["k1", "k2", "k3"])


def layout_copies(df: DataFrame, id_col: str = "sent_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(keep_id, copy_id): for each set of rows of equal content, all but the smallest id, beside the smallest.

    Content is the core of the text; of a text with bars it is the sorted list of the cores of its fields. Rows with null
    text or id, or a core of under ``least`` characters, take no part; a row delivered twice counts once; other columns
    are ignored; an empty table gives no rows.
    """
    both = refined(df, id_col, text_col, least)
    return both.filter("id <> keep").select(F.col("keep").alias("keep_id"), F.col("id").alias("copy_id")).distinct()


def collapsed(df: DataFrame, id_col: str = "sent_id", text_col: str = "text", least: int = 1) -> DataFrame:
    """(keep_id, copies): one row per distinct content, with the number of ids that have it. Texts without a letter, mark or digit have no content."""
    single = _classes(_source(df, id_col, text_col), least).filter("first = last").select(F.col("first").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"))
    several = refined(df, id_col, text_col, least).filter("id = keep").select(F.col("keep").alias("keep_id"), "copies")
    return single.unionByName(several).distinct()
