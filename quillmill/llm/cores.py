"""Shared by the operators on texts: the core C(t), the card key K(t), and the exact check of pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillmill.functions import codepoints as cp

BARS = "|｜"  # fixed value: the marks that part the fields of a card


def card_keys(texts: list[str]) -> list[int]:
    """A 64-bit number of the sorted cores of the fields of each card, all fields of a batch at once."""
    fields = [t.replace(BARS[1], BARS[0]).split(BARS[0]) for t in texts]
    cores = iter(cp.unflatten(*cp.core(*cp.flatten(pa.array([x for f in fields for x in f], pa.string())))).to_pylist())
    parts = (sorted(x for x in (next(cores) for _ in f) if x) for f in fields)
    return [int.from_bytes(hashlib.blake2b("\x1f".join(p).encode(), digest_size=8).digest(), "little", signed=True) or 1 for p in parts]


def cards(texts: pa.Array) -> np.ndarray:
    """The card key of each row; 0 where the text holds no bar, whose key is C(t) itself."""
    out = np.zeros(len(texts), np.int64)
    at = np.flatnonzero(pc.match_substring_regex(texts.fill_null(""), "[|｜]").to_numpy(zero_copy_only=False))
    if len(at):
        out[at] = card_keys(texts.take(pa.array(at)).to_pylist())
    return out


def verify(threshold_tenths: int, a: str = "c_a", b: str = "c_b", keep: tuple[str, ...] = ("id_a", "id_b"), size: int = 20_000):
    """A mapInArrow function that keeps the pairs with 10 * shared >= threshold_tenths * union and adds both counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                inter, union = cp.shared_trigrams(cp.flatten(batch[a]), cp.flatten(batch[b]))
                ok = 10 * inter >= threshold_tenths * union
                if ok.any():
                    mask = pa.array(ok)
                    cols = [batch[k].filter(mask) for k in keep]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(inter[ok].astype(np.int32)), pa.array(union[ok].astype(np.int32))], names=[*keep, "shared", "all_pieces"])

    return run
