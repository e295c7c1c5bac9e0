"""Problem 5: one consistent form for texts that look the same but are stored with other characters.

Each text becomes positioned code points. These meet two tables, one of decompositions (composed accents, widths,
compatibility ideographs, kinds of blank, invisible characters) and one of look-alike letters; combining marks are put in the
order of their classes; what can be composed is composed; the strings are built again. The tables are fixed by
Unicode (about 8 MB, whatever the data): they are built once, broadcast, and joined as an index into arrays.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import codepoints as cp
from quillmill.session import cut

# Letters of the Cyrillic, Greek, Armenian, Cherokee, Coptic and Lisu scripts, and the Latin letters of the same shape, as
# Unicode's public table of confusable characters (UTS 39) has them.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Һ": "H",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "У": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "Ϳ": "J",
    "α": "a", "ι": "i", "ρ": "p", "υ": "u",
    "օ": "o", "ս": "u", "հ": "h", "ց": "g", "Օ": "O", "Տ": "S",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
RANGES = ((0x20, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x34000), (0xE0000, 0xE0200))
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), *range(0x180B, 0x1810)}
VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


def _form(i: int) -> str:
    """The decomposed form of one code point."""
    ch = chr(i)
    kind = unicodedata.category(ch)
    if kind == "Zs":
        return " "
    if i in INVISIBLE or kind == "Cf" and i not in VISIBLE_FORMAT:
        return ""
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    parts = unicodedata.decomposition(ch).split()
    if not parts:
        return ch
    if parts[0] in ("<wide>", "<narrow>") or parts[0] == "<compat>" and len(parts) == 2 and _han(int(parts[1], 16)):
        parts = parts[1:]
    elif parts[0].startswith("<"):
        return ch
    return "".join(_form(int(p, 16)) for p in parts)


def _han(i: int) -> bool:
    return 0x3400 <= i < 0xA000 or 0x20000 <= i < 0x34000


@cache
def tables() -> dict:
    size, start = np.ones(cp.LIMIT, np.uint8), np.full(cp.LIMIT, -1, np.int32)
    order = np.zeros(cp.LIMIT, np.uint8)
    flat: list[int] = []
    pairs: dict[int, int] = {}
    for lo, hi in RANGES:
        for i in range(lo, hi):
            ch = chr(i)
            order[i] = unicodedata.combining(ch)
            form = _form(i)
            if form != ch:
                size[i], start[i] = len(form), len(flat)
                flat += map(ord, form)
            two = unicodedata.decomposition(ch).split()
            if len(two) == 2 and two[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                pairs[int(two[0], 16) << 21 | int(two[1], 16)] = i
    touched = (start >= 0) | (order > 0)
    touched[0xAC00:0xD7A4] = touched[0x1100:0x1200] = True
    keys = np.array(sorted(pairs), np.int64)
    return {"size": size, "start": start, "flat": np.array(flat, np.uint32), "order": order, "touched": touched, "pair": keys, "whole": np.array([pairs[k] for k in keys.tolist()], np.uint32)}


def _expand(codes: np.ndarray, offs: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    hangul = (codes >= 0xAC00) & (codes < 0xD7A4)
    n = t["size"][codes].astype(np.int64)
    if hangul.any():
        n[hangul] = np.where((codes[hangul] - 0xAC00) % 28 > 0, 3, 2)
    ends = np.concatenate([[0], np.cumsum(n)])
    out = np.repeat(codes, n)
    within = np.arange(len(out)) - np.repeat(ends[:-1], n)
    start = np.repeat(t["start"][codes], n)
    has = start >= 0
    out[has] = t["flat"][start[has] + within[has]]
    if hangul.any():
        h = np.repeat(hangul, n)
        s = (out[h] - 0xAC00).astype(np.int64)
        out[h] = np.choose(within[h], [0x1100 + s // 588, 0x1161 + s % 588 // 28, 0x11A7 + s % 28]).astype(np.uint32)
    return out, ends[offs]


def _compose(codes: np.ndarray, offs: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Composes each starter with what follows it, one follower a round, over all rows at once."""
    cls = t["order"][codes]
    first = np.zeros(len(codes), bool)
    first[offs[:-1][np.diff(offs) > 0]] = True
    starter = (cls == 0) | first
    run = np.cumsum(starter) - 1
    head = np.flatnonzero(starter)
    place = np.arange(len(codes)) - head[run]
    codes, dead = codes.copy(), np.zeros(len(codes), bool)
    last = np.zeros(len(head), np.uint8)  # class of the last mark that stayed
    for r in range(1, int(place.max(initial=0)) + 1):
        at = np.flatnonzero(place == r)
        group = run[at]
        found, ok = _lookup(codes[head[group]], codes[at], t)
        ok &= (last[group] < cls[at]) & (cls[head[group]] == 0)
        codes[head[group[ok]]], dead[at[ok]] = found[ok], True
        last[group[~ok]] = cls[at[~ok]]
    # starters that follow a starter at once: Hangul vowels and finals, and the few other pairs
    for _ in range(2):
        live = np.flatnonzero(~dead)
        if len(live) < 2:
            break
        a, b = codes[live[:-1]], codes[live[1:]]
        found, ok = _lookup(a, b, t)
        lv = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
        found = np.where(lv, 0xAC00 + ((a.astype(np.int64) - 0x1100) * 21 + b - 0x1161) * 28, found).astype(np.uint32)
        lvt = (a >= 0xAC00) & (a < 0xD7A4) & ((a.astype(np.int64) - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
        found = np.where(lvt, a + b - 0x11A7, found).astype(np.uint32)
        ok = (ok & (t["order"][b] == 0) | lv | lvt) & ~first[live[1:]]
        ok[1:] &= ~ok[:-1]
        if not ok.any():
            break
        codes[live[:-1][ok]], dead[live[1:][ok]] = found[ok], True
    ends = np.concatenate([[0], np.cumsum(~dead)])
    return codes[~dead], ends[offs]


def _lookup(a: np.ndarray, b: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    key = a.astype(np.int64) << 21 | b
    at = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
    return t["whole"][at], t["pair"][at] == key


def canonical(codes: np.ndarray, offs: np.ndarray, t: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of each row."""
    t = t or tables()
    touched = cp.row_sums(t["touched"][codes].astype(np.uint64), offs) > 0
    if not touched.any():
        return codes, offs
    c, o = cp.select_rows(codes, offs, touched)
    c, o = _expand(c, o, t)
    cls = t["order"][c]
    if len(c) > 1 and ((cls[1:] > 0) & (cls[:-1] > cls[1:])).any():
        first = np.zeros(len(c), bool)
        first[o[:-1][np.diff(o) > 0]] = True
        c = c[np.lexsort((cls, np.cumsum((cls == 0) | first)))]
    c, o = _compose(c, o, t)
    if touched.all():
        return c, o
    n = np.diff(offs)
    n[touched] = np.diff(o)
    out, new = np.empty(n.sum(), np.uint32), np.concatenate([[0], np.cumsum(n)])
    which = np.repeat(touched, n)
    out[which], out[~which] = c, cp.select_rows(codes, offs, ~touched)[0]
    return out, new


def _forms(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cp.slices(batches, "text"):
            c, o = canonical(*cp.flatten(batch["text"]), sent.value)
            yield pa.RecordBatch.from_arrays([batch["tbl"], batch["id"], cp.unflatten(c, o, ~np.asarray(batch["text"].is_null()))], names=["tbl", "id", "form"])

    return run


def _hashes(least: int, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cp.slices(batches, "text"):
            codes, offs = cp.flatten(batch["text"])
            keep, _ = cp.core_tables()
            n = cp.row_sums(keep[codes].astype(np.uint64), offs)
            ok = (n >= least) & ~np.asarray(batch["text"].is_null()) & ~np.asarray(batch["id"].is_null())
            codes, offs = cp.select_rows(codes, offs, ok)
            form = canonical(codes, offs, sent.value)
            mask = pa.array(ok)
            cols = [cp.as_int64(x) for x in (cp.row_hash(*form, 1), cp.row_hash(*form, 2), cp.row_hash(codes, offs, 3))]
            yield pa.RecordBatch.from_arrays([batch["tbl"].filter(mask), batch["id"].filter(mask), *map(pa.array, cols)], names=["tbl", "id", "f1", "f2", "stored"])

    return run


def source(df: DataFrame, tbl: str, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.lit(tbl).alias("tbl"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))


def _sent(df: DataFrame):
    return df.sparkSession.sparkContext.broadcast(tables())


def canonical_texts(rows: DataFrame) -> DataFrame:
    """(tbl, id, form): every text of (tbl, id, text) in the one form; null stays null, empty stays empty, each row gives a row."""
    return rows.mapInArrow(_forms(_sent(rows)), "tbl string, id bigint, form string")


def _classes(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(tbl, id, f1, f2, stored) of all rows, and the forms that stand in several variants, with the smallest id."""
    sent = _sent(rows)
    hashed = cut(rows.mapInArrow(_hashes(least, sent), "tbl string, id bigint, f1 bigint, f2 bigint, stored bigint").distinct(), "one-form")
    sent.destroy()
    mixed = hashed.groupBy("tbl", "f1", "f2").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi"), F.min("id").alias("group")).filter("lo <> hi").select("tbl", "f1", "f2", "group")
    return hashed, mixed


def look_alike_pairs(rows: DataFrame, least: int = 12) -> DataFrame:
    """(tbl, id_a, id_b): rows of one table whose texts differ as stored and are equal in the one form.

    Texts with fewer than ``least`` letters, marks and digits, nulls and null ids take no part; a row delivered twice counts
    once. Only forms that stand in several variants reach the join.
    """
    hashed, mixed = _classes(rows, least)
    a = hashed.join(mixed.drop("group"), ["tbl", "f1", "f2"])
    b = a.select("tbl", "f1", "f2", F.col("id").alias("other"), F.col("stored").alias("as_stored"))
    both = a.join(b, ["tbl", "f1", "f2"]).filter("stored <> as_stored AND id < other")
    return both.select("tbl", F.col("id").alias("id_a"), F.col("other").alias("id_b")).distinct()


def look_alike_groups(rows: DataFrame, least: int = 12) -> DataFrame:
    """(tbl, id, group): the same as membership, one row per row of a form that stands in several variants, with the smallest id of the form."""
    hashed, mixed = _classes(rows, least)
    return hashed.join(mixed, ["tbl", "f1", "f2"]).select("tbl", "id", "group").distinct()
