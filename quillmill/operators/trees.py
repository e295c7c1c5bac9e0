"""Dependency trees and graphs over edge tables ``(keys, dep, head[, rel, score])``; head 0 is the root. A sentence's edges are few, so a sentence is a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.session import cut


def projective(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, projective): false where two arcs of a sentence cross; negative heads are left out."""
    arcs = edges.filter("head >= 0").select(*keys, F.least("dep", "head").alias("lo"), F.greatest("dep", "head").alias("hi"))
    other = arcs.withColumnRenamed("lo", "lo2").withColumnRenamed("hi", "hi2")
    crossed = arcs.join(other, keys).filter("lo < lo2 AND lo2 < hi AND hi < hi2").select(*keys).distinct().withColumn("__x", F.lit(True))
    return edges.select(*keys).distinct().join(crossed, keys, "left").select(*keys, F.col("__x").isNull().alias("projective"))


def _grouped(edges: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    types = dict(edges.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    return edges.groupBy(*keys).applyInPandas(fn, f"{head}, {schema}")


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dep, component): strongly connected components, named by their least token. Edges may give a token several heads."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dep, head = pdf["dep"].to_numpy(np.int64), pdf["head"].to_numpy(np.int64)
        nodes = np.unique(dep)
        ok = head >= 0
        heads: dict[int, list[int]] = {}
        for d, h in zip(dep[ok].tolist(), head[ok].tolist(), strict=True):
            heads.setdefault(d, []).append(h)
        number, low, name, stack = {}, {}, {}, []
        for start in nodes.tolist():  # depth-first, with a stack of its own
            work = [(start, iter(heads.get(start, ())))] if start not in number else []
            if work:
                number[start] = low[start] = len(number)
                stack.append(start)
            while work:
                at, rest = work[-1]
                new = next((h for h in rest if h not in number or h not in name), None)
                if new is None:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[at])
                    if low[at] == number[at]:
                        cut = stack.index(at)
                        least = min(stack[cut:])
                        name |= {x: least for x in stack[cut:]}
                        del stack[cut:]
                elif new in number:
                    low[at] = min(low[at], number[new])
                else:
                    number[new] = low[new] = len(number)
                    stack.append(new)
                    work.append((new, iter(heads.get(new, ()))))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "dep": nodes, "component": [name[x] for x in nodes.tolist()]})

    return _grouped(edges, keys, run, "dep bigint, component bigint")


def is_tree(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tree): whether every token of 1..n, with one head each, leads to the root. The heads of a sentence are one array that is followed in doubled steps; a head below 0 counts as the root."""
    sent = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dep", "head"))).alias("__e"))
    return sent.select(*keys, _all_lead_to_root(F.col("__e")).alias("tree"))


def _all_lead_to_root(e: Column) -> Column:
    heads = F.transform(e, lambda x: F.greatest(x["head"], F.lit(0)).cast("int"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(e) + 1)).cast("int"))
    last = F.aggregate(rounds, heads, lambda h, _: F.transform(h, lambda x: F.when(x > 0, F.get(h, x - 1)).otherwise(0)))
    return F.forall(last, lambda x: x == 0)


def arborescence(score: np.ndarray) -> np.ndarray:
    """Heads of the best spanning tree rooted at 0, for score[dependent, head]."""
    n = len(score)
    score = score.astype(float).copy()
    np.fill_diagonal(score, -np.inf)
    head = np.zeros(n, np.int64)
    if n > 1:
        head[1:] = score[1:].argmax(axis=1)
    cycle = _cycle(head)
    if cycle is None:
        return head
    inside = np.zeros(n, bool)
    inside[cycle] = True
    rest = np.flatnonzero(~inside)  # token 0 is never in a cycle
    small = np.full((len(rest) + 1, len(rest) + 1), -np.inf)
    small[:-1, :-1] = score[np.ix_(rest, rest)]
    total = score[cycle, head[cycle]]
    enter = score[np.ix_(cycle, rest)] - total[:, None]
    leave = score[np.ix_(rest, cycle)]
    small[-1, :-1], small[:-1, -1] = enter.max(axis=0), leave.max(axis=1)
    small[0, -1] = -np.inf
    found = arborescence(small)
    out = head.copy()
    for i, r in enumerate(rest):
        if r:
            out[r] = cycle[leave[i].argmax()] if found[i] == len(rest) else rest[found[i]]
    source = found[-1]
    out[cycle[enter[:, source].argmax()]] = rest[source]
    return out


def _cycle(head: np.ndarray) -> np.ndarray | None:
    color = np.zeros(len(head), np.int64)
    color[0] = -1
    for start in range(1, len(head)):
        at, path = start, []
        while not color[at]:
            color[at] = start
            path.append(at)
            at = int(head[at])
        if color[at] == start:
            return np.array(path[path.index(at) :])
        for p in path:
            color[p] = -1
    return None


def eisner(score: np.ndarray) -> np.ndarray:
    """Heads of the best projective tree rooted at 0, for score[dependent, head]; or of a batch of sentences of one length, for score[sentence, dependent, head]."""
    if score.ndim == 2:
        return eisner(score[None])[0]
    many, n = score.shape[:2]
    open_, closed = np.full((many, n, n, 2), -np.inf), np.full((many, n, n, 2), -np.inf)  # direction 1: the left end is the head
    split_o, split_c = np.zeros((many, n, n), np.int64), np.zeros((many, n, n, 2), np.int64)
    every = np.arange(many)
    for i in range(n):
        closed[:, i, i] = 0
    for width in range(1, n):
        for i in range(n - width):
            j = i + width
            both = closed[:, i, i:j, 1] + closed[:, i + 1 : j + 1, j, 0]
            k = both.argmax(axis=1)
            split_o[:, i, j] = i + k
            open_[:, i, j, 1] = both[every, k] + score[:, j, i]
            if i:
                open_[:, i, j, 0] = both[every, k] + score[:, i, j]
            left = closed[:, i, i:j, 0] + open_[:, i:j, j, 0]
            right = open_[:, i, i + 1 : j + 1, 1] + closed[:, i + 1 : j + 1, j, 1]
            for d, side in ((0, left), (1, right)):
                k = side.argmax(axis=1)
                split_c[:, i, j, d] = i + d + k
                closed[:, i, j, d] = side[every, k]
    head = np.zeros((many, n), np.int64)
    for m in range(many):
        work = [(0, n - 1, 1, True)]
        while work:
            i, j, d, done = work.pop()
            if i == j:
                continue
            if done:
                k = int(split_c[m, i, j, d])
                work += [(i, k, 0, True), (k, j, 0, False)] if d == 0 else [(i, k, 1, False), (k, j, 1, True)]
            else:
                head[m, j if d else i] = i if d else j
                k = int(split_o[m, i, j])
                work += [(i, k, 1, True), (k + 1, j, 0, True)]
    return head


def spanning(score: np.ndarray) -> np.ndarray:
    """Heads of the best spanning trees of a batch of sentences of one length; only those whose best heads run in a cycle are mended one by one."""
    many, n = score.shape[:2]
    score = score.astype(float).copy()
    score[:, np.arange(n), np.arange(n)] = -np.inf
    head = np.zeros((many, n), np.int64)
    if n > 1:
        head[:, 1:] = score[:, 1:].argmax(axis=2)
    up = head
    for _ in range(int(n).bit_length()):
        up = np.take_along_axis(up, up, axis=1)
    for m in np.flatnonzero(up.any(axis=1)):
        head[m] = arborescence(score[m])
    return head


def _in_batches(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn(rows, group of each row)`` over whole sentences, as many at a time as come in a batch; only the one that a batch ends in is carried over."""
    types = dict(df.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            k = pdf[keys]
            new = ((k != k.shift()) & ~(k.isna() & k.shift().isna())).any(axis=1).to_numpy().copy()
            if len(new):
                new[0] = True
                last = int(np.flatnonzero(new)[-1])
                rest = pdf.iloc[last:]
                if last:
                    yield fn(pdf.iloc[:last], np.cumsum(new[:last]) - 1)
        if rest is not None and len(rest):
            yield fn(rest, np.zeros(len(rest), np.int64))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, f"{head}, {schema}")


def decode(arcs: DataFrame, keys: list[str], how: str = "mst", cells: int = 4_000_000) -> DataFrame:
    """(keys, dep, head) of the best tree for scored arcs (keys, dep, head, score); absent arcs can't be taken unless nothing else can.

    Sentences of one length are decoded together, as many as have ``cells`` cells of scores.
    """
    best = spanning if how == "mst" else eisner

    def run(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        dep, head, value = pdf["dep"].to_numpy(np.int64), pdf["head"].to_numpy(np.int64), pdf["score"].to_numpy(float)
        size = np.zeros(group[-1] + 1, np.int64)
        np.maximum.at(size, group, np.maximum(dep, head) + 1)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place, out = np.zeros(len(size), np.int64), []
        for n in np.unique(size).tolist():
            alike = np.flatnonzero(size == n)
            step = max(1, cells // (n * n))
            for at in range(0, len(alike), step):
                mine = alike[at : at + step]
                place[:] = -1
                place[mine] = np.arange(len(mine))
                ok = place[group] >= 0
                score = np.full((len(mine), n, n), -1e9)
                score[place[group[ok]], dep[ok], head[ok]] = value[ok]
                found = best(score)[:, 1:]
                rows = pdf[keys].iloc[np.repeat(first[mine], n - 1)].reset_index(drop=True)
                out.append(rows.assign(dep=np.tile(np.arange(1, n), len(mine)), head=found.ravel()))
        return pd.concat(out)

    return _in_batches(arcs, keys, run, "dep bigint, head bigint")


def threshold_arcs(arcs: DataFrame, score: str = "score", least: float = 0.5) -> DataFrame:
    """Arcs whose logistic score passes the threshold; a token may have several heads."""
    return arcs.filter(1 / (1 + F.exp(-F.col(score))) > least)


def parse_graph(c: Column) -> Column:
    """``head:rel|head:rel`` as an array of (head, rel); ``_`` is none."""
    parts = F.filter(F.split(c, r"\|"), lambda x: F.instr(x, ":") > 0)
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("head"), F.regexp_replace(x, "^[^:]*:", "").alias("rel")))


def greedy_spans(df: DataFrame, keys: list[str], flat: bool = True) -> DataFrame:
    """Spans by falling score that don't cross those taken, nor (flat) nest in them. Of (keys, start, stop, tag, score)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "start", "stop"], ascending=[False, True, True], kind="stable")
        taken: list[tuple[int, int]] = []
        keep = []
        for a, b in zip(pdf["start"], pdf["stop"], strict=True):
            bad = any((a <= y and x <= b) if flat else (a < x <= b < y or x < a <= y < b) for x, y in taken)
            keep.append(not bad)
            if not bad:
                taken.append((a, b))
        return pdf[keep]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def viterbi(scores: np.ndarray, moves: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int = 1) -> list[tuple[float, list[int]]]:
    """The n best label paths for scores[token, label] and moves[from, to]."""
    best = [[(float(begin[k] + scores[0, k]), [k])] for k in range(scores.shape[1])]
    for row in scores[1:]:
        best = [sorted(((s + moves[p[-1], k] + row[k], [*p, k]) for cell in best for s, p in cell), key=lambda x: (-x[0], x[1]))[:n] for k in range(len(row))]
    return sorted(((s + float(end[p[-1]]), p) for cell in best for s, p in cell), key=lambda x: (-x[0], x[1]))[:n]


def viterbi_table(scores: DataFrame, moves: DataFrame, keys: list[str], n: int = 1) -> DataFrame:
    """(keys, rank, total, idx, label): the ``n`` best label paths of each sentence of a table (keys, idx, label, score).

    ``moves`` has (before, after, score), with ``<START>`` and ``<STOP>`` for the ends; a move that it lacks can't be made. It holds
    one row per pair of labels and goes to every task. A sentence is a group.
    """
    known = {(r["before"], r["after"]): float(r["score"]) for r in moves.limit(1 << 20).collect()}  # labels squared
    if len(known) >= 1 << 20:
        raise ValueError("more than 2**20 moves")

    labels = sorted({x for k in known for x in k} - {"<START>", "<STOP>"})
    number = {x: i for i, x in enumerate(labels)}
    of = lambda a, b: np.array([[known.get((x, y), -np.inf) for y in b] for x in a])
    move, begin, end = of(labels, labels), of(["<START>"], labels)[0], of(labels, ["<STOP>"])[:, 0]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        idx, row = np.unique(pdf["idx"].to_numpy(np.int64), return_inverse=True)
        col = pdf["label"].map(number).fillna(-1).to_numpy(np.int64)
        cells = np.full((len(idx), len(labels)), -np.inf)
        np.maximum.at(cells, (row[col >= 0], col[col >= 0]), pdf["score"].to_numpy(float)[col >= 0])
        found = [(s, p) for s, p in viterbi(cells, move, begin, end, n) if np.isfinite(s)]
        out = {"rank": np.repeat(np.arange(1, len(found) + 1), len(idx)), "total": np.repeat([round(s, 6) for s, _ in found], len(idx)), "idx": np.tile(idx, len(found)), "label": [labels[k] for _, p in found for k in p]}
        return pd.DataFrame({**{k: np.repeat(pdf[k].iloc[0], len(out["idx"])) for k in keys}, **out})

    return _grouped(scores, keys, run, "rank int, total double, idx int, label string")


def decode_repaired(arcs: DataFrame, keys: list[str], rels: DataFrame | None = None) -> DataFrame:
    """(keys, dep, head[, rel]): the best head of each token, the smaller on a tie; only sentences whose best heads are no tree are decoded for the best tree.

    ``rels`` (keys, dep, head, rel, score) gives the best relation of each arc taken.
    """
    best = arcs.groupBy(*keys, "dep").agg(F.min_by("head", F.struct(-F.col("score"), F.col("head"))).cast("bigint").alias("head")).withColumn("dep", F.col("dep").cast("bigint"))
    sent = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dep", "head"))).alias("__e"))
    found = cut(sent.withColumn("tree", _all_lead_to_root(F.col("__e"))), "heads")  # a row for each sentence: what is kept and what is mended read it
    kept = found.filter("tree").select(*keys, F.inline("__e"))
    mended = decode(arcs.join(found.filter("NOT tree").select(*keys), keys, "left_semi"), keys)
    heads = kept.unionByName(mended)
    if rels is None:
        return heads
    named = rels.groupBy(*keys, F.col("dep").cast("bigint").alias("dep"), F.col("head").cast("bigint").alias("head")).agg(F.min_by("rel", F.struct(-F.col("score"), F.col("rel"))).alias("rel"))
    return heads.join(named, [*keys, "dep", "head"], "left")
