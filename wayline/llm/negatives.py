"""Hard-negative mining by dual-tree search for largest inner products.

Vectors become integers, so that scores are exact. A tree over all candidates, fitted on a bounded sample, gives every
row a cell; the same tree's cells group the anchors. For a group of anchors and a cell, centres and radii bound every
inner product between them, and the pair is dropped, whole, where that interval cannot hold anything that one of its
anchors still wants. The trees have at most CELLS cells, so the bounds of all pairs are computed at once; what remains
is dealt out by cells, large cells in parts. There a task goes on with trees over its own anchors and candidates: a
frontier of node pairs goes from the roots to the leaves, pairs whose interval or labels rule them out are dropped, and
leaf pairs are scored exactly by matrix products, the most promising leaf of each group of anchors first.

Two searches follow one another: an anchor's first positives, the rows of its label with the largest scores, and then,
for each positive, the first rows of other labels whose scores lie between two shares of the positive's score. What an
anchor surely wants is bounded from below by the rows of the sample, which are rows like any others.

Rows with a null id or label, a null vector, or any null or non-finite component take no part, nor does a row whose own
squared length does not fit a long (any score between others does). Vectors of different lengths do not meet. Rows that
repeat another in id, label and vector count once; rows that share only an id are rows of their own, and all anchors.
Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.session import written

#: Rows of the sample, and the numbers in them, at most; cells of candidates and groups of anchors at most.
SAMPLE, VALUES, CELLS, GROUPS = 8192, 1 << 22, 1024, 256
#: Rows of a cell and of a group of anchors that the trees aim at, and the most of them in one task.
CELL, GROUP, PART = 2048, 512, 16384
LEAF, ANCHOR_LEAF = 64, 16
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def integers(rows: DataFrame, scale: int = 256, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(id, label, v, key) of the rows that take part: components are floor(scale * x); key tells rows apart."""
    x = F.col(embedding).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    sized = F.transform(x, lambda c: F.floor(c * scale))
    length = F.aggregate(x, F.lit(0.0), lambda acc, c: acc + F.pow(F.floor(c * scale).cast("double"), F.lit(2.0)))
    fit = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~F.exists(x, bad) & (length < float(1 << 63))
    own = rows.where(fit).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), sized.cast("array<long>").alias("v"))
    return own.distinct().withColumn("key", F.xxhash64("id", "label", "v"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while no partial sum can pass 2^53, else in long integers."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    norm = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max()))
    if norm(a) * norm(b) < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Tree(NamedTuple):
    """Nodes over rows in the order `rows`: [begin, end), children (-1 at leaves), balls, and ranges of labels."""

    rows: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray


def grown(x: np.ndarray, labels: np.ndarray, leaf: int) -> Tree:
    """A tree that parts rows by label first, and along their widest coordinate where labels are the same, down to leaves."""
    order = np.lexsort((np.arange(len(x)), labels))
    begin, end, left, right = [0], [len(x)], [-1], [-1]
    todo = [0]
    while todo:
        k = todo.pop()
        lo, hi = begin[k], end[k]
        if hi - lo <= leaf:
            continue
        own = order[lo:hi]
        if labels[own[0]] != labels[own[-1]]:
            # the boundary of labels that is nearest to the middle
            edges = np.flatnonzero(np.diff(labels[own])) + 1
            cut = lo + int(edges[np.argmin(np.abs(edges - (hi - lo) // 2))])
        else:
            part = x[own]
            along = int(np.argmax(part.max(axis=0) - part.min(axis=0))) if x.shape[1] else 0
            half = (hi - lo) // 2
            if x.shape[1]:
                # half of the way, which keeps what lies close together, or else half of the rows
                on = part[:, along]
                below = int((on < (on.min() + on.max()) / 2).sum())
                half = below if 10 * min(below, hi - lo - below) >= hi - lo else half
                order[lo:hi] = own[np.argpartition(on, half)]
            cut = lo + half
        for b, e, side in ((lo, cut, left), (cut, hi, right)):
            side[k] = len(begin)
            todo.append(len(begin))
            begin.append(b)
            end.append(e)
            left.append(-1)
            right.append(-1)
    at, to = np.array(begin), np.array(end)
    centre = np.stack([x[order[b:e]].mean(axis=0) for b, e in zip(begin, end, strict=True)])
    radius = np.array([np.sqrt(((x[order[b:e]] - c) ** 2).sum(axis=1).max()) for b, e, c in zip(begin, end, centre, strict=True)])
    sides = [np.array([f(labels[order[b:e]]) for b, e in zip(begin, end, strict=True)]) for f in (np.min, np.max)]
    return Tree(order, at, to, np.array(left), np.array(right), centre, radius, *sides)


def interval(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of balls, pair by pair: wide enough for what doubles round."""
    middle = (a * b).sum(axis=1)
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    reach = ra * nb + rb * na + ra * rb
    reach += 1e-9 * (na + ra) * (nb + rb) + 0.5
    return middle - reach, middle + reach


class Wanted(NamedTuple):
    """What anchors want: for each, scores in any of some ranges [low, high], of its label (`same`) or of others."""

    same: bool
    most: int
    low: np.ndarray
    high: np.ndarray


def searched(anchors: np.ndarray, labels: np.ndarray, keys: np.ndarray, x: np.ndarray, own: np.ndarray, ids: np.ndarray, own_keys: np.ndarray, want: Wanted) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, range, candidates, scores): the first `most` candidates of each range, ties by id, among x.

    low and high are (anchors, ranges); a range with low > high wants nothing. No candidate is lost that is among the
    first of its range.
    """
    if not len(anchors) or not len(x):
        return
    ours, theirs = grown(anchors.astype(np.float64), labels, ANCHOR_LEAF), grown(x.astype(np.float64), own, LEAF)
    low, high = want.low.copy(), want.high
    idle = low > high
    floor_, roof = np.where(idle, np.inf, low.astype(np.float64)), np.where(idle, -np.inf, high.astype(np.float64))

    def reach() -> tuple[np.ndarray, np.ndarray]:
        """Of each node of anchors, the least and the largest score that one of them wants."""
        least, most = floor_.min(axis=1, initial=np.inf)[ours.rows], roof.max(axis=1, initial=-np.inf)[ours.rows]
        return np.array([least[b:e].min() for b, e in zip(ours.begin, ours.end, strict=True)]), np.array([most[b:e].max() for b, e in zip(ours.begin, ours.end, strict=True)])

    def alive(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = interval(ours.centre[a], ours.radius[a], theirs.centre[b], theirs.radius[b])
        least, most = reach_now
        fits = (hi >= least[a]) & (lo <= most[a])
        if want.same:
            fits &= (ours.low[a] <= theirs.high[b]) & (theirs.low[b] <= ours.high[a])
        else:
            fits &= ~((ours.low[a] == ours.high[a]) & (theirs.low[b] == theirs.high[b]) & (ours.low[a] == theirs.low[b]))
        return fits, hi

    reach_now = reach()
    a, b, done = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64), []
    while len(a):
        fits, hi = alive(a, b)
        a, b, hi = a[fits], b[fits], hi[fits]
        leaf_a, leaf_b = ours.left[a] < 0, theirs.left[b] < 0
        both = leaf_a & leaf_b
        done.append((a[both], b[both], hi[both]))
        # the larger node is split
        size_a, size_b = ours.end[a] - ours.begin[a], theirs.end[b] - theirs.begin[b]
        split_a = ~both & ~leaf_a & (leaf_b | (size_a * LEAF >= size_b * ANCHOR_LEAF))
        split_b = ~both & ~split_a
        a, b = (
            np.concatenate((ours.left[a[split_a]], ours.right[a[split_a]], a[split_b], a[split_b])),
            np.concatenate((b[split_a], b[split_a], theirs.left[b[split_b]], theirs.right[b[split_b]])),
        )
    a, b, hi = (np.concatenate([d[k] for d in done]) for k in range(3))
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def scored(leaf: int, leaves: np.ndarray) -> None:
        rows = ours.rows[ours.begin[leaf] : ours.end[leaf]]
        cols = np.concatenate([theirs.rows[theirs.begin[k] : theirs.end[k]] for k in leaves])
        score = products(anchors[rows], x[cols])
        fit = (labels[rows][:, None] == own[cols][None]) == want.same
        fit &= keys[rows][:, None] != own_keys[cols][None]
        for i, r in enumerate(rows.tolist()):
            for k in range(low.shape[1]):
                if idle[r, k]:
                    continue
                hit = np.flatnonzero(fit[i] & (score[i] >= low[r, k]) & (score[i] <= high[r, k]))
                if not len(hit):
                    continue
                held = best.setdefault((r, k), [])
                if len(hit) > want.most:
                    cut = np.partition(score[i][hit], len(hit) - want.most)[len(hit) - want.most]
                    hit = hit[score[i][hit] >= cut]
                    hit = hit[np.lexsort((ids[cols[hit]], -score[i][hit]))][: want.most]
                held += zip((-score[i][hit]).tolist(), ids[cols[hit]].tolist(), cols[hit].tolist(), strict=True)
                held.sort()
                del held[want.most :]
                if len(held) == want.most and -held[-1][0] > low[r, k]:
                    low[r, k] = -held[-1][0]  # ties by id may still come
                    floor_[r, k] = float(low[r, k])

    if not len(a):
        return
    order = np.lexsort((-hi, a))
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    ends = np.r_[starts[1:], len(a)]
    for s in starts:  # the most promising leaf of each group first
        scored(int(a[s]), b[s : s + 1])
    reach_now = reach()
    for s, e in zip(starts, ends, strict=True):
        rest = b[s + 1 : e]
        fits, _ = alive(np.full(len(rest), a[s]), rest)
        if fits.any():
            scored(int(a[s]), rest[fits])
    for (r, k), held in best.items():
        yield r, k, np.array([c for _, _, c in held], dtype=np.int64), np.array([-s for s, _, _ in held], dtype=np.int64)


# cells over the cluster


class Cells(NamedTuple):
    """A tree's leaves as centres, for one length of vectors: a row belongs to the nearest."""

    centre: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        c = self.centre
        return np.argmin((c * c).sum(axis=1)[None] - 2 * (x.astype(np.float64) @ c.T), axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array, places: np.ndarray | None = None) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat if places is None else flat.take(pa.array(places))
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(flat), len(values) // max(len(flat), 1))


def _by_length(column: pa.Array) -> Iterator[np.ndarray]:
    sizes = np.array(column.value_lengths().to_pylist(), dtype=np.int64)
    for n in np.unique(sizes):
        yield np.flatnonzero(sizes == n)


def fitted(sample: list[tuple], cells: int) -> dict[int, Cells]:
    """Cells for each length of vectors in a sample of rows (id, label, v, key)."""
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r[2]), []).append(r[2])
    out = {}
    for n, rows in by.items():
        x = np.array(rows, dtype=np.float64).reshape(len(rows), n)
        tree = grown(x, np.zeros(len(x)), max(1, -(-len(x) // cells)))
        out[n] = Cells(tree.centre[tree.left < 0])
    return out


def placed(rows: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """The rows with the length of their vectors and their cell; lengths that the sample lacks have one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            length, cell = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32)
            for places in _by_length(v):
                x = _matrix(v, places)
                length[places] = x.shape[1]
                if x.shape[1] in cells:
                    for at in range(0, len(places), 4096):
                        cell[places[at : at + 4096]] = cells[x.shape[1]].of(x[at : at + 4096])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length), pa.array(cell)], names=[*batch.schema.names, "length", "cell"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, schema + ", length int, cell int")


def _balls(rows: DataFrame, cells: dict[int, Cells]) -> dict[tuple[int, int], tuple[int, float]]:
    """(length, cell) -> rows and radius around the cell's centre; as many as there are cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            length, cell, v = batch.column("length").to_numpy(), batch.column("cell").to_numpy(), batch.column("v")
            for places in _by_length(v):
                x = _matrix(v, places).astype(np.float64)
                n = int(length[places[0]])
                centre = cells[n].centre[cell[places]] if n in cells else np.zeros((len(x), n))
                far = np.sqrt(((x - centre) ** 2).sum(axis=1))
                for k in np.unique(cell[places]).tolist():
                    own = held.setdefault((n, k), [0, 0.0])
                    here = cell[places] == k
                    own[0] += int(here.sum())
                    own[1] = max(own[1], float(far[here].max()))
        yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in held], pa.int32()) for j in (0, 1)] + [pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1] for h in held.values()], pa.float64())], names=["length", "cell", "n", "radius"])

    found = rows.select("length", "cell", "v").mapInArrow(run, "length int, cell int, n long, radius double").groupBy("length", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    return {(r["length"], r["cell"]): (r["n"], r["radius"]) for r in found.collect()}


def _reach(anchors: DataFrame) -> dict[tuple[int, int], tuple[float, float]]:
    """(length, cell) of anchors -> the least and the largest score that one of them wants."""
    fit = F.filter(F.arrays_zip("low", "high"), lambda r: r["low"] <= r["high"])
    wants = anchors.select("length", "cell", F.array_min(F.transform(fit, lambda r: r["low"])).alias("low"), F.array_max(F.transform(fit, lambda r: r["high"])).alias("high"))
    found = wants.groupBy("length", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return {(r["length"], r["cell"]): (r["low"], r["high"]) for r in found.collect() if r["low"] is not None}


def surviving(ours: dict, theirs: dict, wants: dict, groups: dict[int, Cells], cells: dict[int, Cells]) -> list[tuple[int, int, int]]:
    """(length, group, cell) of the node pairs whose interval holds a score that an anchor of the group wants."""
    out = []
    for n in {k[0] for k in ours} & {k[0] for k in theirs}:
        mine, others = sorted(k[1] for k in ours if k[0] == n and k in wants), sorted(k[1] for k in theirs if k[0] == n)
        if not mine:
            continue
        centre = lambda tree, some, n=n: tree[n].centre[some] if n in tree else np.zeros((len(some), n))
        b, rb = centre(cells, others), np.array([theirs[n, k][1] for k in others])
        for g in mine:
            a = np.broadcast_to(centre(groups, [g]), b.shape)
            lo, hi = interval(a, np.full(len(b), ours[n, g][1]), b, rb)
            least, most = wants[n, g]
            out += [(n, g, others[k]) for k in np.flatnonzero((hi >= float(least)) & (lo <= float(most))).tolist()]
    return out


def search(rows: DataFrame, anchors: DataFrame, groups: dict[int, Cells], cells: dict[int, Cells], same: bool, most: int, part: int = PART) -> DataFrame:
    """(key, slot, score, id, rank) for anchors (key, label, v, length, cell, low, high): the candidates that tasks found.

    low and high list the ranges of scores that an anchor wants; slot is the number of the range. A task keeps the first
    `most` of its own candidates in each.
    """
    ours, theirs = _balls(anchors, groups), _balls(rows, cells)
    pairs = surviving(ours, theirs, _reach(anchors), groups, cells)
    spark = rows.sparkSession
    schema = "key long, slot int, score long, id long"
    if not pairs:
        return spark.createDataFrame([], schema + ", rank int")
    parts = lambda n: -(-n // part)
    table = spark.createDataFrame([(n, g, c, parts(ours[n, g][0]), parts(theirs[n, c][0])) for n, g, c in pairs], "length int, group int, cell int, anchor_parts int, parts int")
    if len(pairs) <= GROUPS * CELLS:  # always so, but for vectors of many lengths
        table = F.broadcast(table)

    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    spot = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    task = ["length", "group", "cell", "anchor_part", "part"]
    left = anchors.withColumnRenamed("cell", "group").join(table, ["length", "group"]).withColumns({"anchor_part": spot("anchor_parts")}).withColumn("part", spread("parts"))
    right = rows.join(table, ["length", "cell"]).withColumns({"part": spot("parts")}).withColumn("anchor_part", spread("anchor_parts"))
    left = left.select(*task, "key", "label", "v", "low", "high").groupBy(*task)
    right = right.select(*task, "key", "label", "v", "id").groupBy(*task)

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        whole = lambda t, c: t.column(c).to_numpy()
        out: tuple[list, ...] = ([], [], [], [])
        if len(mine) and len(others):
            low, high = (np.array(mine.column(c).to_pylist(), dtype=np.int64).reshape(len(mine), -1) for c in ("low", "high"))
            keys, ids = whole(mine, "key"), whole(others, "id")
            for r, k, found, scores in searched(_matrix(mine.column("v")), whole(mine, "label"), keys, _matrix(others.column("v")), whole(others, "label"), ids, whole(others, "key"), Wanted(same, most, low, high)):
                for column, values in zip(out, ([int(keys[r])] * len(found), [k] * len(found), scores.tolist(), ids[found].tolist()), strict=True):
                    column += values
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("key", "slot", "score", "id"), out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    found = left.cogroup(right).applyInArrow(run, schema)
    first = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def _seeded(anchors: DataFrame, sample: list[tuple], same: bool, most: int) -> DataFrame:
    """The anchors with each range's low raised to what the sample already holds `most` of."""
    by: dict[int, tuple] = {}
    for n in {len(r[2]) for r in sample}:
        own = [r for r in sample if len(r[2]) == n]
        by[n] = (np.array([r[2] for r in own], dtype=np.int64).reshape(len(own), n), np.array([r[1] for r in own], dtype=np.int64), np.array([r[3] for r in own], dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, labels, keys = batch.column("v"), batch.column("label").to_numpy(), batch.column("key").to_numpy()
            low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            for places in _by_length(v):
                x = _matrix(v, places)
                if x.shape[1] not in by:
                    continue
                some, own, own_keys = by[x.shape[1]]
                for at in range(0, len(places), 256):
                    part = places[at : at + 256]
                    score = products(x[at : at + 256], some)
                    fit = ((labels[part][:, None] == own[None]) == same) & (keys[part][:, None] != own_keys[None])
                    for i, r in enumerate(part.tolist()):
                        fits = score[i][fit[i]]
                        for k, (lo, hi) in enumerate(zip(low[r], high[r], strict=True)):
                            held = fits[(fits >= lo) & (fits <= hi)]
                            if len(held) >= most:
                                low[r][k] = int(np.partition(held, len(held) - most)[len(held) - most])
            yield pa.RecordBatch.from_arrays([*(pa.array(low, pa.list_(pa.int64())) if n == "low" else batch.column(n) for n in batch.schema.names)], names=batch.schema.names)

    return anchors.mapInArrow(run, anchors.schema)


def _share(score: Column, over: int, under: int, up: bool) -> Column:
    """score * over / under, rounded up or down, without overflow for over <= under."""
    rest = F.pmod(score, F.lit(under))
    step = F.floor((rest * over + (under - 1 if up else 0)) / under)
    return F.call_function("div", score - rest, F.lit(under)) * over + step


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: tuple[int, int] = (50, 100), most: tuple[int, int] = (95, 100), sample: int = SAMPLE, cell: int = CELL, group: int = GROUP, part: int = PART) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of integers() rows.

    is_anchor is a condition on id and label. For each of an anchor's first positives, the first negatives whose score n
    satisfies least * p <= n <= most * p (fractions) for the positive's score p; larger scores first, ties by id.
    """
    whole = written(rows, "vectors")
    count, length = whole.agg(F.count("*"), F.avg(F.size("v"))).first()
    sample = int(min(sample, VALUES // max(length or 1, 1)))
    spot = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 32)).cast("double") / float(1 << 32)
    drawn = whole.where(spot < min(1.0, sample / max(count, 1))).collect()
    drawn = [tuple(r) for r in sorted(drawn, key=lambda r: (r["key"], r["id"]))]
    few = lambda n, aim, top: int(min(top, max(1, n // aim)))
    cells = fitted(drawn, few(count, cell, CELLS))
    candidates = written(placed(whole, cells), "cells")
    chosen = whole.where(is_anchor)
    groups = fitted(drawn, few(chosen.count(), group, GROUPS))
    anything = chosen.withColumns({"low": F.array(F.lit(LOWEST)), "high": F.array(F.lit(HIGHEST))})
    anchors = written(placed(_seeded(anything, drawn, True, positives), groups), "anchors")

    # an anchor is asked only if it has a positive at all; scores go with the anchor from here on
    near = written(search(candidates, anchors, groups, cells, True, positives, part), "positives")
    of = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive_id"), "score"))).alias("near"))
    ranges = {"low": F.transform("near", lambda s: _share(s["score"], *least, up=True)), "high": F.transform("near", lambda s: _share(s["score"], *most, up=False))}
    asked = anchors.drop("low", "high").join(of, "key").withColumns(ranges)
    asked = written(_seeded(asked.drop("near"), drawn, False, negatives), "asked")
    far = search(candidates, asked, groups, cells, False, negatives, part)
    told = near.select("key", (F.col("rank") - 1).cast("int").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    name = anchors.select("key", F.col("id").alias("anchor_id"))
    out = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(told, ["key", "slot"]).join(name, "key")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
