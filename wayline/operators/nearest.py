"""The nearest objects of a frame: each frame is cut into a grid, and an object looks around itself in growing rings.

A frame is one task's group. A ring is enough when nothing beyond it can be as near as what was found, so that an object
meets a few others and not all of its frame, and no table of pairs is sorted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions import geometry as G

#: Pairs that are measured at a time, and objects that a cell aims at.
PAIRS, FULL = 1 << 20, 4
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def first_of(pairs: Pairs, names: np.ndarray, most: int) -> Pairs:
    """The first `most` pairs of each asking object by metres, then by the other's name."""
    i, h, metres = pairs
    order = np.lexsort((names[h], metres, i))
    i, h, metres = i[order], h[order], metres[order]
    begins = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
    kept = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)])) < most
    return i[kept], h[kept], metres[kept]


def around(asks: np.ndarray, holds: np.ndarray, x: np.ndarray, y: np.ndarray, names: np.ndarray, measure: Callable[[np.ndarray, np.ndarray], np.ndarray], least: np.ndarray, most: int) -> list[Pairs]:
    """The nearest `most` of holds for each of asks (indices); least[k] is the least metres a unit of distance of asks[k]."""
    known = lambda k: k[np.isfinite(x[k]) & np.isfinite(y[k])]
    least, asks, holds = least[np.isfinite(x[asks]) & np.isfinite(y[asks])], known(asks), known(holds)
    if not len(asks) or not len(holds):
        return []
    low_x, low_y = x[holds].min(), y[holds].min()
    wide, high = x[holds].max() - low_x, y[holds].max() - low_y
    side = max(np.sqrt(wide * high * FULL / len(holds)), max(wide, high) * FULL / len(holds)) or 1.0
    columns, rows = int(wide / side) + 1, int(high / side) + 1
    cells = np.floor((y[holds] - low_y) / side).astype(np.int64) * columns + np.floor((x[holds] - low_x) / side).astype(np.int64)
    holds = holds[np.argsort(cells, kind="stable")]
    starts = np.searchsorted(np.sort(cells), np.arange(columns * rows + 1))
    far = 4.0 * (columns + rows)  # an object further from the grid than that is asked against all of it
    at = [np.floor(np.clip((v[asks] - low) / side, -far, far)).astype(np.int64) for v, low in ((x, low_x), (y, low_y))]
    out, left, ring = [], np.arange(len(asks)), 1
    while len(left):
        whole = ring > 2 * far
        spans = np.arange(-ring, ring + 1) if not whole and 2 * ring < rows else None
        ys = at[1][left][:, None] + spans[None] if spans is not None else np.repeat(np.arange(rows)[None], len(left), 0)
        if spans is None and not whole:
            ys = np.where(np.abs(ys - at[1][left][:, None]) <= ring, ys, -1)
        xs = at[0][left][:, None]
        from_x, to_x = (np.clip(xs - ring, 0, columns), np.clip(xs + ring + 1, 0, columns)) if not whole else (np.zeros_like(xs), np.full_like(xs, columns))
        inside = (ys >= 0) & (ys < rows) & (to_x > from_x)
        row = np.where(inside, ys, 0) * columns
        begin, end = starts[np.where(inside, row + from_x, 0)], starts[np.where(inside, row + to_x, 0)]
        sizes = end - begin
        ends, done = np.cumsum(sizes.sum(1)), np.zeros(len(left), bool)
        cut = 0
        while cut < len(left):
            upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS, "right")))
            own, first = sizes[cut:upto].ravel(), begin[cut:upto].ravel()
            who = np.repeat(np.repeat(np.arange(cut, upto), sizes.shape[1]), own)
            spot = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first, own)
            i, h = left[who], holds[spot]
            metres = measure(asks[i], h)
            i, h, metres = first_of((i, h, metres), names, most)
            count = np.bincount(i, minlength=len(asks))[left[cut:upto]]
            worst = np.full(len(asks), -np.inf)
            np.maximum.at(worst, i, metres)
            beyond = ring * side * least[left[cut:upto]] * (1 - 1e-9)
            done[cut:upto] = whole | ((count >= most) & (worst[left[cut:upto]] < beyond))
            keep = done[np.searchsorted(left, i)]
            out.append((asks[i[keep]], h[keep], metres[keep]))
            cut = upto
        left, ring = left[~done], ring * 2
    return out


def nearest(tracks: DataFrame, asks: Column, holds: Column, most: int) -> DataFrame:
    """(source, t, item, holder, metres, item_confidence, holder_confidence, holder_class, rank): for each object of a frame
    that asks its nearest of those that hold, by geometry.distance_m, ties by id."""
    numbers = ("x1", "y1", "x2", "y2", "world_x", "world_y")
    rows = tracks.select("source", "t", F.col("object_id"), "class", "confidence", *(F.col(c).cast("double") if c in tracks.columns else F.lit(None).cast("double").alias(c) for c in numbers), (F.col("world_frame") if "world_frame" in tracks.columns else F.lit(None).cast("string")).alias("world_frame"), G.nominal_width().alias("nominal"), F.coalesce(asks, F.lit(False)).alias("asks"), F.coalesce(holds, F.lit(False)).alias("holds"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"source {kind['source']}, t {kind['t']}, item {kind['object_id']}, holder {kind['object_id']}, metres double, item_confidence {kind['confidence']}, holder_confidence {kind['confidence']}, holder_class string, rank int"

    def run(frame: pa.Table) -> pa.Table:
        number = lambda c: frame.column(c).to_numpy().astype(float)
        x1, y1, x2, y2, wx, wy, nominal = (number(c) for c in (*numbers, "nominal"))
        x, y, width = (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1
        worlds = [w if k else None for w, k in zip(frame.column("world_frame").to_pylist(), np.isfinite(wx) & np.isfinite(wy), strict=True)]
        codes = {w: k for k, w in enumerate(sorted({w for w in worlds if w is not None}))}
        world = np.array([codes.get(w, -1) for w in worlds])
        names = np.unique(np.array([str(v) for v in frame.column("object_id").to_pylist()], dtype=object), return_inverse=True)[1]
        ask, hold = (np.flatnonzero(frame.column(c).to_numpy()) for c in ("asks", "holds"))

        def pixels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            gap = np.sqrt((x[a] - x[b]) * (x[a] - x[b]) + (y[a] - y[b]) * (y[a] - y[b])) / np.maximum((width[a] + width[b]) / 2, 1.0)
            return gap * (nominal[a] + nominal[b]) / 2

        def placed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.sqrt((wx[a] - wx[b]) * (wx[a] - wx[b]) + (wy[a] - wy[b]) * (wy[a] - wy[b]))

        parts: list[Pairs] = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        for code in np.unique(world[ask]):
            own = ask[world[ask] == code]
            others = hold[(world[hold] != code) | (code < 0)]
            if len(others):
                least = (nominal[own] + nominal[others].min()) / 2 / np.maximum((width[own] + np.nanmax(width[others], initial=0.0)) / 2, 1.0)
                parts += around(own, others, x, y, names, pixels, least, most)
            if code >= 0:
                parts += around(own, hold[world[hold] == code], wx, wy, names, placed, np.ones(len(own)), most)
        i, h, metres = first_of(tuple(np.concatenate(c) for c in zip(*parts, strict=True)), names, most)
        begins = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, int)
        rank = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)])) + 1
        took = lambda c, k: frame.column(c).take(pa.array(k))
        columns = [took("source", i), took("t", i), took("object_id", i), took("object_id", h), pa.array(metres), took("confidence", i), took("confidence", h), took("class", h), pa.array(rank.astype(np.int32))]
        return pa.table(columns, names=["source", "t", "item", "holder", "metres", "item_confidence", "holder_confidence", "holder_class", "rank"])

    return rows.where("asks OR holds").groupBy("source", "t").applyInArrow(run, schema)
