"""Operators whose state runs along a source's frames: trackers, entries, boarding, custody, refractory audio.

Spark deals the rows by segments of sources, which begin where an operator's state is provably empty (`restarts`), or by
what the state is kept for (an item, a class of sound), and sorts them by time; a small fold keeps the state at hand, so
a task holds one frame and the objects in view. A source that is never quiet for as long as the operator remembers has
no restart points and stays one segment; `restarts.cuts` tells which. Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import sqrt
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.functions import geometry as G
from wayline.functions.geometry import PACKAGES, VEHICLES
from wayline.operators.nearest import PAIRS, nearest
from wayline.operators.restarts import FIRST, beside, bucket_width, clocked, running, segments_of_frames, segments_of_rows
from wayline.operators.tracks import _matches as matches
from wayline.operators.tracks import episodes, nearest_holders
from wayline.session import written

SECOND = 1_000_000
MATCHES = "t long, predicate string, source string, confidence double, provider string, arguments map<string,string>, classes map<string,string>"
TRACK = ("object_id", "class", "confidence", "x1", "y1", "x2", "y2", "world_x", "world_y", "world_frame", "velocity_x", "velocity_y", "age")


def fold(rows: DataFrame, key: str | list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], list[tuple]], schema: str) -> DataFrame:
    """step(state, row) -> rows out, over each key's rows in order. Rows and state never leave the key's task."""
    names, keys = [x.split()[0] for x in schema.split(", ")], [key] if isinstance(key, str) else key
    spots = [rows.columns.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                own = [r[k] for k in spots]
                if own != current:
                    current, state = own, start()
                out += step(state, r)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _centre(x: dict) -> tuple[float, float]:
    return (x["x1"] + x["x2"]) / 2, (x["y1"] + x["y2"]) / 2


def _known(v: Any) -> bool:
    return v is not None and v == v


def replaced(x: dict[str, np.ndarray], o: dict[str, np.ndarray]) -> np.ndarray:
    """Whether each box x (t, x, y, size) has one of o (since, until, x, y, size) at that time within the greater size.

    Those of o are sorted by the cells of a grid as wide as the greatest size, so that a box meets the nine around it.
    """
    out = np.zeros(len(x["t"]), bool)
    o = {k: v[np.isfinite(o["x"]) & np.isfinite(o["y"])] for k, v in o.items()}
    asks = np.flatnonzero(np.isfinite(x["x"]) & np.isfinite(x["y"]))
    if not len(asks) or not len(o["x"]):
        return out
    low = {c: min(o[c].min(), x[c][asks].min()) for c in "xy"}
    span = max(max(o[c].max(), x[c][asks].max()) - low[c] for c in "xy")
    sizes = np.concatenate([x["size"][asks], o["size"]])
    side = max(sizes[np.isfinite(sizes)].max(initial=0.0) * (1 + 1e-9) if not np.isinf(sizes).any() else span, span / 1e6) or 1.0
    cell = lambda v, c: np.floor((v - low[c]) / side).astype(np.int64) + 1
    rows = int(span / side) + 4
    at = cell(o["y"], "y") * rows + cell(o["x"], "x")
    order = np.argsort(at, kind="stable")
    at, o = at[order], {k: v[order] for k, v in o.items()}
    for k in (-1, 0, 1):
        own = (cell(x["y"][asks], "y") + k) * rows + cell(x["x"][asks], "x")
        begin, end = np.searchsorted(at, own - 1, "left"), np.searchsorted(at, own + 1, "right")
        ends, cut = np.cumsum(end - begin), 0
        while cut < len(asks):
            upto = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + PAIRS, "right")))
            n = (end - begin)[cut:upto]
            i = np.repeat(asks[cut:upto], n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[cut:upto], n)
            near = np.hypot(x["x"][i] - o["x"][j], x["y"][i] - o["y"][j]) <= np.maximum(x["size"][i], o["size"][j])
            out[i[near & (o["since"][j] <= x["t"][i]) & (x["t"][i] <= o["until"][j])]] = True
            cut = upto
    return out


def enters(tracks: DataFrame, frames: DataFrame, least_age: int = 3, absence_us: int = 1_500_000) -> DataFrame:
    """Objects that come into view and move: not those of a source's first frame, nor such as replace one just lost.

    Lost is what is not in the frame and not yet gone (`episodes`). What comes and what is lost meet by source, class and slots
    of absence_us, in a grid; the rest are joins by episode.
    """
    have, key = [c for c in TRACK if c in tracks.columns], ["source", "object_id"]
    single = tracks.repartition(*key).groupBy(*key, "t").agg(F.max(F.struct(*have)).alias("b")).select("source", "t", "b.*")
    age = F.col("age") if "age" in have else F.lit(None).cast("int")
    x, y = G.centre()
    tall = F.col("y2") - F.col("y1")
    grown = F.coalesce(F.when(age != 0, age), F.lit(1)) >= least_age
    seen = episodes(single, frames, absence_us).select(*key, "t", "class", "confidence", "episode", "since", "gone_at", grown.alias("grown"), x.alias("x"), y.alias("y"), F.greatest(G.width(), tall).alias("size"), F.greatest(F.lit(5.0), F.least(G.width(), tall) * 0.25).alias("away"))
    seen = written(seen.withColumn("again", F.lead("t").over(Window.partitionBy(*key).orderBy("t"))), "seen")
    ticks = clocked(frames, bucket_width(frames)).select("source", "t", "after")
    first = ticks.groupBy("source").agg(F.min("t").alias("first"))
    slot = lambda t: F.floor(t / F.lit(max(absence_us, 1))).cast("long")
    kind = F.lower("class").alias("kind")
    fresh = seen.where(F.col("t") == F.col("since")).join(first, "source").where(F.col("t") > F.col("first")).select("source", kind, slot(F.col("t")).alias("slot"), "t", "object_id", "episode", "x", "y", "size", "away")
    missing = seen.join(ticks, ["source", "t"]).where(F.col("after").isNotNull() & (F.col("again").isNull() | (F.col("again") > F.col("after"))))
    until = F.coalesce(F.least("gone_at", F.col("again") - 1), F.lit(1 << 62))
    slots = F.sequence(slot(F.col("after")), slot(F.col("after") + max(absence_us - 1, 0)))
    slots = F.array_distinct(F.concat(slots, F.when(F.col("gone_at").isNotNull(), F.array(slot(F.col("gone_at")))).otherwise(F.array().cast("array<bigint>"))))
    lost = missing.select(F.col("source").alias("of"), kind, F.explode(slots).alias("slot"), F.col("after").alias("since"), until.alias("until"), *(F.col(c).alias(f"o_{c}") for c in ("x", "y", "size")))
    names = {f.name: f.dataType.simpleString() for f in fresh.schema}
    kept = ("source", "object_id", "episode", "x", "y", "away")

    def run(came: pa.Table, gone: pa.Table) -> pa.Table:
        arrays = lambda rows, *columns: {c.removeprefix("o_"): rows.column(c).to_numpy() for c in columns}
        hidden = replaced(arrays(came, "t", "x", "y", "size"), arrays(gone, "since", "until", "o_x", "o_y", "o_size"))
        return came.filter(pa.array(~hidden)).select(kept)

    came = fresh.groupBy("source", "kind", "slot").cogroup(lost.groupBy("of", "kind", "slot")).applyInArrow(run, ", ".join(f"{c} {names[c]}" for c in kept)).withColumnsRenamed({"x": "came_x", "y": "came_y", "away": "least"})
    rows = seen.where("grown").join(came, ["source", "object_id", "episode"])
    if "frame_width" in frames.columns:
        rows = rows.join(frames.groupBy("source", "t").agg(F.max("frame_width").alias("frame_width")), ["source", "t"])
        unknown = F.col("frame_width").isNull() | F.isnan(F.col("frame_width").cast("double"))
        rows = rows.where(unknown | (F.hypot(F.col("x") - F.col("came_x"), F.col("y") - F.col("came_y")) >= F.col("least")))
    told = rows.groupBy("source", "object_id", "episode").agg(F.min(F.struct("t", "confidence", "class")).alias("m")).select("source", "object_id", "m.*")
    return matches(told, "enters", {"object": F.col("object_id")}, {"object": F.col("class")}, F.col("confidence"))


def boarding(tracks: DataFrame, frames: DataFrame, close_m: float = 3.0, leave_m: float = 2.0, apart_m: float = 5.0, moving_mps: float = 0.75, stopped_us: int = SECOND // 2, wait_us: int = 8 * SECOND) -> DataFrame:
    """boards: a person vanishes by a vehicle that then leaves. disembarks: one appears by a stopped vehicle, then parts.

    A person is a candidate for one vehicle at a time, the one that was nearest last; a pair is told of once. What a
    person waits for is the later sightings of its vehicle within wait_us, so these are joins by vehicle and slots of
    that length; the nearest vehicles are those of `nearest`.
    """
    missing = {c: F.lit(None).cast("string" if c == "world_frame" else "double") for c in TRACK if c not in tracks.columns and c != "age"}
    clean = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in ("world_x", "world_y", "velocity_x", "velocity_y")}
    width = bucket_width(frames)
    seen = tracks.withColumns(missing).withColumns(clean).withColumn("world_frame", F.coalesce("world_frame", F.lit(""))).join(clocked(frames, width), ["source", "t"])
    kind, key = F.lower("class"), ["source", "object_id"]
    is_person, is_vehicle = kind == "person", kind.isin(*VEHICLES)
    people = beside(seen.where(is_person), key, "t", width, {"was": "t"}, {"again": "t"})
    moving = F.coalesce(G.speed_mps(), F.lit(0.0)) > moving_mps
    cars = beside(seen.where(is_vehicle).withColumn("moving", moving), key, "t", width, {"was": "t", "was_moving": "moving"})
    stops = F.when(~F.col("moving") & (F.col("was").isNull() | (F.col("was") < F.col("before")) | F.col("was_moving")), F.col("t"))
    cars = running(cars, key, "t", width, "stopped", stops).withColumn("stood", ~F.col("moving") & (F.col("t") - F.col("stopped") >= stopped_us))
    close = nearest(seen, is_person, is_vehicle, 1).where(F.col("metres") <= close_m).select("source", "t", F.col("item").alias("person"), F.col("holder").alias("vehicle"))
    by = people.select("source", "t", F.col("object_id").alias("person"), "was", "again", "before", "after").join(close, ["source", "t", "person"])
    then = cars.select("source", "t", F.col("object_id").alias("vehicle"), "stood", F.struct(F.col("world_x").alias("wx"), F.col("world_y").alias("wy"), G.centre()[0].alias("x"), G.centre()[1].alias("y")).alias("then"))
    by = by.join(then, ["source", "t", "vehicle"])
    slot = lambda t: F.floor(t / F.lit(max(wait_us, 1))).cast("long")
    waiting = lambda rows: beside(rows, ["source", "person"], "t", width, after={"next": "from"}).withColumn("slot", F.explode(F.sequence(slot(F.col("t")), slot(F.col("t") + wait_us))))
    told = lambda c, v: (F.col(f"{v}.t") >= F.col(f"{c}.from")) & (F.col(f"{v}.t") - F.col(f"{c}.t") <= wait_us) & (F.col(f"{c}.next").isNull() | (F.col(f"{v}.t") < F.col(f"{c}.next")))
    # a person that was not in the frame before, by a vehicle that stands: until both are apart in one frame
    came = waiting(by.where((F.col("before").isNull() | F.col("was").isNull() | (F.col("was") < F.col("before"))) & F.col("stood")).withColumn("from", F.col("t"))).alias("c")
    a, b = people.withColumn("slot", slot(F.col("t"))).alias("a"), cars.alias("b")
    later = came.join(a, (F.col("a.source") == F.col("c.source")) & (F.col("a.object_id") == F.col("c.person")) & (F.col("a.slot") == F.col("c.slot")) & told("c", "a"))
    parted = later.join(b, (F.col("b.source") == F.col("c.source")) & (F.col("b.object_id") == F.col("c.vehicle")) & (F.col("b.t") == F.col("a.t"))).where(G.distance_m("a", "b") >= apart_m)
    off = parted.select("c.source", F.lit("disembarks").alias("predicate"), "c.person", "c.vehicle", F.col("a.t").alias("t"), F.least("a.confidence", "b.confidence").alias("sure"))
    # a person that is not in the next frame, by a vehicle: until that one has come away or is fast
    left = waiting(by.where(F.col("after").isNotNull() & (F.col("again").isNull() | (F.col("again") > F.col("after")))).withColumn("from", F.col("after"))).alias("l")
    b = cars.withColumn("slot", slot(F.col("t"))).alias("b")
    x, y = G.centre("b")
    raw = G.apart(F.coalesce("l.then.wx", "l.then.x"), F.when(F.col("l.then.wx").isNotNull(), F.col("l.then.wy")).otherwise(F.col("l.then.y")), F.coalesce("b.world_x", x), F.when(F.col("b.world_x").isNotNull(), F.col("b.world_y")).otherwise(y))
    come = F.when(F.col("b.world_x").isNotNull(), raw).otherwise(raw / F.greatest(G.width("b"), F.lit(1.0)) * G.nominal_width("b"))
    gone = left.join(b, (F.col("b.source") == F.col("l.source")) & (F.col("b.object_id") == F.col("l.vehicle")) & (F.col("b.slot") == F.col("l.slot")) & told("l", "b")).where((come >= leave_m) | F.col("b.moving"))
    on = gone.select("l.source", F.lit("boards").alias("predicate"), "l.person", "l.vehicle", F.col("b.t").alias("t"), F.col("b.confidence").alias("sure"))
    first = off.unionByName(on).groupBy("source", "predicate", "person", "vehicle").agg(F.min(F.struct("t", F.least(F.greatest("sure", F.lit(0.0)), F.lit(1.0)).alias("confidence"))).alias("m"))
    of = lambda a, b: F.create_map(F.lit("person"), a, F.lit("vehicle"), b)
    return first.select("m.t", "predicate", "source", "m.confidence", F.lit("tracks").alias("provider"), of(F.col("person"), F.col("vehicle")).alias("arguments"), of(F.lit("person"), F.lit("vehicle")).alias("classes"))


def transfers(tracks: DataFrame, frames: DataFrame, close_m: float = 1.5, stable_us: int = SECOND, forget_us: int = 5 * SECOND) -> DataFrame:
    """Custody of items: a new nearest holder, in a later frame still the nearest and for stable_us at least, takes over.

    Custody of an item out of view is forgotten forget_us after it was last confirmed. Items know nothing of one another,
    so each is a stream of its own: its sightings, with the nearest holder in reach and the frame before each.
    """

    def step(state: dict, row: Any) -> list[tuple]:
        held, pending = state.get("held"), state.get("pending")
        if held is not None and _known(row.before) and row.before > state["t"] and row.before - held[3] > forget_us:
            held = pending = None  # a frame without the item came so late
        state.update(t=row.t, held=held, pending=pending)
        if row.holder is None:
            state["pending"] = None
            return []
        if pending is None or pending[0] != row.holder:
            state["pending"] = (row.holder, row.t)
            return []
        if row.t - pending[1] < stable_us:
            return []
        sure = min(row.confidence, row.holder_confidence, min(max(0.55 + 0.45 * (1 - row.metres / close_m), 0.0), 1.0))
        out = []
        if held is not None and held[0] != row.holder:
            who = {"item": (row.object_id, row.kind), "giver": held[:2], "receiver": (row.holder, row.holder_class)}
            out.append((row.t, "transfer", row.source, float(min(max(min(held[2], sure), 0.0), 1.0)), "tracks", {k: v[0] for k, v in who.items()}, {k: v[1] for k, v in who.items()}))
        state["held"] = (row.holder, row.holder_class, sure, row.t)
        return out

    near = nearest_holders(tracks, 1).where(F.col("metres") <= close_m).select("source", "t", F.col("item").alias("object_id"), "holder", "holder_class", "holder_confidence", "metres")
    items = tracks.where(F.lower("class").isin(*PACKAGES)).select("source", "t", "object_id", F.col("class").alias("kind"), "confidence")
    clock = clocked(frames, bucket_width(frames)).select("source", "t", "before")
    rows = items.join(near, ["source", "t", "object_id"], "left").join(clock, ["source", "t"])
    return fold(rows, ["source", "object_id"], ["t"], dict, step, MATCHES)


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of each box of a (x1, y1, x2, y2) with each of b; 0 where the union is empty."""
    across = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    down = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    shared = across * down
    whole = area(a)[:, None] + area(b)[None, :] - shared
    return np.divide(shared, whole, out=np.zeros_like(shared), where=whole > 0)


def overlapping(a: np.ndarray, b: np.ndarray, least: float, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, row of a, row of b) of the pairs whose overlap is at least `least`.

    Boxes that overlap have corners within the greatest width and height: a's are sorted into cells of that size, and each
    of b looks into the nine around it, some `most` pairs at a time. All pairs are compared where none need overlap.
    """
    out, every = [], np.arange(len(a))
    if least > 0:
        some, own = np.flatnonzero(np.isfinite(a).all(axis=1)), np.flatnonzero(np.isfinite(b).all(axis=1))
        both = np.concatenate([a[some], b[own]])
        low, size = (both[:, :2].min(axis=0), np.maximum((both[:, 2:] - both[:, :2]).max(axis=0), 1e-9)) if len(both) else (np.zeros(2), np.ones(2))
        cell = lambda x: np.minimum((x[:, :2] - low) / size, 1e8).astype(np.int64) + 1
        across = int(cell(both)[:, 0].max(initial=0)) + 3
        named = lambda c: c[:, 1] * across + c[:, 0]
        order = np.argsort(named(cell(a[some])), kind="stable")
        every, keys, mine = some[order], named(cell(a[some]))[order], named(cell(b[own]))
        starts = np.stack([np.searchsorted(keys, mine + k * across - 1) for k in (-1, 0, 1)], axis=1).ravel()
        counts = np.stack([np.searchsorted(keys, mine + k * across + 1, "right") for k in (-1, 0, 1)], axis=1).ravel() - starts
        own = np.repeat(own, 3)
    else:
        starts, counts, own = np.zeros(len(b), dtype=np.int64), np.full(len(b), len(a)), np.arange(len(b))
    done, ends = 0, np.cumsum(counts)
    while done < len(own):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most, "right")))
        n = counts[done:upto]
        at = every[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[done:upto], n)]
        spot = np.repeat(own[done:upto], n)
        p, q = a[at], b[spot]
        wide = np.clip(np.minimum(p[:, 2], q[:, 2]) - np.maximum(p[:, 0], q[:, 0]), 0, None)
        shared = wide * np.clip(np.minimum(p[:, 3], q[:, 3]) - np.maximum(p[:, 1], q[:, 1]), 0, None)
        whole = (p[:, 2] - p[:, 0]) * (p[:, 3] - p[:, 1]) + (q[:, 2] - q[:, 0]) * (q[:, 3] - q[:, 1]) - shared
        score = np.divide(shared, whole, out=np.zeros_like(shared), where=whole > 0)
        fits = score >= least
        out.append((score[fits], at[fits], spot[fits]))
        done = upto
    empty = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0), empty, empty)


class Tracks:
    """The tracks of one class in one segment, by arrays: number, number and time of the last frame, age, box."""

    def __init__(self) -> None:
        self.born = 0
        self.number = self.frame = self.t = self.age = np.zeros(0, dtype=np.int64)
        self.box = np.zeros((0, 4))

    def feed(self, frame: int, t: int, boxes: np.ndarray, least_iou: float, most_missed: int) -> tuple[np.ndarray, ...]:
        """(number, age, velocity_x, velocity_y) of a frame's boxes."""
        alive = frame - self.frame - 1 <= most_missed
        for x in ("number", "frame", "t", "age", "box"):
            setattr(self, x, getattr(self, x)[alive])
        score, at, spot = overlapping(self.box, boxes, least_iou)
        order = np.lexsort((-spot, -at, -score))  # numbers grow with the place
        ours, theirs = np.full(len(boxes), -1), [False] * len(self.number)
        for i, k in zip(at[order].tolist(), spot[order].tolist(), strict=True):
            if not theirs[i] and ours[k] < 0:
                theirs[i], ours[k] = True, i
        old, new = np.flatnonzero(ours >= 0), np.flatnonzero(ours < 0)
        was = ours[old]
        number, age, v = np.empty(len(boxes), dtype=np.int64), np.ones(len(boxes), dtype=np.int64), np.full((len(boxes), 2), np.nan)
        number[old], number[new] = self.number[was], self.born + 1 + np.arange(len(new))
        age[old] = self.age[was] + 1
        centre = lambda x: (x[:, :2] + x[:, 2:]) / 2
        seconds = ((t - self.t[was]) / SECOND)[:, None]
        v[old] = np.divide(centre(boxes[old]) - centre(self.box[was]), seconds, out=np.full((len(old), 2), np.nan), where=seconds > 0)
        self.frame[was], self.t[was], self.age[was], self.box[was] = frame, t, age[old], boxes[old]
        more = lambda x, value: np.concatenate([x, np.full(len(new), value, dtype=np.int64)])
        self.frame, self.t, self.age = more(self.frame, frame), more(self.t, t), more(self.age, 1)
        self.number, self.box = np.concatenate([self.number, number[new]]), np.concatenate([self.box, boxes[new]])
        self.born += len(new)
        return number, age, v[:, 0], v[:, 1]


def track_objects(detections: DataFrame, least_iou: float = 0.25, most_missed: int = 5) -> DataFrame:
    """Tracks from detection frames (source, t, detections): greedy best-overlap assignment within a class.

    Of equal overlaps the newer track, then the later detection of the frame, comes first. Nothing but the number of
    tracks so far is remembered after more than most_missed frames without detections. Classes do not meet: each class
    of a segment is folded for itself and numbers its own tracks, which are then numbered along the source by the frame and the
    place in it that they begin with.
    """
    columns = ["source", "segment", "kind", "t", "n", "spot", "class", "confidence", "x1", "y1", "x2", "y2"]
    schema = "source string, segment long, kind string, t long, n long, spot int, class string, confidence double, x1 double, y1 double, x2 double, y2 double, number long, age int, velocity_x double, velocity_y double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tracks, left = None, Tracks(), None

        def told(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            nonlocal current, tracks
            keys, boxes, out = list(zip(rows["source"], rows["segment"], rows["kind"], strict=True)), rows[["x1", "y1", "x2", "y2"]].to_numpy(dtype=np.float64), []
            n, t = rows["n"].to_numpy(), rows["t"].to_numpy()
            for low, high in zip(starts, [*starts[1:], len(rows)], strict=True):
                if keys[low] != current:
                    current, tracks = keys[low], Tracks()
                out.append(tracks.feed(int(n[low]), int(t[low]), boxes[low:high], least_iou, most_missed))
            number, age, vx, vy = (np.concatenate(x) for x in zip(*out, strict=True))
            return rows.assign(number=number, age=age.astype(np.int32), velocity_x=vx, velocity_y=vy)

        for batch in batches:
            rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
            if not len(rows):
                continue
            changed = np.zeros(len(rows), dtype=bool)
            for c in ("source", "segment", "kind", "t"):
                own = rows[c].to_numpy()
                changed[1:] |= own[1:] != own[:-1]
            starts = np.concatenate([[0], np.flatnonzero(changed)])
            left, rows = rows.iloc[starts[-1] :].reset_index(drop=True), rows.iloc[: starts[-1]]  # a frame may go on in the next batch
            if len(rows):
                yield told(rows, starts[:-1])
        if left is not None:
            yield told(left, np.array([0]))

    gone = F.col("n") - F.col("was_n") - 1 > most_missed
    cut = segments_of_frames(detections.where(F.size("detections") > 0), detections, gone)
    width = bucket_width(detections)
    frames = running(cut, ["source"], "t", width, "n", F.lit(1).cast("long"), F.sum)
    seen = detections.select("source", "t", F.posexplode("detections").alias("spot", "d")).join(frames, ["source", "t"])
    seen = seen.select("source", "segment", F.lower("d.class").alias("kind"), "t", "n", "spot", *(F.col(f"d.{c}").alias(c) for c in columns[6:]))
    own = written(seen.repartition("source", "segment", "kind").sortWithinPartitions("source", "segment", "kind", "t", "spot").mapInPandas(run, schema), "tracks")
    born = own.where("age = 1").select("source", "segment", "kind", "number", "t", "spot")
    many = born.groupBy("source", "t").agg(F.count("*").alias("own"))
    earlier = running(many, ["source"], "t", width, "upto", F.col("own"), F.sum).select("source", "t", (F.col("upto") - F.col("own")).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("source", "t").orderBy("spot"))
    names = born.withColumn("place", place).join(earlier, ["source", "t"]).select("source", "segment", "kind", "number", (F.col("place") + F.col("earlier")).alias("track"))
    names = names.withColumnsRenamed({c: f"of_{c}" for c in ("source", "segment", "kind", "number")})
    named = own.join(names, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in ("source", "segment", "kind", "number")])
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return named.select("source", "t", F.concat("source", F.lit(":track_"), F.col("track").cast("string")).alias("object_id"), "class", "confidence", "x1", "y1", "x2", "y2", known("velocity_x"), known("velocity_y"), "age")


def suppressed_boxes(detections: DataFrame, most_iou: float = 0.45) -> DataFrame:
    """Non-maximum suppression per frame and class of rows (source, t, class, confidence, x1, y1, x2, y2).

    The surest box of a class stays and those that overlap it by more than most_iou go, and so on with the rest.
    """

    def run(table: pa.Table) -> pa.Table:
        column = lambda name: np.array(table.column(name).to_pylist())
        boxes, kinds = np.stack([column(c).astype(float) for c in ("x1", "y1", "x2", "y2")], axis=1), column("class")
        left = np.lexsort((boxes[:, 1], boxes[:, 0], -column("confidence").astype(float)))
        kept = []
        while len(left):
            best, left = left[0], left[1:]
            kept.append(best)
            left = left[(kinds[left] != kinds[best]) | (overlaps(boxes[best : best + 1], boxes[left])[0] <= most_iou)]
        return table.take(pa.array(sorted(kept)))

    return detections.groupBy("source", "t").applyInArrow(run, detections.schema)


# Threshold, refractory time and label aliases of the audio classes.
AUDIO = {"gunshot": (0.35, 0, ("Gunshot, gunfire", "Machine gun", "Fusillade")), "alarm": (0.40, SECOND, ("Alarm", "Alarm clock", "Fire alarm", "Siren"))}


def audio_events(windows: DataFrame, audio: dict[str, tuple[float, int, tuple[str, ...]]] = AUDIO, least_consecutive: int = 1) -> DataFrame:
    """audio_event matches from (source, t, scores map<string,double>): thresholds, runs of windows, refractory times.

    Each class of a source is a stream of its own, cut where a run of windows begins that is a refractory time away from
    the run before. Windows below the threshold only end runs.
    """
    least = max(least_consecutive, 1)
    score = lambda labels: F.greatest(F.lit(0.0), F.lit(0.0), *(F.coalesce(F.col("scores")[x], F.lit(0.0)) for x in labels))
    classes = F.array(*(F.struct(F.lit(name).alias("class"), F.lit(threshold).alias("least"), F.lit(quiet).cast("long").alias("quiet"), score(labels).alias("score")) for name, (threshold, quiet, labels) in sorted(audio.items())))
    rows = windows.select("source", "t", F.explode(classes).alias("c")).select("source", "t", "c.*").withColumn("hot", F.col("score") >= F.col("least"))
    key, width = ["source", "class"], bucket_width(windows)
    if least > 1:
        rows = beside(rows, key, "t", width, {"was_hot": "hot"}).withColumn("begins", ~F.coalesce("was_hot", F.lit(False)))
    else:
        rows = rows.withColumn("begins", F.lit(True))  # any window is a run
    hot = beside(rows.where("hot"), key, "t", width, {"was": "t"})
    point = F.when(F.col("begins") & (F.col("t") - F.col("was") >= F.col("quiet")), F.col("t"))
    cut = running(hot, key, "t", width, "segment", point).select("source", "class", "t", "score", "quiet", "begins", F.coalesce("segment", F.lit(FIRST)).alias("segment"))

    def step(state: dict, row: Any) -> list[tuple]:
        state["run"] = 1 if least > 1 and row.begins else state.get("run", 0) + 1
        if state["run"] < least or "last" in state and row.t < state["last"] + row.quiet:
            return []
        state.update(run=0, last=row.t)
        return [(row.t, "audio_event", row.source, float(min(row.score, 1.0)), "audio", {"class": row[1]}, {})]

    return fold(cut, ["source", "class", "segment"], ["t"], dict, step, MATCHES)


def suppressed_repeats(rows: DataFrame, key: str, quiet_us: int = 2 * SECOND) -> DataFrame:
    """Of rows (key, t), those at least quiet_us after the last one that was let through, per key.

    A row that comes quiet_us after the one before it is let through whatever was before: a restart point. Inside a
    segment only the rows let through are steps. Of rows of one key and time, one is let through if quiet_us is not 0.
    """
    cut = segments_of_rows(rows, [key], quiet_us)
    keys = [cut.columns.index(c) for c in (key, "segment")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, free = None, 0
        for batch in batches:
            t = batch.column("t").to_numpy(zero_copy_only=False)
            own = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            kept, at = [], 0
            while at < len(own):
                end = at + 1
                if own[at] != current:
                    current, free = own[at], t[at]
                # rows are sorted: the group's end, and from row let through to row let through
                while end < len(own) and own[end] == current:
                    end += 1
                while (at := at + int(np.searchsorted(t[at:end], free))) < end:
                    kept.append(at)
                    free, at = t[at] + quiet_us, at + 1
                at = end
            yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int64())) for c in batch.columns[:-1]], names=batch.schema.names[:-1])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return cut.repartition(key, "segment").sortWithinPartitions(key, "segment", "t").mapInArrow(run, schema)


class Centroids:
    """Running centroids of one source: vectors as rows of an array that doubles, their lengths and numbers of members."""

    def __init__(self) -> None:
        self.rows, self.lengths, self.members = np.zeros((0, 0)), np.zeros(0), []

    def put(self, k: int, v: np.ndarray, members: int) -> None:
        if k == len(self.rows):
            grown, lengths = np.zeros((max(16, 2 * k), len(v))), np.zeros(max(16, 2 * k))
            if k:
                grown[:k], lengths[:k] = self.rows, self.lengths
            self.rows, self.lengths = grown, lengths
        self.members[k : k + 1] = [members]
        self.rows[k], self.lengths[k] = v, sqrt(float(v @ v))

    def nearest(self, v: np.ndarray, least: float) -> tuple[float, int]:
        """The greatest cosine and its first centroid; some cosine under `least` where none reaches that.

        All cosines are one product of arrays. What that may round differently, next to the greatest, is summed again, and
        so is what has no length that can be divided by.
        """
        n, own, length = len(self.members), v.tolist(), sqrt(float(v @ v))
        if not n:
            return -1.0, 0
        plain = ~((self.lengths[:n] > 1e-100) & (self.lengths[:n] < 1e100)) | (not 1e-100 < length < 1e100)
        if not plain.all():
            cosines = np.full(n, -2.0)
            np.divide(self.rows[:n] @ v, length * self.lengths[:n], out=cosines, where=~plain)
            if not plain.any() and cosines.max() < least - 1e-9:
                return float(cosines.max()), 0
            plain |= cosines >= cosines.max() - 1e-9
        d = sqrt(sum(a * a for a in own))
        cosine = lambda c: (sum(a * b for a, b in zip(own, c, strict=True)) / e) if (e := d * sqrt(sum(b * b for b in c))) else 0.0
        some = np.flatnonzero(plain)
        best = max((cosine(self.rows[k].tolist()), -int(k)) for k in some)
        return best[0], -best[1]


def speakers(segments: DataFrame, least_cosine: float = 0.75) -> DataFrame:
    """speaker_id for segments (source, t, vector): each joins the nearest centroid or begins a new one."""

    def step(found: Centroids, row: Any) -> list[tuple]:
        v = np.array(row.vector, dtype=np.float64)
        cosine, k = found.nearest(v, least_cosine)
        if cosine >= least_cosine:
            n = found.members[k]
            found.put(k, (found.rows[k] * n + v) / (n + 1), n + 1)
        else:
            k = len(found.members)
            found.put(k, v, 1)
        return [(row.source, row.t, f"speaker_{k + 1}")]

    return fold(segments, "source", ["t"], Centroids, step, "source string, t long, speaker_id string")
