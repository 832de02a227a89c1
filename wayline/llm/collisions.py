"""Near-duplicate embeddings by collision-counting projections.

Each vector is projected on many random lines. A line alone leaves a share of all vectors in any window that near pairs
need, so windows are taken within cells: lines are taken in groups, and in each group the vectors that fall into the
same cell on every line are sorted along one more projection, another one for each group. In the window around each
vector there, the collisions of each pair are counted: on how many of LINES projections is one in the other's window?
Pairs whose count reaches a threshold, which a pair at the least cosine misses with a chance of MISS, make candidate
groups. The cells' number of lines grows with the logarithm of the table, so that strangers seldom meet, and the number
of groups, so of sorted projections, is set so that a pair at the least cosine is met in one of them with a chance of
RECALL. Candidate groups are compared in blocks, by matrix products in double precision; links are counted and
connected there, never listed.

Equal vectors are one vector with a multiplicity. Cells with more than CROWD vectors are candidate groups as they
are. Vectors that are null, zero, or have null or non-finite components link with nothing; vectors of different
lengths do not link. Rows that repeat an id count as vectors of their own under that id; a null id links with nothing.
Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.components import Forest, components
from wayline.llm.shingles import BASE, mix
from wayline.session import written

LINES, STEP, CELL, CROWD, BLOCK = 64, 0.1, 2.0, 512, 512
RECALL, MISS = 0.98, 1e-4


def normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def cell_chance(spread: float, cell: float = CELL) -> float:
    """The chance that two points whose projections differ by a normal of that spread fall into one cell."""
    grid = np.linspace(-cell, cell, 4001)
    density = np.exp(-0.5 * (grid / spread) ** 2) / (spread * math.sqrt(2 * math.pi))
    return float(np.sum(density * (1 - np.abs(grid) / cell)) * (grid[1] - grid[0]))


class Plan:
    """Lines a group, groups, half width of a window in steps, and the threshold, for n vectors and a least cosine."""

    def __init__(self, n: int, least: float):
        near, far = math.sqrt(2 - 2 * least), math.sqrt(2)
        self.lines = max(4, math.ceil(math.log(max(n, 2)) / -math.log(cell_chance(far))))
        self.groups = math.ceil(math.log(1 - RECALL) / math.log(1 - cell_chance(near) ** self.lines))
        self.window = max(1, round(2.2 * near / STEP))
        hit = 2 * normal((self.window - 1) * STEP / near) - 1  # rounding may cost a step
        miss, self.threshold = 0.0, 0
        for k in range(LINES + 1):
            miss += math.comb(LINES, k) * hit**k * (1 - hit) ** (LINES - k)
            if miss > MISS:
                self.threshold = k
                break
        # the window along a group's sorted projection: four spreads of a pair at the least cosine
        self.reach = math.ceil(4 * near / STEP)

    def draw(self, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lines of the groups, their cells' offsets, and the lines to count on; the same for all tasks."""
        dice = np.random.Generator(np.random.PCG64(dimension))
        return dice.standard_normal((dimension, self.groups * self.lines)), dice.uniform(0, CELL, self.groups * self.lines), dice.standard_normal((dimension, LINES))


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of the rows that can link, for each length of vectors."""
    sizes: dict[int, list[int]] = {}
    rows = column.to_pylist()
    for k, v in enumerate(rows):
        if v and None not in v:
            sizes.setdefault(len(v), []).append(k)
    for places in sizes.values():
        x = np.array([rows[k] for k in places], dtype=np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            good = np.isfinite(x).all(axis=1) & (np.abs(x).max(axis=1) > 0)
        if good.any():
            x = x[good] / np.abs(x[good]).max(axis=1, keepdims=True)  # no norm overflows or vanishes
            yield np.array(places)[good], x / np.linalg.norm(x, axis=1, keepdims=True)


def entries(vectors: DataFrame, plan: Plan) -> DataFrame:
    """(key, id, along, sketch) of each vector (id, embedding) in each group of lines."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple] = {}
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            for places, unit in usable(batch.column(1)):
                dimension = unit.shape[1]
                if dimension not in drawn:
                    drawn[dimension] = plan.draw(dimension)
                lines, offsets, counting = drawn[dimension]
                for at in range(0, len(unit), 1000):
                    part, own = unit[at : at + 1000], ids[places[at : at + 1000]]
                    cells = np.floor((part @ lines + offsets) / CELL).astype(np.int64).astype(np.uint64).reshape(len(part), plan.groups, plan.lines)
                    key = np.full((len(part), plan.groups), np.uint64(dimension)) * BASE + np.arange(plan.groups, dtype=np.uint64)
                    for j in range(plan.lines):
                        key = mix(key * BASE + cells[:, :, j])
                    steps = np.clip(np.rint(part @ counting / STEP), -127, 127).astype(np.int8)
                    sketches = [s.tobytes() for s in steps]
                    n = plan.groups
                    along = steps[:, np.arange(n) % LINES].astype(np.int32)  # group g is sorted along projection g
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.astype(np.int64).ravel()), pa.array(np.repeat(own, n)), pa.array(along.ravel()), pa.array([s for s in sketches for _ in range(n)], pa.binary())],
                        names=["key", "id", "along", "sketch"],
                    )

    return vectors.select("id", "embedding").mapInArrow(rows, "key long, id long, along int, sketch binary")


def counted(plan: Plan):
    """Edges between those of equal keys whose collisions reach the threshold; rows come sorted by key and along."""

    def pairs(key: np.ndarray, ids: np.ndarray, along: np.ndarray, sketch: np.ndarray, forest: Forest) -> None:
        at = np.arange(len(key))
        for apart in range(1, CROWD):
            at = at[at + apart < len(key)]
            at = at[(key[at] == key[at + apart]) & (along[at + apart] - along[at] <= plan.reach)]
            if not len(at):
                return
            for lo in range(0, len(at), 20000):
                one, other = at[lo : lo + 20000], at[lo : lo + 20000] + apart
                hits = (np.abs(sketch[one] - sketch[other]) <= plan.window).sum(axis=1)
                for a, b in zip(ids[one[hits >= plan.threshold]].tolist(), ids[other[hits >= plan.threshold]].tolist(), strict=True):
                    forest.join(a, b)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None

        def out() -> pa.RecordBatch:
            edges = forest.edges()
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            own = [batch.column(k).to_numpy() for k in range(3)]
            own.append(np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.int8).reshape(-1, LINES).astype(np.int16))
            if held is not None:
                own = [np.concatenate((h, o)) for h, o in zip(held, own, strict=True)]
            # the last key may go on in the next batch
            cut = int(np.flatnonzero(own[0] != own[0][-1])[-1]) + 1 if len(own[0]) and (own[0] != own[0][-1]).any() else 0
            held = [o[cut:] for o in own]
            pairs(*(o[:cut] for o in own), forest)
            if len(forest.up) > 500_000:
                yield out()
                forest = Forest()
        if held is not None:
            pairs(*held, forest)
        yield out()

    return rows


def connected(near: np.ndarray) -> Iterator[np.ndarray]:
    """The members of each connected set of a symmetric matrix, whole rows at a time; lone ones are left out."""
    open_ = near.any(axis=1)
    while open_.any():
        members = np.zeros(len(near), dtype=bool)
        edge = np.array([int(open_.argmax())])
        members[edge] = True
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & ~members)
            members[edge] = True
        open_ &= ~members
        yield np.flatnonzero(members)


def compared(least: float):
    """Links of a block's vectors, or between two blocks': their number by vector, and edges that connect them."""

    def rows(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, times = np.array(table.column("id").to_pylist()), np.array(table.column("times").to_pylist(), dtype=np.int64)
        side = np.array(table.column("side").to_pylist())
        links, up = np.zeros(len(ids), dtype=np.int64), ids.astype(np.int64)
        for places, unit in usable(table.column("embedding").chunk(0)):
            own, n = side[places], times[places]
            near = unit @ unit.T >= least
            if (own >= 0).all():
                near &= own[:, None] != own[None, :]
            np.fill_diagonal(near, False)
            links[places] = near @ n
            for members in connected(near):
                up[places[members]] = ids[places[members]].min()
        return pa.table({"id": pa.array(ids, pa.int64()), "up": pa.array(up), "links": pa.array(links)})

    return rows


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", least: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id) of every row: vectors linked directly, and the least id reachable by links."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0)
    whole = rows.where(good).withColumn("same", F.xxhash64("embedding"))
    classes = written(whole.groupBy("same", "embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("times")), "vectors")
    plan = Plan(classes.count(), least)

    met = written(entries(classes, plan), "projections")
    keys = written(met.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1"), "cells")
    crowds = met.select("key", "id").join(keys.where(F.col("n") > CROWD), "key").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    few = met.join(keys.where(F.col("n") <= CROWD).select("key"), "key").repartition(F.col("key")).sortWithinPartitions("key", "along")
    near = few.select("key", "id", "along", "sketch").mapInArrow(counted(plan), "a long, b long")
    group = written(components(near.unionByName(crowds)), "candidates")

    sizes = written(group.groupBy("component").count(), "group-sizes")
    total = sizes.where(F.col("count") <= block).agg(F.sum("count")).first()[0] or 0
    member = (
        group.join(sizes, "component")
        .withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(max(1, total // block)))).otherwise(F.xxhash64("component", "lo", "hi")))
        .withColumn("side", F.when(F.col("lo") == F.col("hi"), -1).otherwise((F.col("own") == F.col("hi")).cast("int")))
        .select("id", "task", "side")
    )
    found = written(classes.join(member, "id").select("id", "embedding", "times", "task", "side").groupBy("task").applyInArrow(compared(least), "id long, up long, links long"), "links")
    linked = components(found.select(F.col("id").alias("a"), F.col("up").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "id", "left").join(linked, "id", "left").select("same", F.col("embedding").alias("vector"), "times", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    named = written(named, "named")
    of_class = named.select("same", "vector", "times", "links", "component")
    keyed = rows.withColumn("same", F.when(good, F.xxhash64("embedding")))
    out = keyed.join(of_class, (keyed["same"] == of_class["same"]) & (keyed["embedding"] == of_class["vector"]), "left")
    return out.select("vec_id", F.coalesce(F.col("times") - 1 + F.col("links"), F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
