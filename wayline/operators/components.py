"""Connected components of an edge table, by contraction on the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.session import written

#: Edges of which one task finishes the rest; more are contracted round by round.
FEW = 8000


class Forest:
    """Union-find over any ids; the root of a set is its least member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.up) if (r := self.find(x)) != x]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of stars that connect what a task's edges connect, a bounded number of vertices at a time."""
    forest = Forest()

    def out() -> pa.RecordBatch:
        a, b = zip(*e, strict=True) if (e := forest.edges()) else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > 1_000_000:
            yield out()
            forest = Forest()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of edges (a long, b long); component is the least id that it reaches.

    Each round replaces every vertex by the neighbour, or itself, that comes first in an order drawn anew for the
    round, which shrinks the graph by a constant factor; the replacements are written and followed at the end.
    Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    own = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    left = written(own.mapInArrow(_forests, "a long, b long"), "edges")
    maps: list[DataFrame] = []
    n = left.count()
    while n > FEW:
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c, k=len(maps): F.struct(F.xxhash64(c, F.lit(k)), c)
        first = both.groupBy(F.col("a").alias("id")).agg(F.min(order(F.col("b"))).alias("m")).select("id", F.least(F.struct(F.col("m.col1"), F.col("m.b").alias("b")), F.struct(F.xxhash64("id", F.lit(len(maps))).alias("col1"), F.col("id").alias("b")))["b"].alias("to"))
        maps.append(written(first, "contraction"))
        to = maps[-1]
        moved = left.join(to.select(F.col("id").alias("a"), F.col("to").alias("ta")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("tb")), "b")
        left = written(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").mapInArrow(_forests, "a long, b long"), "edges")
        n = left.count()
    rest = left.coalesce(1).mapInArrow(_forests, "a long, b long").select(F.col("a").alias("id"), F.col("b").alias("to"))
    if not maps:
        # every vertex is in the forest, but for the roots themselves
        return rest.select("id", F.col("to").alias("component")).union(rest.select(F.col("to").alias("id"), F.col("to").alias("component")).distinct())
    rest = written(rest, "contraction")
    labels = maps[0]
    for to in [*maps[1:], rest]:
        step = to.select(F.col("id").alias("to"), F.col("to").alias("next"))
        labels = written(labels.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to")), "labels")
    least = written(labels.groupBy("to").agg(F.min("id").alias("component")), "components")
    return labels.join(least, "to").select("id", "component")
