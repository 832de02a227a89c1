"""Identity across sources: candidate pairs, greedy one-to-one choice, and merged identities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from wayline.functions.vectors import dot, norm, normalized
from wayline.operators.components import components
from wayline.session import written

#: Links of a component that one task takes in order.
LINKS = 200_000
#: The most centres that vectors are dealt to where times do not part them, and the least vectors of a block.
CENTRES, BLOCK = 256, 4096
#: Blocks grow with the table, to this share of it, but not beyond so many numbers: each vector goes to most blocks.
SHARE, NUMBERS = 16, 1 << 22
#: Radians by which rounding may move an angle.
SLACK = 1e-4


def association_candidates(vectors: DataFrame, gap_us: int | None, least: float = 0.75, pairs: list[tuple] | None = None) -> DataFrame:
    """Pairs (left_id, right_id, similarity) of vectors (object_id, source, t, model, vector) of different sources.

    Times are at most gap_us apart: slots as wide make the time condition a join key, and only one side is put into
    the neighbouring slots. None is an open gap: all times of a model may meet (see open_pairs). pairs, if given, are the
    pairs of sources, in either order, that may meet. Vectors are normalised once, before they are paired. Rows with a null
    id, source or model, and vectors with a component that is null or not finite, take no part.
    """
    rows = vectors.select("object_id", "source", "t", "model", normalized(F.col("vector")).alias("unit"), F.size("vector").alias("n"), norm(F.col("vector")).alias("norm"))
    known = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in ("object_id", "source", "model")))
    rows = rows.where(known & (F.col("n") > 0) & (F.col("norm") < float("inf"))).drop("norm")
    if gap_us is None:
        return open_pairs(rows, least, pairs)
    keys, near = ["model", "n"], (F.col("a.source") < F.col("b.source")) & (F.col("a.object_id") != F.col("b.object_id"))
    slot = F.floor(F.col("t") / F.lit(gap_us + 1))
    one = rows.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
    other, keys = rows.withColumn("slot", slot), [*keys, "slot"]
    near &= F.abs(F.col("a.t") - F.col("b.t")) <= gap_us
    if pairs is not None:
        allowed = [F.col("a.source").eqNullSafe(F.lit(x)) & F.col("b.source").eqNullSafe(F.lit(y)) for p, q in pairs for x, y in ((p, q), (q, p))]
        near &= reduce(lambda x, y: x | y, allowed, F.lit(False))
    a, b = one.alias("a"), other.alias("b")
    met = a.join(b, reduce(lambda x, y: x & y, (F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys), near))
    found = met.select(F.col("a.object_id").alias("left_id"), F.col("b.object_id").alias("right_id"), dot(F.col("a.unit"), F.col("b.unit")).alias("similarity"))
    return found.where(F.col("similarity") >= least)


def block_of(total: int, longest: int) -> int:
    """The vectors of a block, of so many vectors of at most so many numbers."""
    return max(BLOCK, min(-(-total // SHARE), NUMBERS // longest))


def open_pairs(rows: DataFrame, least: float, pairs: list[tuple] | None = None) -> DataFrame:
    """The pairs of association_candidates at any times, from rows (object_id, source, model, unit, n); none is missed.

    The vectors with the least hashes, one for a block of rows and at most CENTRES, are centres for their length; every vector is dealt to the cell of
    the nearest, and a cell's radius is the greatest angle in it. By the triangle inequality of angles, a vector's partners
    lie in cells whose centre is no further from it than the radius and the least similarity's angle together, and it goes
    to those alone. Cells are cut into blocks of BLOCK vectors, or a share of all, on both sides, a pair of blocks is a task's
    product, and what passes is summed again in the order of `dot`. Vectors without clusters meet all cells: then these are
    blocked products of all pairs, each vector sent once a block, of which there are no more for more vectors until a block
    has NUMBERS numbers. The driver holds the centres and a line for each cell.
    """
    if least > 0:  # a vector of length zero has no angle, and a similarity of 0 to all
        rows = rows.where(dot(F.col("unit"), F.col("unit")) > 0)
    rows = written(rows.select("object_id", "source", "model", "unit", "n"), "vectors")
    total, longest = rows.agg(F.count("*"), F.max("n")).first()
    block = block_of(total, longest or 1)
    few = min(CENTRES, 1 + total // block)
    drawn = rows.select("n", "unit", F.xxhash64("unit").alias("h")).distinct().orderBy("h").limit(few).collect()
    centres = {n: np.array([r.unit for r in drawn if r.n == n]) for n in {r.n for r in drawn}}

    def angles(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """A length, where in the batch its vectors are, and their angles to its centres."""
        sizes = batch.column("n").to_numpy()
        for n in np.unique(sizes):
            if n in centres:
                at = np.flatnonzero(sizes == n)
                units = batch.column("unit").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                yield n, at, np.arccos(np.clip(units @ centres[n].T, -1, 1))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, away = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            for _, at, angle in angles(batch):
                cells[at], away[at] = angle.argmin(1), angle.min(1)
            yield batch.append_column("cell", pa.array(cells)).append_column("angle", pa.array(away))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[list[int]] = [[-1]] * len(batch)
            for n, at, angle in angles(batch):
                # no angle is under a cell that nothing was dealt to
                within = np.array([radius.get((n, c), -10.0) for c in range(len(centres[n]))]) + reach
                for i, row in zip(at, angle <= within, strict=True):
                    lists[i] = np.flatnonzero(row).tolist()
            yield batch.append_column("cells", pa.array(lists, pa.list_(pa.int32())))

    fields = lambda name, kind: StructType([*rows.schema.fields, StructField(name, kind)])
    dealt = written(rows.mapInArrow(nearest, fields("cell", IntegerType()).add("angle", DoubleType())), "dealt")
    radius = {(r.n, r.cell): r.angle for r in dealt.groupBy("n", "cell").agg(F.max("angle").alias("angle")).collect()}
    # nothing is further than pi: a least similarity of 0 or less leaves no cell out
    reach = np.arccos(min(least, 1.0)) + SLACK if least > 0 else 10.0
    right = dealt.drop("angle")
    # the lists of cells are written, their copies of vectors are only dealt
    left = written(rows.mapInArrow(met, fields("cells", ArrayType(IntegerType()))), "meeting").withColumn("cell", F.explode("cells")).drop("cells")

    def blocks(side: DataFrame) -> Column:
        sizes = side.groupBy("n", "cell").count().where(F.col("count") > block).collect()
        known = [F.lit(x) for r in sizes for x in (f"{r.n}:{r.cell}", -(-r["count"] // block))]
        return F.coalesce(F.create_map(*known)[F.concat_ws(":", "n", "cell")], F.lit(1)).cast("int") if known else F.lit(1)

    salt, n_left, n_right = F.xxhash64("object_id", "source", "unit"), blocks(left), blocks(right)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = left.withColumn("p", F.pmod(salt, n_left).cast("int")).withColumn("q", every(n_right))
    right = right.withColumn("q", F.pmod(salt, n_right).cast("int")).withColumn("p", every(n_left))
    allowed = None if pairs is None else {p for x, y in pairs for p in ((x, y), (y, x))}

    def products(one: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ("left_id", "right_id", "similarity")})]
        if len(one) and len(other):
            a, b = np.stack(one["unit"].to_list()), np.stack(other["unit"].to_list())
            names = sorted(set(one["source"]) | set(other["source"]))
            number = {x: k for k, x in enumerate(names)}
            fits = np.array([[x < y and (allowed is None or (x, y) in allowed) for y in names] for x in names])
            sa, sb = (np.array([number[x] for x in side["source"]]) for side in (one, other))
            ia, ib = one["object_id"].to_numpy(), other["object_id"].to_numpy()
            step = max(1, 512 * 4096 // len(b))
            for at in range(0, len(a), step):
                i, j = np.nonzero((a[at : at + step] @ b.T >= least - 1e-9) & fits[sa[at : at + step]][:, sb])
                i, total = i + at, np.zeros(len(i))
                for k in range(a.shape[1]):
                    total += a[i, k] * b[j, k]
                keep = (total >= least) & (ia[i] != ib[j])
                out.append(pd.DataFrame({"left_id": ia[i[keep]], "right_id": ib[j[keep]], "similarity": total[keep]}))
        return pd.concat(out[1:] or out)

    key = ["model", "n", "cell", "p", "q"]
    kind = rows.schema["object_id"].dataType
    found = StructType([StructField("left_id", kind), StructField("right_id", kind), StructField("similarity", DoubleType())])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(products, found)


def one_to_one(candidates: DataFrame, most: int = LINKS) -> DataFrame:
    """Greedy choice by similarity, then ids: an object is taken once on the left and once on the right.

    What is taken in one connected component of the candidates (an object's left and right being two ends) does not touch
    another, so a component of at most `most` pairs is one task's work, in order, and a chain of any length in it costs no
    rounds. Larger components go round by round: all pairs that are the best of both ends are taken. Pairs with a null end
    take no part.
    """
    schema = candidates.select("left_id", "right_id", "similarity").schema
    end = lambda c: F.xxhash64(F.lit(c), F.col(c).cast("string"))
    linked = candidates.where("left_id IS NOT NULL AND right_id IS NOT NULL").groupBy("left_id", "right_id").agg(F.max("similarity").alias("similarity"))
    linked = written(linked.withColumn("a", end("left_id")), "pairs")
    groups = written(components(linked.select("a", end("right_id").alias("b"))), "groups")
    grouped = written(linked.join(groups.withColumnRenamed("id", "a"), "a"), "pairs")
    sizes = grouped.groupBy("component").count()
    large = written(sizes.where(F.col("count") > most).select("component"), "large")

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, left, right = None, set(), set()
        for batch in batches:
            kept = []
            for k, (group, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("component", "left_id", "right_id")), strict=True)):
                if group != own:
                    own, left, right = group, set(), set()
                if a not in left and b not in right:
                    left.add(a)
                    right.add(b)
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64())).select(["left_id", "right_id", "similarity"])

    order = [F.desc("similarity"), "left_id", "right_id"]
    # dealt by a hash: a shuffle by the join's own key would be left out, and adaptive execution may undo the join's
    small = grouped.join(large, "component", "left_anti").repartition(F.xxhash64("component")).sortWithinPartitions("component", *order)
    taken = small.select("component", "left_id", "right_id", "similarity").mapInArrow(greedy, schema)
    if not large.take(1):
        return taken
    left = written(grouped.join(large, "component", "left_semi").select("left_id", "right_id", "similarity"), "pairs")
    while left.take(1):
        ends = left.withColumn("end", F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).cast("string").alias("id")) for c in ("left_id", "right_id")))))
        best = ends.groupBy("end").agg(F.min_by(F.struct("left_id", "right_id"), F.struct(-F.col("similarity"), "left_id", "right_id")).alias("p"), F.max("similarity").alias("similarity"))
        both = written(best.groupBy("p", "similarity").count().where("count = 2").select("p.left_id", "p.right_id", "similarity"), "chosen")
        taken = taken.unionByName(both)
        rest = left.join(both.select("left_id"), "left_id", "left_anti").join(both.select("right_id"), "right_id", "left_anti")
        left = written(rest.select(schema.names), "pairs")
    return taken


def identities(seen: DataFrame, associations: DataFrame) -> DataFrame:
    """(object_id, canonical_id, conflict): merged objects take the id of the one that was seen first.

    seen has object_id, class, first_seen. A merge of different classes is marked as a conflict, not refused. Objects are
    numbered by their hashes for the components, which are joined to ids again; objects without links are on their own.
    """
    number = F.xxhash64(F.col("object_id").cast("string"))
    ids = seen.select("object_id", "first_seen", "class", number.alias("id"))
    edges = associations.select(F.xxhash64(F.col("left_id").cast("string")).alias("a"), F.xxhash64(F.col("right_id").cast("string")).alias("b"))
    # objects that are linked but were never seen have no part in naming
    named = written(ids.join(written(components(edges), "objects"), "id", "left").withColumn("group", F.coalesce("component", "id")), "grouped")
    groups = named.groupBy("group").agg(F.min(F.struct("first_seen", "object_id")).alias("root"), (F.count_distinct("class") > 1).alias("conflict"))
    return named.join(groups, "group").select("object_id", F.col("root.object_id").alias("canonical_id"), "conflict")


def recanonicalised(completions: DataFrame, roles: list[str], names: DataFrame) -> DataFrame:
    """Completions with canonical ids in their role columns; what is one occurrence then counts once, the earliest."""
    out = completions
    for role in roles:
        n = names.select(F.col("object_id").alias(role), F.col("canonical_id").alias("__c"))
        out = out.join(n, role, "left").withColumn(role, F.coalesce("__c", role)).drop("__c")
    keys = [c for c in completions.columns if c != "completed_at"]
    return out.groupBy(*keys).agg(F.min("completed_at").alias("completed_at")).select(completions.columns)
