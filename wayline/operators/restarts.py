"""Restart points: where the state of a stream's operator is provably empty, so that segments can go to tasks of their own.

Rows that precede and follow a row, and running values, are found by buckets of time: each (key, bucket) is sorted for
itself, and what crosses buckets is carried over in a table of one row a bucket. No sort holds a whole stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that a bucket of time aims at, and the segment of rows that no restart point precedes.
ROWS, FIRST = 200_000, -(1 << 62)


def bucket_width(rows: DataFrame, time: str = "t") -> int | None:
    """The length of a bucket, in the unit of time, that holds ROWS rows on the average of all keys; None, which stands
    for one bucket, if there are no more than that."""
    low, high, n = rows.agg(F.min(time), F.max(time), F.count("*")).first()
    return None if n <= ROWS else max(1, (high - low + 1) * ROWS // n)


def _bucket(time: str, width: int) -> Column:
    return F.floor(F.col(time) / F.lit(width)).cast("long")


def _back(rows: DataFrame, carried: DataFrame, key: list[str]) -> DataFrame:
    """rows with what is carried into their bucket; null keys are keys."""
    named = carried.withColumnsRenamed({k: f"__{k}" for k in [*key, "__bucket"]})
    on = [rows[k].eqNullSafe(named[f"__{k}"]) for k in key] + [rows["__bucket"] == named["____bucket"]]
    return rows.join(named, on, "left").drop(*(f"__{k}" for k in key), "____bucket")


def beside(rows: DataFrame, key: list[str], time: str, width: int | None, before: dict[str, str] | None = None, after: dict[str, str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """rows with columns of the row before and of the row after, as new name -> column, in the order of time in each key.

    Rows of one time go by the columns ties; these have to come first in before and after, after time if that is there.
    """
    before, after = before or {}, after or {}
    last, first = (F.struct(F.col(time).alias("__at"), *(F.col(c).alias(n) for n, c in d.items())) for d in (before, after))
    own = rows.withColumns({"__last": last, "__first": first} | ({} if width is None else {"__bucket": _bucket(time, width)}))
    if width is None:
        here = Window.partitionBy(*key).orderBy(time, *(ties or []))
        return own.select(*rows.columns, *(F.lag("__last").over(here)[n].alias(n) for n in before), *(F.lead("__first").over(here)[n].alias(n) for n in after))
    edges = own.groupBy(*key, "__bucket").agg(F.max("__last").alias("__l"), F.min("__first").alias("__f"))
    along = Window.partitionBy(*key).orderBy("__bucket")
    carried = edges.select(*key, "__bucket", F.lag("__l").over(along).alias("__was"), F.lead("__f").over(along).alias("__next"))
    here = Window.partitionBy(*key, "__bucket").orderBy(time, *(ties or []))
    sides = {"__p": F.lag("__last").over(here), "__n": F.lead("__first").over(here)}
    out = _back(own.withColumns(sides), carried, key)
    found = {n: F.coalesce("__p", "__was")[n] for n in before} | {n: F.coalesce("__n", "__next")[n] for n in after}
    return out.select(*rows.columns, *(c.alias(n) for n, c in found.items()))


def running(rows: DataFrame, key: list[str], time: str, width: int | None, name: str, value: Column, how: Callable[[Column], Column] = F.max, back: bool = False) -> DataFrame:
    """rows with the max, min or sum of value over the key's rows up to this one's time, or from it on if back."""
    sign = -1 if back else 1
    if width is None:
        here = Window.partitionBy(*key).orderBy(F.col(time) * sign).rangeBetween(Window.unboundedPreceding, 0)
        found = how(F.col("__value")).over(here)
        return rows.withColumn("__value", value).withColumn(name, F.coalesce(found, F.lit(0)) if how is F.sum else found).drop("__value")
    own = rows.withColumns({"__bucket": _bucket(time, width), "__value": value})
    along = Window.partitionBy(*key).orderBy(F.col("__bucket") * sign).rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy(*key, "__bucket").agg(how(F.col("__value")).alias("__own")).select(*key, "__bucket", how(F.col("__own")).over(along).alias("__carried"))
    here = Window.partitionBy(*key, "__bucket").orderBy(F.col(time) * sign).rangeBetween(Window.unboundedPreceding, 0)
    out = _back(own.withColumn("__here", how(F.col("__value")).over(here)), carried, key)
    both = {F.max: F.greatest("__here", "__carried"), F.min: F.least("__here", "__carried"), F.sum: F.coalesce("__here", F.lit(0)) + F.coalesce("__carried", F.lit(0))}[how]
    return out.select(*rows.columns, both.alias(name))


def onward(rows: DataFrame, key: list[str], time: str, ties: list[Column], width: int | None, values: dict[str, Column]) -> DataFrame:
    """rows with the least of each value over a row and those after it in its key, in the order of time and then ties.

    Of values that grow along that order this is the next one that is not null.
    """
    own = rows.withColumns({f"__v{k}": v for k, v in enumerate(values.values())})
    order = [F.desc(time), *(c.desc() for c in ties)]
    least = lambda w, k: F.min(f"__v{k}").over(w.rowsBetween(Window.unboundedPreceding, 0))
    if width is None:
        here = Window.partitionBy(*key).orderBy(*order)
        return own.withColumns({n: least(here, k) for k, n in enumerate(values)}).select(*rows.columns, *values)
    own = own.withColumn("__bucket", _bucket(time, width))
    later = Window.partitionBy(*key).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = own.groupBy(*key, "__bucket").agg(*(F.min(f"__v{k}").alias(f"__f{k}") for k in range(len(values))))
    carried = firsts.select(*key, "__bucket", *(F.min(f"__f{k}").over(later).alias(f"__c{k}") for k in range(len(values))))
    here = Window.partitionBy(*key, "__bucket").orderBy(*order)
    out = _back(own.withColumns({n: least(here, k) for k, n in enumerate(values)}), carried, key)
    return out.select(*rows.columns, *(F.coalesce(n, f"__c{k}").alias(n) for k, n in enumerate(values)))


def clocked(frames: DataFrame, width: int | None) -> DataFrame:
    """(source, t, before, after) of all frames: the times of the frames beside each."""
    return beside(frames.select("source", "t").distinct(), ["source"], "t", width, {"before": "t"}, {"after": "t"})


def segments_of_frames(tracks: DataFrame, frames: DataFrame, empty_before: Column) -> DataFrame:
    """(source, t, segment) of all frames: segment is the time of the latest restart point up to it, FIRST before any.

    empty_before tells of a frame with tracks whether an operator's state is empty when it comes. It may use t, before
    (the frame before it), was (the last frame with tracks before it), was_after (the frame after that one), and n and
    was_n, the numbers of the frame and of that frame. A source in which it is never true stays one segment.
    """
    width = bucket_width(frames)
    ticks = running(clocked(frames, width), ["source"], "t", width, "n", F.lit(1).cast("long"), F.sum)
    full = ticks.join(tracks.select("source", "t").distinct(), ["source", "t"])
    seen = beside(full, ["source"], "t", width, {"was": "t", "was_after": "after", "was_n": "n"})
    points = seen.where(F.coalesce(empty_before, F.lit(False))).select("source", "t", F.col("t").alias("point"))
    marked = ticks.select("source", "t").join(points, ["source", "t"], "left")
    return running(marked, ["source"], "t", width, "__s", F.col("point")).select("source", "t", F.coalesce("__s", F.lit(FIRST)).alias("segment"))


def segments_of_rows(rows: DataFrame, key: list[str], quiet_us: int, time: str = "t") -> DataFrame:
    """rows with segment, the time of the latest row that comes quiet_us or more after the one before it, FIRST before any."""
    width = bucket_width(rows, time)
    begun = beside(rows, key, time, width, {"__t": time})
    point = F.when(F.col(time) - F.col("__t") >= quiet_us, F.col(time))
    return running(begun, key, time, width, "segment", point).drop("__t").withColumn("segment", F.coalesce("segment", F.lit(FIRST)))


def cuts(segmented: DataFrame, key: list[str]) -> DataFrame:
    """(key, segments, longest, rows): how each stream is cut; longest is its largest segment's rows. A stream of one
    segment could not be cut and stays one task's work."""
    sizes = segmented.groupBy(*key, "segment").agg(F.count("*").alias("own"))
    return sizes.groupBy(*key).agg(F.count("*").alias("segments"), F.max("own").alias("longest"), F.sum("own").alias("rows"))
