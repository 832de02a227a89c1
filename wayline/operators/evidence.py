"""Gates, history, scoring and summaries: windows, interval predicates and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.operators.restarts import beside, bucket_width, running

def gated(rows: DataFrame, level: Column, on: float, off: float, key: str = "source", order: str = "t") -> DataFrame:
    """Rows let through by a gate that opens at `on` or more and closes at `off` or less, per key."""
    signal = F.when(level >= on, F.lit(True)).when(level <= off, F.lit(False))
    state = F.last(signal, ignorenulls=True).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("__open", F.coalesce(state, F.lit(False))).where("__open").drop("__open")


def frame_levels(frames: DataFrame, key: str = "source", order: str = "t", cells: int = 64) -> DataFrame:
    """frames (key, order, pixels, height, width) with level: how much a frame differs from the one before it, 0 to 1.

    pixels are values 0 to 255 row by row, each pixel's channels together; at most the first three count, by their mean.
    About `cells` rows and columns of a frame are compared, by the mean of the absolute differences. A first frame, one of
    another shape than the one before, and one whose pixels are null or fewer than its shape needs have level 0. Frames are
    put beside one another by buckets of time; order is a number.
    """
    h, w = F.col("height").cast("int"), F.col("width").cast("int")
    channels = F.floor(F.try_divide(F.size("pixels"), h * w)).cast("int")
    down, across = (F.greatest(F.lit(1), F.floor(x / cells).cast("int")) for x in (h, w))
    shade = lambda r, c: F.aggregate(F.slice("pixels", (r * w + c) * channels + 1, F.least(channels, F.lit(3))), F.lit(0.0), lambda a, x: a + x.cast("double"), lambda a: a / F.least(channels, F.lit(3)))
    rows = F.transform(F.sequence(F.lit(0), h - 1, down), lambda r: F.transform(F.sequence(F.lit(0), w - 1, across), lambda c: shade(r, c)))
    whole = (h > 0) & (w > 0) & (F.size("pixels") > 0) & (channels > 0)
    seen = frames.withColumn("__seen", F.when(whole, F.struct(h.alias("h"), w.alias("w"), F.flatten(rows).alias("thumb"))))
    pairs = beside(seen, [key], order, bucket_width(seen, order), {"__was": "__seen"})
    differ = F.aggregate(F.zip_with("__seen.thumb", "__was.thumb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, x: a + x) / F.size("__seen.thumb") / 255
    same = (F.col("__seen.h") == F.col("__was.h")) & (F.col("__seen.w") == F.col("__was.w"))
    return pairs.withColumn("level", F.when(same, differ).otherwise(0.0)).drop("__seen", "__was")


def gated_by_time(rows: DataFrame, level: Column, on: float, off: float, key: str = "source", order: str = "t") -> DataFrame:
    """gated by buckets of time, so that no task sorts a whole source. order is a number; of rows at one time an opening
    one comes last. off must be below on."""
    if not 0 <= off < on:
        raise ValueError("a gate's lower threshold must be below its upper one, and neither negative")
    signal = F.when(level >= on, F.lit(True)).when(level <= off, F.lit(False))
    latest = F.when(signal.isNotNull(), F.struct(F.col(order).alias("at"), signal.alias("open")))
    return running(rows, [key], order, bucket_width(rows, order), "__state", latest).where("__state.open").drop("__state")


def sampled(rows: DataFrame, per_second: float, key: str = "source") -> DataFrame:
    """Rows of each key at most so often: each is let through that comes 1 / per_second seconds (t in microseconds) or
    more after the last one that was."""
    from wayline.operators.sequential import suppressed_repeats

    return suppressed_repeats(rows, key, round(1_000_000 / per_second))


def tumbling(rows: DataFrame, samples: str, rate: int, window_ms: int = 1000) -> DataFrame:
    """Fixed windows over each row's samples: source, t and the array are replaced by one row a window."""
    size = rate * window_ms // 1000
    starts = F.sequence(F.lit(0), F.size(samples) - 1, F.lit(size))
    cut = rows.where(F.size(samples) > 0).withColumn("__at", F.explode(starts))
    return cut.withColumn(samples, F.slice(samples, F.col("__at") + 1, F.lit(size))).withColumn("t", F.col("t") + (F.col("__at") * 1_000_000 / rate).cast("long")).drop("__at")


def latest_per_stream(left: DataFrame, right: DataFrame, key: str, value: str, tolerance_us: int | None = None) -> DataFrame:
    """Each left row (key, t) with right's latest value at or before it: one sort by key and time, no range join."""
    own = left.select(key, "t", F.lit(None).cast(right.schema[value].dataType).alias(value), F.struct(*left.columns).alias("row"), F.lit(None).cast("long").alias("since"))
    other = right.select(key, "t", value, F.lit(None).cast(own.schema["row"].dataType).alias("row"), F.col("t").alias("since"))
    back = Window.partitionBy(key).orderBy("t", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(other).withColumn("__v", F.last(F.when(F.col("row").isNull(), F.struct(value, "since")), ignorenulls=True).over(back))
    rows = both.where(F.col("row").isNotNull())
    fresh = F.lit(True) if tolerance_us is None else F.col("t") - F.col("__v.since") <= tolerance_us
    return rows.select("row.*", F.when(fresh, F.col(f"__v.{value}")).alias(value))


def with_recent_evidence(openers: DataFrame, evidence: DataFrame, lookback_us: int, key: str = "key") -> DataFrame:
    """Each opener (key, t, seq, ...) with the evidence (key, t, seq) that a stage opened by it takes.

    Evidence is kept for lookback_us behind the key's newest evidence. An opener takes the earliest that is kept when
    it comes, which may precede it, and else the first that follows; evidence_t and evidence_seq are null if there is
    none. (t, seq) is the order of both tables. One sort a key, no range join; a null key is a key.
    """
    kept = Window.partitionBy(key).orderBy("t").rangeBetween(-lookback_us, 0)
    held = evidence.select(key, "t", "seq", F.struct("t", "seq").alias("__own"), F.min(F.struct("t", "seq")).over(kept).alias("__kept"))
    own = openers.select(key, "t", "seq", F.struct(*openers.columns).alias("__row"))
    in_order = Window.partitionBy(key).orderBy("t", "seq", F.col("__row").isNotNull())
    before = F.last("__kept", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__own", ignorenulls=True).over(in_order.rowsBetween(0, Window.unboundedFollowing))
    both = own.unionByName(held, allowMissingColumns=True).withColumn("__e", F.coalesce(before, after))
    return both.where(F.col("__row").isNotNull()).select("__row.*", F.col("__e.t").alias("evidence_t"), F.col("__e.seq").alias("evidence_seq"))


def segments_touching(segments: DataFrame, start: Column, end: Column, how: str = "overlap", at: Column | None = None) -> DataFrame:
    """Stored segments (event_start, event_end, expires_at) that overlap an interval (half open), lie in it, or cover it."""
    a, b = F.col("event_start"), F.col("event_end")
    fits = {"overlap": (a < end) & (b > start), "contained": (a >= start) & (b <= end), "covering": (a <= start) & (b >= end)}[how]
    alive = F.lit(True) if at is None else F.col("expires_at").isNull() | (F.col("expires_at") > at)
    return segments.where(fits & alive)


def added(store: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The store with rows whose key it does not have; of several fresh rows of a key one is taken."""
    return store.unionByName(fresh.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(store.columns))


def binary_scores(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Counts of the four outcomes with precision and recall, null where undefined."""
    counts = rows.agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn"), F.count_if(~predicted & ~actual).alias("tn"))
    return counts.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})


def active_seconds(log: DataFrame, key: str, until: Column) -> DataFrame:
    """Seconds that each key was active, from a log (key, t, active) of changes; the last state lasts until `until`."""
    steps = log.withColumn("__next", F.coalesce(F.lead("t").over(Window.partitionBy(key).orderBy("t")), until))
    return steps.where("active").groupBy(key).agg((F.sum(F.col("__next") - F.col("t")) / 1_000_000).alias("active_seconds"), F.count("*").alias("starts"))


def condition_schedule(conditions: DataFrame) -> DataFrame:
    """Apply and restore steps (due_seconds, action, link) of conditions that start and, perhaps, end."""
    step = lambda due, action: F.struct(due.alias("due_seconds"), F.lit(action).alias("action"))
    ends = F.col("starts_at_seconds") + F.col("remains_for_seconds")
    steps = F.filter(F.array(step(F.col("starts_at_seconds"), "apply"), step(ends, "restore")), lambda s: s["due_seconds"].isNotNull())
    return conditions.withColumn("__s", F.explode(steps)).select("__s.due_seconds", "__s.action", F.col("affected_link_name").alias("link"))


def latest_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    last = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def counter_rates(samples: DataFrame, key: str, counter: str) -> DataFrame:
    """The rate of a growing counter between samples (key, t); a counter that fell has begun anew."""
    own = Window.partitionBy(key).orderBy("t")
    grown = F.col(counter) - F.lag(counter).over(own)
    return samples.withColumn("rate", F.when(grown >= 0, F.try_divide(grown.cast("double"), (F.col("t") - F.lag("t").over(own)) / 1_000_000)))


def leading(candidates: DataFrame, total: int) -> DataFrame:
    """Per event the candidate that is furthest: by share done, leaves met, completions (if there is such a column), then
    the earliest completion and seed."""
    share = F.col("satisfied") / total
    more = [F.desc_nulls_last("completed")] if "completed" in candidates.columns else []
    best = Window.partitionBy("event").orderBy(F.desc("fraction"), F.desc("satisfied"), *more, F.asc_nulls_last("completed_at"), "matched_at", "candidate")
    return candidates.withColumn("fraction", share).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def replayed(streams: dict[str, DataFrame], time: str = "t") -> DataFrame:
    """Several sources as one table in the order of event time, each row with the name of its stream."""
    named = [df.withColumn("stream", F.lit(name)) for name, df in sorted(streams.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named).orderBy(time, "stream")


def subscribed(rows: DataFrame, kinds: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """Rows (type, sources) that a subscriber gets: of the kinds asked for, and from no source but those allowed.

    None asks for anything. A row from no source passes any list of sources.
    """
    fits = F.lit(True) if kinds is None else F.col("type").isin(kinds)
    if sources is not None:
        fits = fits & (F.size(F.array_except("sources", F.lit(sources).cast("array<string>"))) == 0)
    return rows.where(fits)


def recorded(rows: DataFrame, kind: str, source: str = "source", time: str = "t") -> DataFrame:
    """Stream rows as evidence records (record_id, source_id, event_time, kind, payload): the payload is the row as JSON,
    and the id a hash of all of it, so that a row recorded twice has one id. Works on streams too."""
    payload = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    own = rows.select(F.col(source).cast("string").alias("source_id"), F.col(time).alias("event_time"), F.lit(kind).alias("kind"), payload.alias("payload"))
    return own.select(F.sha2(F.concat_ws("|", "source_id", F.col("event_time").cast("string"), "kind", "payload"), 256).alias("record_id"), "*")
