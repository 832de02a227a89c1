"""A store of intervals laid out by time: a segment lies in the partition of every bucket of time that it touches.

A store is a Parquet folder with segments' own columns (event_start, event_end, expires_at and a key among them), the
first bucket that a segment touches, and `bucket`, by which it is partitioned. One copy of a segment answers a question,
that of the first bucket which the segment and the question share, so no answer has to be made distinct. A question reads
the buckets of its interval only, and when segments expire the buckets that held them are rewritten. Times without a zone
are taken in the session's, which has to be the same at every call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.evidence import segments_touching
from wayline.session import written

DAY = 86_400


def _bucket(time: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("int")


def _laid_out(segments: DataFrame, seconds: int) -> DataFrame:
    """A copy for each bucket. What has a time missing, or ends before it starts, is no interval and is not stored.

    Segments are dealt out by the first bucket and copied where they are written, so that one copy of each is shuffled.
    """
    proper = segments.where("event_start <= event_end").withColumn("first_bucket", _bucket(F.col("event_start"), seconds))
    # one bucket may hold a third of all segments: adaptive execution deals a large one to several tasks
    dealt = proper.hint("rebalance", F.col("first_bucket"))
    return dealt.withColumn("bucket", F.explode(F.sequence("first_bucket", _bucket(F.col("event_end"), seconds))))


def _append(segments: DataFrame, path: str, seconds: int) -> None:
    _laid_out(segments, seconds).write.mode("append").partitionBy("bucket").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The store's segments, each once."""
    return spark.read.parquet(path).where("bucket = first_bucket").drop("bucket", "first_bucket")


def store_segments(segments: DataFrame, path: str, key: str, seconds: int = 30 * DAY) -> None:
    """A new store; of segments with one key one is taken. seconds is the length of a bucket, the same at every later call."""
    _append(segments.dropDuplicates([key]), path, seconds)


def add_segments(fresh: DataFrame, path: str, key: str, seconds: int = 30 * DAY) -> None:
    """Adds segments whose key the store does not have. Of the store the keys alone are read, and only files of the buckets
    that fresh segments touch are written. The store's files are listed before, so what is being added is not read."""
    keys = stored(fresh.sparkSession, path).select(key)
    _append(fresh.join(keys, key, "left_anti").select(fresh.columns).dropDuplicates([key]), path, seconds)


def segments_between(spark: SparkSession, path: str, start: Column, end: Column, how: str = "overlap", at: Column | None = None, seconds: int = 30 * DAY) -> DataFrame:
    """evidence.segments_touching on a store, from the partitions that can hold an answer."""
    low, high = _bucket(start, seconds), _bucket(end, seconds)
    copies = {
        "overlap": F.col("bucket").between(low, high) & (F.col("bucket") == F.greatest("first_bucket", low)),
        "contained": F.col("bucket").between(low, high) & (F.col("bucket") == F.col("first_bucket")),
        "covering": F.col("bucket") == low,
    }[how]
    return segments_touching(spark.read.parquet(path).where(copies), start, end, how, at).drop("bucket", "first_bucket")


def expire_segments(spark: SparkSession, path: str, at: Column) -> DataFrame:
    """Takes out what has expired at a time and returns it (each segment once).

    A bucket of which all has expired is dropped as a folder, one of which some has is rewritten; others are not touched.
    A run that is cut off may leave expired copies in some buckets, which the next run takes out.
    """
    rows = spark.read.parquet(path)
    gone = F.coalesce(F.col("expires_at") <= at, F.lit(False))
    expired = written(rows.where(gone & (F.col("bucket") == F.col("first_bucket"))).drop("bucket", "first_bucket"), "expired")
    kept = {r.bucket: r.kept for r in rows.groupBy("bucket").agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("gone")).where("gone > 0").collect()}
    some = [b for b, n in kept.items() if n]
    if some:
        left = written(rows.where(F.col("bucket").isin(some) & ~gone), "kept")
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for b in (b for b, n in kept.items() if not n):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
        folder.getFileSystem(conf).delete(folder, True)
    return expired
