"""Predicate matches, the one table that patterns run on, and the adapter from the events table.

matches(seq, t, predicate, source, confidence, provider, arguments map<string,string>, classes map<string,string>):
t is microseconds since the epoch; (t, seq) is the one total order; arguments hold object ids and echoed literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "seq long, t long, predicate string, source string, confidence double, provider string, arguments map<string,string>, classes map<string,string>"


def micros(column: Column | str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp") if isinstance(column, str) else column.cast("timestamp"))


def from_events(events: DataFrame, argument: str = "object") -> DataFrame:
    """The events table as matches: the type is the predicate, the user the object."""
    return events.select(
        F.col("event_id").alias("seq"),
        micros("ts").alias("t"),
        F.col("event_type").alias("predicate"),
        F.concat(F.lit("cam"), F.col("user_id") % 4).alias("source"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"),
        F.lit("events").alias("provider"),
        F.create_map(F.lit(argument), F.col("user_id").cast("string")).alias("arguments"),
        F.create_map().cast("map<string,string>").alias("classes"),
    )


def observed_once(matches: DataFrame) -> DataFrame:
    """Repeated observations (predicate, time, source, arguments) count once: the first to arrive."""
    entries = F.to_json(F.array_sort(F.map_entries("arguments")))
    first = Window.partitionBy("predicate", "t", "source", "__entries").orderBy("seq")
    return matches.withColumn("__entries", entries).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__entries", "__n")
