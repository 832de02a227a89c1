"""Patterns evaluated key by key with the exact matcher, for what has no plan of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.plans.compiler import Unsupported, compile_ends, compile_event
from wayline.plans.events import Event
from wayline.plans.matcher import Match, Matcher
from wayline.plans.matches import observed_once
from wayline.session import written


def completion_schema(event: Event) -> str:
    roles = ", ".join(f"{r.lower()} string" for r in event.pattern.role_names())
    return "event string, matched_at timestamp_ntz, completed_at timestamp_ntz, matched_source string, predicate string" + (f", {roles}" if roles else "")


def _dealt(event: Event, matches: DataFrame, key: str | None) -> DataFrame:
    """The matches that the event uses, by key and in order."""
    rows = observed_once(matches)
    if key is None:
        common = event.common_roles()
        if not common:
            raise Unsupported("no role is common to all leaves: name a column to evaluate by, or a horizon for a plan of joins")
        names = {(x.predicate, a) for x in event.pattern.leaves() for a, r in x.roles if r == common[0]}
        by = F.coalesce(*(F.when(F.col("predicate") == p, F.col("arguments")[a]) for p, a in sorted(names)))
    else:
        by = F.col(key).cast("string")
    used = sorted({x.predicate for x in event.pattern.leaves()})
    keyed = rows.where(F.col("predicate").isin(used)).withColumn("__key", by).where(F.col("__key").isNotNull())
    return keyed.select("__key", "t", "seq", "predicate", "source", "confidence", "arguments", "classes").repartition(F.col("__key")).sortWithinPartitions("__key", "t", "seq")


def _at(t: int) -> pd.Timestamp:
    return pd.Timestamp(t, unit="us")


def match_by_key(event: Event, matches: DataFrame, key: str | None = None) -> DataFrame:
    """Occurrences among matches of equal key: a column, or the role that all leaves carry.

    The stream of a key is read in (time, arrival) order, sorted by Spark; a key's candidates are the state.
    """
    roles = event.pattern.role_names()
    names = ["event", "matched_at", "completed_at", "matched_source", "predicate", *(r.lower() for r in roles)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, matcher = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if matcher is None or r[0] != current:
                    current, matcher = r[0], Matcher(event, in_order=True)
                for c in matcher.feed(Match(r[1], r[2], r[3], r[4], r[5], dict(r[6]), dict(r[7]))):
                    out.append((event.name, _at(c.matched_at), _at(c.completed_at), c.matched_source, c.predicate, *(c.bindings.get(x) for x in roles)))
            yield pd.DataFrame(out, columns=names)

    return _dealt(event, matches, key).mapInPandas(run, completion_schema(event))


def progress_by_key(event: Event, matches: DataFrame, horizon_ms: int | None = None) -> DataFrame:
    """Where each key stands after its last match: one row per open candidate, and the counts of the key's others.

    The key is the role that all leaves carry; without one there is one key, null. expired counts the candidates whose
    window has passed, failures the nodes (by their path of child numbers) whose window that was, why and how often.
    late is 0, as a table has no late matches.
    """
    total = sum(1 for _ in event.pattern.leaves())
    every = written(compile_ends(event, matches, horizon_ms).where("status <> 'used'"), "ends")
    ended = every.where("status <> 'open'").groupBy("key", "status", "reason").agg(F.count("*").cast("int").alias("n"))
    why = F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", F.concat_ws(" ", "reason", "n"))))
    of = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0)).cast("int").alias(status)
    counts = ended.groupBy(F.col("key").alias("of")).agg(of("completed"), of("expired"), F.array_sort(why).alias("why"))
    ids = F.concat_ws(",", *(F.concat(F.lit(f"{r}="), F.col(r.lower())) for r in sorted(event.pattern.role_names())))
    rows = every.where("status = 'open'")
    rows = rows.join(counts, rows["key"].eqNullSafe(counts["of"]), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("key", "matched_at", ids.alias("bindings"), "satisfied", (F.col("satisfied") / total).alias("fraction"), count("completed"), count("expired"), F.lit(0).alias("late"), F.coalesce(F.array_join("why.col2", ", "), F.lit("")).alias("failures"))


def failures(event: Event, matches: DataFrame, horizon_ms: int | None = None) -> DataFrame:
    """(state, satisfied, reason, n): how many candidates expired with which leaves met, and which window that was."""
    return compile_ends(event, matches, horizon_ms).where("status = 'expired'").groupBy("state", "satisfied", "reason").agg(F.count("*").alias("n"))


def occurrences(event: Event, matches: DataFrame, key: str | None = None, horizon_ms: int | None = None) -> DataFrame:
    """The event's occurrences: by joins where the pattern has such a plan, by keys otherwise.

    A pattern in which a leaf shares no role with what precedes it, and has no window either, needs a horizon: how long
    a candidate may live. Without one it goes by keys, if all leaves carry a role or the caller names a key.
    """
    try:
        return compile_event(event, matches, horizon_ms)
    except Unsupported:
        return match_by_key(event, matches, key)
