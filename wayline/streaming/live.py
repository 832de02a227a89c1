"""Patterns on streams: the exact matcher as a stateful operator, keyed, with a watermark for what is late."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayline.operators.matching import completion_schema
from wayline.plans.events import Event, longest_ms
from wayline.plans.matcher import Match, Matcher


def match_stream(event: Event, matches: DataFrame, key: str, lateness: str = "0 seconds", forget_us: int | None = None) -> DataFrame:
    """Occurrences as they complete, from a stream of matches with an event-time column `time` besides their own.

    Matches of a key are sorted within a micro-batch; a match older than the key's clock, but not than the watermark, is
    still offered to candidates that are not newer than it, as in batch. What the watermark has passed can neither be
    repeated nor completed and is dropped, and an event-time timer drops the state of a key from which nothing more has
    come for as long as any candidate lives. For patterns without a bound forget_us gives it: candidates and repeats
    older than that go, a deviation that the caller asks for; without it their state has no timer.
    """
    roles = event.pattern.role_names()
    names = ["event", "matched_at", "completed_at", "matched_source", "predicate", *(r.lower() for r in roles)]
    bound = longest_ms(event.pattern)
    lives_us = bound * 1000 if bound is not None else forget_us

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        matcher = Matcher(event)
        if state.exists:
            matcher.load(state.get[0])
        out = []
        rows = pd.concat(list(batches)).sort_values(["t", "seq"], kind="stable")
        for r in rows.itertuples(index=False):
            for c in matcher.feed(Match(int(r.t), int(r.seq), r.predicate, r.source, float(r.confidence), dict(r.arguments), dict(r.classes))):
                at = [pd.Timestamp(t, unit="us") for t in (c.matched_at, c.completed_at)]
                out.append((event.name, *at, c.matched_source, c.predicate, *(c.bindings.get(x) for x in roles)))
        watermark_us = state.getCurrentWatermarkMs() * 1000
        matcher.forget_before(watermark_us)
        if bound is None and forget_us is not None:
            matcher.candidates = [c for c in matcher.candidates if c.seed_t >= matcher.clock - forget_us]
        state.update((matcher.dump(),))
        if lives_us is not None:
            state.setTimeoutTimestamp(max(matcher.clock + lives_us, watermark_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=names)

    used = sorted({x.predicate for x in event.pattern.leaves()})
    timed = matches.where(F.col("predicate").isin(used)).withWatermark("time", lateness)
    return timed.groupBy(key).applyInPandasWithState(run, completion_schema(event), "matcher binary", "append", GroupStateTimeout.EventTimeTimeout)


def first_observations(matches: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Repeated observations on a stream count once, as long as the watermark keeps them."""
    return matches.withColumn("entries", F.to_json(F.array_sort(F.map_entries("arguments")))).withWatermark("time", lateness).dropDuplicatesWithinWatermark(["predicate", "t", "source", "entries"]).drop("entries")
