"""Patterns on streams with a state of candidates: each is an entry of its own, in lists by what it waits for.

A key's state in the store is
  * `candidates`: id -> seed, bindings and times, the id being these values themselves, so that equal ones are one;
  * `lists`: (predicate, slot) -> ids of the candidates that wait for the predicate and have their last chance in that
    slot of time, and (`*`, slot) -> occurrences told of;
  * `known`: the newest time, and which lists there are.
A match reads the lists of its predicate and the candidates in them; a new candidate writes itself and one list. Each
slot has one event-time timer, at which its lists go as they are. So a micro-batch costs what it touches, however much
else the key has open.

Each call to the store goes from Python to the executor and back, so a key with at most KEPT entries open has its lists in
`known` itself: one read and one write a micro-batch, and one timer, at the last slot. What the key's clock has passed is
left out when that is written. A key that has more goes over to the maps, until all that they hold is gone.

A match older than the key's clock, but not than the watermark, is offered to the candidates that are not newer than it,
and counted: rows with `late` tell how many there were. What the watermark has passed is dropped by Spark, which counts
it (numRowsDroppedByWatermark).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayline.operators.matching import completion_schema
from wayline.plans.events import Event, longest_ms
from wayline.plans.matcher import DONE, FAILED, Candidate, Match, Matcher
from wayline.session import scratch

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOLD, SLOTS = "*", 2
COLUMNS = ("t", "seq", "predicate", "source", "confidence", "arguments", "classes")
EPOCH = datetime(1970, 1, 1)
#: Entries in lists up to which a key's state is one value.
KEPT = 128
#: Rows of a micro-batch's file, about.
FILE_ROWS = 500_000


class _Store:
    """What a micro-batch reads and changes of a key's state: read once, written once, at the end."""

    def __init__(self, handle: _Candidates):
        self.of = handle
        known = handle.known.get()
        self.clock, there, held, self.timed = json.loads(known[0]) if known else (None, [], [], None)
        #: lists in the maps; without any, all are in `known`
        self.there: set[tuple[str, int]] = {tuple(x) for x in there}
        self.lists: dict[tuple[str, int], dict[str, None]] = {(name, slot): dict.fromkeys(ids) for name, slot, ids in held}
        self.candidates: dict[str, Candidate | None] = {}
        self.changed: set = set()

    def list(self, name: str, slot: int) -> dict[str, None]:
        at = (name, slot)
        if at not in self.lists:
            held = self.of.lists.getValue((f"{name}|{slot}",)) if at in self.there else None
            self.lists[at] = dict.fromkeys(json.loads(held[0])) if held else {}
        return self.lists[at]

    def candidate(self, key: str) -> Candidate | None:
        if key not in self.candidates:
            self.candidates[key] = _candidate(key) if not self.there or self.of.candidates.containsKey((key,)) else None
        return self.candidates[key]

    def put(self, c: Candidate, names: set[str], slot: int) -> None:
        key = _text(c)
        self.candidates[key] = c
        self.changed.add(key)
        for name in names:
            self.list(name, slot)[key] = None
            self.changed.add((name, slot))

    def drop(self, key: str) -> None:
        self.candidates[key] = None
        self.changed.add(key)

    def open(self, watermark_ms: int) -> dict[tuple[str, int], list[str]]:
        """The lists without what has gone on, and without slots that the clock, or for what was told the watermark, has passed."""
        out, of = {}, self.of
        for (name, slot), ids in self.lists.items():
            if name == TOLD:
                out[name, slot] = [] if of.timer(slot) <= watermark_ms else list(ids)
            else:
                out[name, slot] = [] if (slot + 1) * of.slot_us <= self.clock else [x for x in ids if self.candidates.get(x, x) is not None]
        return {at: ids for at, ids in out.items() if ids}

    def save(self, watermark_ms: int) -> None:
        if not self.there:
            lists = self.open(watermark_ms)
            if sum(map(len, lists.values())) <= KEPT:
                self.save_value(lists)
                return
            self.lists = {at: dict.fromkeys(ids) for at, ids in lists.items()}
            self.changed = set(lists)
            for at in lists:
                if at[0] != TOLD:
                    self.changed |= {x for x in self.lists[at] if self.candidate(x) is not None}
        of, fresh = self.of, set()
        for x in self.changed:
            if not isinstance(x, str):
                fresh.add(x)
                of.lists.updateValue((f"{x[0]}|{x[1]}",), (json.dumps(list(self.lists[x])),))
            elif self.candidates[x] is not None:
                of.candidates.updateValue((x,), (x,))
            else:
                of.candidates.removeKey((x,))
        for slot in {s for _, s in fresh} - {s for _, s in self.there} - {self.timed}:
            of.handle.registerTimer(of.timer(slot))
        of.known.update((json.dumps([self.clock, sorted(self.there | fresh), [], None]),))

    def save_value(self, lists: dict[tuple[str, int], list[str]]) -> None:
        of, last = self.of, max([self.clock // self.of.slot_us, *(slot for _, slot in lists)])
        if last != self.timed:
            if self.timed is not None:
                of.handle.deleteTimer(of.timer(self.timed))
            of.handle.registerTimer(of.timer(last))
        of.known.update((json.dumps([self.clock, [], [[*at, ids] for at, ids in lists.items()], last]),))


def _text(c: Candidate) -> str:
    return json.dumps([c.seed_t, c.seed_leaf, c.seed_source, c.bindings, c.hits, c.since])


def _candidate(text: str) -> Candidate:
    t, leaf, source, *maps = json.loads(text)
    return Candidate(t, leaf, source, *(tuple(tuple(x) for x in m) for m in maps))


class _Candidates(StatefulProcessor):
    def __init__(self, event: Event, names: list[str], lives_us: int | None, slot_us: int):
        self.event, self.names, self.lives, self.slot_us = event, names, lives_us, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.matcher = handle, Matcher(self.event)
        self.candidates = handle.getMapState("candidates", "id string", "value string")
        self.lists = handle.getMapState("lists", "list string", "ids string")
        self.known = handle.getValueState("known", "known string")
        self.roles = self.event.pattern.role_names()
        self.predicates = sorted({x.predicate for x in self.event.pattern.leaves()})

    def timer(self, slot: int) -> int:
        """Milliseconds at which a slot's last chances have passed."""
        return (slot + 1) * self.slot_us // 1000 + 1

    def place(self, store: _Store, c: Candidate, now: int) -> None:
        """A pending candidate, in the lists of what it may wait for until its last chance."""
        ends = None if self.lives is None else c.seed_t + self.lives
        _, _, waits = self.matcher.state(c, now)
        if waits and all(w.until is not None for w in waits):
            last = max(w.until for w in waits)
            if self.matcher.state(c, last + 1)[0] == FAILED:  # or else a window opens later
                ends = last if ends is None else min(ends, last)
        # windows that open or close later may bring other leaves: wait for all that the pattern has and it has not met
        hits = {k for k, _ in c.hits}
        names = {x.predicate for k, x in enumerate(self.matcher.leaves) if k not in hits}
        store.put(c, names, (1 << 40) if ends is None else max(ends, now) // self.slot_us)

    def fed(self, store: _Store, m: Match) -> list[tuple]:
        matcher, out = self.matcher, []
        late = store.clock is not None and m.t < store.clock
        store.clock = m.t if store.clock is None else max(store.clock, m.t)
        grown = []
        for slot in sorted({s for name, s in store.there | set(store.lists) if name == m.predicate}):
            ids = store.list(m.predicate, slot)
            for key in list(ids):
                c = store.candidate(key)
                if c is None:  # it has gone on since
                    del ids[key]
                    store.changed.add((m.predicate, slot))
                    continue
                if matcher.state(c, store.clock)[0] == FAILED or self.lives is not None and store.clock > c.seed_t + self.lives:
                    store.drop(key)
                    continue
                if m.t < c.seed_t:
                    continue
                branches = []
                for w in matcher.state(c, m.t)[2]:
                    fits = matcher.bound(matcher.leaves[w.leaf], m, c.bindings) if w.until is None or m.t <= w.until else None
                    if fits is not None:
                        branches.append(matcher._hit(c, w.leaf, w.sustained, m.t, fits))
                if branches and all(len(b.bindings) == len(c.bindings) for b in branches):
                    store.drop(key)
                grown += branches
        for leaf, sustained in matcher.first:
            fits = matcher.bound(matcher.leaves[leaf], m, ())
            if fits is not None:
                grown.append(matcher._hit(Candidate(m.t, leaf, m.source), leaf, sustained, m.t, fits))
        for c in grown:
            status, t, _ = matcher.state(c, m.t)
            if status == DONE:
                told = json.dumps([c.seed_leaf, c.seed_t, c.seed_source, c.bindings])
                slot = (1 << 40) if self.lives is None else (c.seed_t + self.lives) // self.slot_us
                if told not in store.list(TOLD, slot):
                    store.list(TOLD, slot)[told] = None
                    store.changed.add((TOLD, slot))
                    at = [EPOCH + timedelta(microseconds=x) for x in (c.seed_t, t)]
                    own = dict(c.bindings)
                    out.append((self.event.name, *at, c.seed_source, matcher.leaves[c.seed_leaf].predicate, *(own.get(r) for r in self.roles), None))
            elif status != FAILED:
                self.place(store, c, m.t)
        return out + ([None] if late else [])

    def told(self, rows: list[tuple], timerValues) -> list[tuple]:  # noqa: N803
        """What a micro-batch's rows of the present key complete, and how many of them were late."""
        store, out = _Store(self), []
        for t, seq, predicate, source, sure, arguments, classes in sorted(rows, key=lambda r: r[:2]):
            sure = float("nan") if sure is None else float(sure)
            out += self.fed(store, Match(int(t), int(seq), predicate, source, sure, dict(arguments), dict(classes)))
        store.save(timerValues.getCurrentWatermarkInMs() if timerValues else 0)
        done, late = [x for x in out if x is not None], sum(x is None for x in out)
        if late:
            done.append((self.event.name, *[None] * (len(self.names) - 2), late))
        return done

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        done = self.told([r for frame in rows for r in zip(*(frame[c] for c in COLUMNS), strict=True)], timerValues)
        if done:
            yield self.frame(done)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=self.names)
        return out.astype({"matched_at": "datetime64[us]", "completed_at": "datetime64[us]", "late": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The slots whose time has come go, with the candidates in their lists."""
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() if timerValues else 0)
        store = _Store(self)
        if not store.there:  # a value goes at its own timer
            if store.timed is not None and self.timer(store.timed) <= now:
                self.known.clear()
            return
        gone = {x for x in store.there if self.timer(x[1]) <= now}
        for name, slot in gone:
            for x in store.list(name, slot) if name != TOLD else ():
                self.candidates.removeKey((x,))
            self.lists.removeKey((f"{name}|{slot}",))
        if store.there - gone:
            self.known.update((json.dumps([store.clock, sorted(store.there - gone), [], None]),))
        else:
            self.known.clear()
        yield from ()

    def close(self) -> None:
        pass


class _CandidatesByRow(_Candidates):
    """The same on rows: most keys have a few in a micro-batch, for which a frame costs more than all else."""

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        row = Row(*self.names)
        yield from (row(*x) for x in self.told([tuple(r[c] for c in COLUMNS) for r in rows], timerValues))


def _used(event: Event) -> list[str]:
    return sorted({x.predicate for x in event.pattern.leaves()})


def match_candidates(event: Event, matches: DataFrame, key: str, lateness: str = "0 seconds", forget_us: int | None = None) -> DataFrame:
    """Occurrences as they complete, with a column `late`, from a stream of matches with an event-time column `time`.

    Columns as in matches of plans.matches; late is null in occurrences, and other rows count late matches. Repeats of an
    observation are to be dropped before (`live.first_observations`). Candidates of patterns without a bound stay until
    they are used, or for forget_us where the caller asks for that. The session's state store has to be RocksDB.
    """
    bound = longest_ms(event.pattern)
    lives = bound * 1000 if bound is not None else forget_us
    schema = completion_schema(event) + ", late long"
    names = [x.split()[0] for x in schema.split(", ")]
    timed = matches.where(F.col("predicate").isin(_used(event))).select(*dict.fromkeys((key, "time", *COLUMNS))).withWatermark("time", lateness)
    processor = _CandidatesByRow(event, names, lives, max((lives or 8_000_000) // SLOTS, 1000))
    return timed.groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="eventTime")


def replayed_matches(event: Event, matches: DataFrame, key: str, parts: int = 4, lateness: str = "1 minute", forget_us: int | None = None) -> DataFrame:
    """A table of matches as a stream: written as files in the order of time, read part by part until all are done.

    The files, the state and the output lie below the shared folder; the result is read from the output. Every part has as
    many files, by which the micro-batches are told apart: rows are dealt in turn, so that none of them is left without any.
    """
    spark = matches.sparkSession
    rows = matches.where(F.col("predicate").isin(_used(event)) & F.col("t").isNotNull()).withColumn("time", F.timestamp_micros("t"))
    spots = sorted(set(rows.approxQuantile("t", [k / parts for k in range(1, parts)], 0.01)))
    part = sum(((F.col("t") > s).cast("int") for s in spots), F.lit(0))
    sizes = dict(map(tuple, rows.groupBy(part.alias("part")).count().collect())) or {0: 0}
    files = max(1, min(sizes.values()) // FILE_ROWS)
    folder = scratch(spark, "stream")
    for k in sorted(sizes):
        rows.where(part == k).repartition(files).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    with _rocks(spark):
        out = match_candidates(event, stream, key, lateness, forget_us)
        run = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/out")
        run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


class _rocks:  # noqa: N801
    """The session's state store is RocksDB inside."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.was = self.spark.conf.get(PROVIDER, None)
        self.spark.conf.set(PROVIDER, ROCKS)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(PROVIDER, self.was) if self.was else self.spark.conf.unset(PROVIDER)
