"""Streams of candidates against the exact matcher, and what a micro-batch touches of a key's state."""

import json
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_patterns import S, event, exact, inside, one, random_rows, rows_of

from wayline.plans.matches import SCHEMA
from wayline.streaming.candidates import _Candidates, replayed_matches

PATTERNS = [
    {"seq": [one("a", "X"), inside("20s", one("b", "X"))]},
    {"seq": [one("a", "X"), inside("90s", {"all": [one("b", "X"), {"seq": [one("c", "X"), one("a", "X")]}]}, "1s")]},
]


@pytest.mark.parametrize("k", range(len(PATTERNS)))
def test_streams_of_candidates_give_what_batches_give(spark, k):
    e, rows = event(PATTERNS[k]), random_rows(k + 9)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("who", F.col("arguments")["object"]).where("who IS NOT NULL")
    out = replayed_matches(e, df, "who", 3)
    want = exact(e, rows)
    assert sorted(rows_of(e, out.where("late IS NULL"))) == sorted(want) and want
    assert out.where("late IS NOT NULL").count() == 0


class Held:
    """A state variable that counts what is read and written."""

    def __init__(self):
        self.held, self.touched = {}, 0

    def _at(self, key):
        self.touched += 1
        return key

    def containsKey(self, key):  # noqa: N802
        return self._at(key) in self.held

    def getValue(self, key):  # noqa: N802
        return self.held.get(self._at(key))

    def updateValue(self, key, value):  # noqa: N802
        self.held[self._at(key)] = value

    def removeKey(self, key):  # noqa: N802
        self.held.pop(self._at(key), None)

    def get(self):
        return self.held.get(None)

    def update(self, value):
        self.held[None] = value

    def clear(self):
        self.held.clear()


def processor(e, lives):
    states, timers = {}, []
    handle = SimpleNamespace(getMapState=lambda name, *_: states.setdefault(name, Held()), getValueState=lambda name, *_: states.setdefault(name, Held()), registerTimer=timers.append)
    names = ["event", "matched_at", "completed_at", "matched_source", "predicate", *(r.lower() for r in e.pattern.role_names()), "late"]
    p = _Candidates(e, names, lives, 1000 * S)
    p.init(handle)
    return p, states, timers


def fed(p, rows):
    out = list(p.handleInputRows(("k",), iter([pd.DataFrame(rows, columns=["seq", "t", "predicate", "source", "confidence", "provider", "arguments", "classes"])]), None))
    return pd.concat(out) if out else None


def test_a_batch_costs_what_it_touches():
    e = event({"seq": [one("a", "X"), inside("1000s", {"any": [one("b", "X"), {"seq": [one("c", "Y"), one("b", "Y")]}]})]})
    p, states, timers = processor(e, 1000 * S)
    fed(p, [(k, k * S // 10, "a", "s", 1.0, "t", {"object": f"x{k}"}, {}) for k in range(3000)])
    assert len(states["candidates"].held) == 3000 and len(timers) <= 2
    for s in states.values():
        s.touched = 0
    fed(p, [(5000, 301 * S, "a", "s", 1.0, "t", {"object": "new"}, {})])  # nobody waits for it
    assert states["candidates"].touched <= 2 and states["lists"].touched <= 8
    out = fed(p, [(5001, 302 * S, "b", "s", 1.0, "t", {"object": "x7"}, {})])
    assert list(out["x"]) == ["x7"] and len(states["candidates"].held) == 3000
    for t in sorted(set(timers)):
        list(p.handleExpiredTimer(("k",), None, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)))
    assert not states["candidates"].held and not states["lists"].held and not states["known"].held


def test_late_matches_are_counted_and_offered():
    e = event({"seq": [one("a", "X"), inside("20s", one("b", "X"))]})
    p, states, _ = processor(e, 20 * S)
    assert fed(p, [(1, 10 * S, "a", "s", 1.0, "t", {"object": "x"}, {}), (2, 25 * S, "a", "s", 1.0, "t", {"object": "y"}, {})]) is None
    out = fed(p, [(3, 15 * S, "b", "s", 1.0, "t", {"object": "x"}, {}), (4, 9 * S, "b", "s", 1.0, "t", {"object": "x"}, {})])
    assert list(out["late"].dropna()) == [2] and list(out["x"].dropna()) == ["x"]
    assert json.loads(states["known"].held[None][0])[0] == 25 * S


def at(k, t, predicate, who="x"):
    return (k, t * S, predicate, "s", 1.0, "t", {"object": who}, {})


def watched(e, lives, slot_us):
    """A processor that forgets the timers that it deletes, and what fires those that the watermark has passed."""
    p, states, timers = processor(e, lives)
    p.slot_us, p.handle.deleteTimer = slot_us, timers.remove

    def passed(watermark_ms):
        for t in sorted(t for t in timers if t <= watermark_ms):
            list(p.handleExpiredTimer(("k",), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms), SimpleNamespace(getExpiryTimeInMs=lambda t=t: t)))
            timers.remove(t)

    return p, states, timers, passed


def test_a_key_with_little_open_is_one_value_and_one_timer():
    e = event({"seq": [one("a", "X"), inside("20s", one("b", "X"))]})
    p, states, timers, passed = watched(e, 20 * S, 10 * S)
    assert len(fed(p, [at(k, 7 * k, "ab"[k % 2]) for k in range(40)])) == 20  # over 28 slots
    assert states["candidates"].touched == states["lists"].touched == 0 and len(timers) == 1
    fed(p, [at(50, 290, "a")])
    assert len(timers) == 1 and "[273000000" not in states["known"].held[None][0]
    assert list(fed(p, [at(51, 309, "b")])["matched_at"]) == [pd.Timestamp(290, unit="s")]
    assert states["candidates"].touched == states["lists"].touched == 0 and len(timers) == 1
    passed(400_000)
    assert not states["known"].held and not timers


@pytest.mark.parametrize("kept", [0, 3, 12])
@pytest.mark.parametrize("k", range(len(PATTERNS)))
def test_keys_go_from_a_value_to_maps_and_back(monkeypatch, k, kept):
    from wayline.streaming import candidates

    monkeypatch.setattr(candidates, "KEPT", kept)
    e, lives = event(PATTERNS[k]), (20 + 90 * k) * S
    rows = [r for r in sorted(random_rows(k + 9), key=lambda r: (r[1], r[0])) if r[6].get("object")]
    p, states, timers, passed = watched(e, lives, lives // 2)
    out, spilled = [], 0
    for i in range(0, len(rows), 4):
        found = fed(p, rows[i : i + 4])
        out += [] if found is None else [tuple(x) for x in found[["matched_at", "completed_at", "matched_source", "x"]].itertuples(index=False)]
        spilled += bool(states["candidates"].held)
        passed(rows[min(i + 3, len(rows) - 1)][1] // 1000)
    want = exact(e, rows)
    assert len(out) == len(set(out)) == len(want) and want
    assert spilled or kept == 12
    passed(1 << 50)
    assert not any(s.held for s in states.values()) and not timers


def test_a_window_that_opens_after_the_others_have_closed_is_waited_for():
    e = event({"seq": [one("a", "X"), {"any": [inside("10s", one("b", "X")), inside("30s", one("c", "X"), "20s")]}]})
    p, _, _, passed = watched(e, 30 * S, 15 * S)
    assert fed(p, [at(1, 1, "a")]) is None
    passed(18_000)
    assert list(fed(p, [at(2, 26, "c")])["x"]) == ["x"]


def test_parts_of_several_files_are_one_micro_batch_each(spark, monkeypatch):
    from wayline.streaming import candidates

    monkeypatch.setattr(candidates, "FILE_ROWS", 10)
    e, rows = event(PATTERNS[0]), random_rows(9)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("who", F.col("arguments")["object"]).where("who IS NOT NULL")
    out = replayed_matches(e, df, "who", 3)
    assert out.where("late IS NOT NULL").count() == 0 and sorted(rows_of(e, out)) == sorted(exact(e, rows))
    assert replayed_matches(e, df.limit(0), "who", 3).count() == 0
