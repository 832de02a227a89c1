import random
from collections import Counter
from datetime import datetime

import pytest

from wayline.operators import restarts
from wayline.operators.matching import match_by_key, occurrences
from wayline.plans.compiler import Unsupported, compile_ends, compile_event
from wayline.plans.events import longest_ms, parse_event
from wayline.plans.matcher import Match, Matcher, echoes
from wayline.plans.matches import SCHEMA

S = 1_000_000
SIGNATURES = {"a": "object: visual_object", "b": "object: visual_object", "c": "object: visual_object", "f": "x: visual_object, y: visual_object", "n": "class: audio_class"}


def event(pattern):
    return parse_event({"event": "e", "roles": {r: {"class": "vehicle"} for r in "XYZ"}, "pattern": pattern}, SIGNATURES, None)


def one(name, role):
    return {name: {"object": role}}


def two(x, y):
    return {"f": {"x": x, "y": y}}


def trace(text):
    """'0:a(x) 5:f(x,y)' as matches."""
    out = []
    for seq, part in enumerate(text.split()):
        t, _, call = part.partition(":")
        name, _, ids = call.rstrip(")").partition("(")
        ids = ids.split(",")
        out.append((seq, int(t) * S, name, "s", 1.0, "t", dict(zip(("x", "y"), ids, strict=True)) if name == "f" else {"object": ids[0]}, {}))
    return out


def exact(e, rows):
    matcher, out = Matcher(e), set()
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        for c in matcher.feed(Match(r[1], r[0], r[2], r[3], r[4], r[6], r[7])):
            out.add((c.matched_at, c.completed_at, c.matched_source, c.predicate, *(c.bindings.get(x) for x in e.pattern.role_names())))
    return out


def rows_of(e, df):
    us = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    return [(us(r.matched_at), us(r.completed_at), r.matched_source, r.predicate, *(r[x.lower()] for x in e.pattern.role_names())) for r in df.collect()]


GOLDEN = [
    ("0:a(x) 1:b(x) 2:b(x)", {"seq": [one("a", "X"), one("b", "X")]}, [1]),
    ("0:a(x) 1:b(y) 2:b(z)", {"seq": [one("a", "X"), one("b", "Y")]}, [1, 2]),
    ("0:a(x) 1:b(x)", {"seq": [one("a", "X"), one("b", "Y")]}, []),
    ("0:a(x) 300:b(y)", {"all": [one("a", "X"), one("b", "Y")]}, [300]),
    ("0:a(x) 301:b(y)", {"all": [one("a", "X"), one("b", "Y")]}, []),
    ("0:a(x) 3:f(x,y) 5:f(x,y) 6:f(x,y)", {"seq": [one("a", "X"), {"for": {"duration": "3s", "pattern": two("X", "Y")}}]}, [6]),
    ("0:a(x) 0:a(x)", one("a", "X"), [0]),
    ("0:a(v1) 5:a(v2) 12:b(p1)", {"seq": [one("a", "X"), {"within": {"max": "10s", "pattern": one("b", "Y")}}]}, [12]),
    ("0:a(x) 1:b(x) 4:b(x)", {"seq": [one("a", "X"), {"within": {"min": "3s", "max": "9s", "pattern": one("b", "X")}}]}, [4]),
    ("0:a(x) 2:c(x)", {"any": [one("a", "X"), one("b", "X")]}, [0]),
    ("0:a(x) 2:c(x) 3:b(x)", {"k_of_n": {"k": 2, "patterns": [one("a", "X"), one("b", "X"), one("c", "X")]}}, [2, 3]),
]


@pytest.mark.parametrize("text,pattern,times", GOLDEN)
def test_golden_traces(text, pattern, times):
    assert sorted(c[1] // S for c in exact(event(pattern), trace(text))) == times


PATTERNS = [
    {"seq": [one("a", "X"), {"within": {"max": "10s", "pattern": one("b", "Y")}}]},
    {"all": [one("a", "X"), two("X", "Y")]},
    {"all": [one("a", "X"), one("b", "X"), one("c", "X")]},
    {"seq": [one("a", "X"), {"within": {"max": "12s", "pattern": {"any": [one("b", "X"), one("c", "Y")]}}}]},
    {"seq": [one("a", "X"), {"within": {"max": "15s", "pattern": {"all": [one("b", "X"), one("c", "Y")]}}}]},
    {"k_of_n": {"k": 2, "patterns": [one("a", "X"), one("b", "Y"), one("c", "X")]}},
    {"seq": [one("a", "X"), {"for": {"duration": "5s", "pattern": two("X", "Y")}}]},
    {"seq": [one("a", "X"), {"within": {"max": "20s", "pattern": {"seq": [one("b", "X"), {"for": {"duration": "2s", "pattern": one("c", "X")}}]}}}]},
    {"seq": [{"all": [one("a", "X"), one("b", "Y")]}, {"within": {"max": "5s", "pattern": {"n": {"class": "alarm"}}}}, one("c", "X")]},
]


def random_rows(seed, n=120):
    dice, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += dice.choice([0, 1, 1, 2, 3]) * S
        name, ids = dice.choice("aabbccffn"), dice.sample("pqrs", 2)
        args = {"f": {"x": ids[0], "y": ids[1]}, "n": {"class": "alarm"}}.get(name, {"object": ids[0]})
        out.append((i, t, name, dice.choice(["s1", "s2"]), 1.0, "t", args, {}))
    return out


@pytest.mark.parametrize("k", range(len(PATTERNS)))
def test_plans_agree_with_the_exact_matcher(spark, k):
    e, rows = event(PATTERNS[k]), random_rows(k)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(rows_of(e, compile_event(e, df)), key=str) == sorted(exact(e, rows), key=str)
    if e.common_roles():
        assert set(rows_of(e, match_by_key(e, df))) == exact(e, rows)


def inside(most, pattern, least=None):
    return {"within": {"max": most, "pattern": pattern} | ({"min": least} if least else {})}


def lasting(how_long, pattern):
    return {"for": {"duration": how_long, "pattern": pattern}}


ALARM = {"n": {"class": "alarm"}}
#: The shapes of the acceptance cases, over the traces' predicates, and other nestings.
NESTED = {
    "convoy": {"seq": [one("a", "X"), {"all": [one("b", "X"), {"seq": [one("a", "Y"), {"all": [one("b", "Y"), {"seq": [one("a", "Z"), one("b", "Z")]}]}]}]}]},
    "rendezvous": {"seq": [one("a", "X"), {"any": [lasting("3s", two("Y", "Z")), {"g": {"x": "Y", "y": "Z"}}]}, one("c", "W")]},
    "alarm_or_shot": {"seq": [{"any": [{"n": {"class": "shot"}}, {"n": {"class": "alarm", "level": 0.4}}]}, inside("30s", one("b", "X"))]},
    "present_then_alarm": {"seq": [{"all": [one("a", "X"), one("a", "Y")]}, {"n": {"class": "alarm", "level": 0.4}}, inside("30s", one("b", "X"))]},
    "chase": {"seq": [one("a", "X"), lasting("3s", two("X", "Y"))]},
    "convergence": {"seq": [one("a", "X"), {"all": [two("X", "Y"), two("X", "Z"), two("Y", "Z")]}]},
    "same_predicate_bound_and_new": {"seq": [two("X", "Y"), {"all": [two("X", "Y"), two("X", "Z")]}]},
    "k_of_nested": {"k_of_n": {"k": 2, "patterns": [{"seq": [one("a", "X"), one("b", "X")]}, inside("9s", one("c", "X")), lasting("4s", two("X", "Y"))]}},
    "any_of_windows": {"seq": [one("a", "X"), {"any": [inside("5s", {"seq": [one("b", "X"), one("c", "X")]}), inside("20s", one("b", "Y"), "6s")]}, one("c", "X")]},
    "all_of_windows": {"seq": [one("a", "X"), {"all": [inside("8s", one("b", "X")), inside("20s", {"any": [one("c", "X"), two("X", "Y")]})]}]},
    "leading_window": {"seq": [inside("15s", {"seq": [one("a", "X"), one("b", "X")]}), one("c", "X")]},
    "sustained_then_more": {"seq": [lasting("2s", two("X", "Y")), inside("6s", one("a", "X"), "1s"), one("b", "Y")]},
    "windows_in_windows": {"seq": [one("a", "X"), inside("90s", {"seq": [inside("60s", one("b", "X"), "2s"), inside("50s", {"k_of_n": {"k": 2, "patterns": [one("a", "X"), one("b", "X"), one("c", "X")]}})]})]},
    "sustained_twice": {"seq": [one("a", "X"), {"all": [lasting("3s", two("X", "Y")), two("X", "Y")]}]},
}


def nested_event(pattern):
    signatures = SIGNATURES | {"g": "x: visual_object, y: visual_object", "n": "class: audio_class, level?: number 0..1"}
    return parse_event({"event": "e", "roles": {r: {"class": "vehicle"} for r in "WXYZ"}, "pattern": pattern}, signatures, None)


def nested_rows(seed, n=70):
    dice, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += dice.choice([0, 1, 1, 2, 4]) * S
        name, ids = dice.choice("aaabbbccffffgnn"), dice.sample("pqrs", 2)
        pair = {"x": ids[0], "y": ids[1]}
        args = {"f": pair, "g": pair, "n": {"class": dice.choice(["alarm", "alarm", "shot"])} | dice.choice([{}, {"level": "0.40"}, {"level": "0.5"}])}.get(name, {"object": ids[0]})
        out.append((i, t, name, dice.choice(["s1", "s2"]), 1.0, "t", args, {}))
    return out


@pytest.mark.parametrize("name", sorted(NESTED))
def test_nested_patterns_agree_with_the_exact_matcher(spark, name):
    """With a horizon longer than the trace, so that nothing ends early, and with a short one."""
    e = nested_event(NESTED[name])
    rows = [r for seed in range(2) for r in [(x[0] + 1000 * seed, x[1] + 10_000 * S * seed, *x[2:]) for x in nested_rows(seed + 40)]]
    want = exact(e, rows[:70]) | exact(e, rows[70:])
    got = rows_of(e, compile_event(e, spark.createDataFrame(rows, SCHEMA), 400_000))
    assert sorted(got, key=str) == sorted(want, key=str) and want
    short = set(rows_of(e, compile_event(e, spark.createDataFrame(rows, SCHEMA), 15_000)))
    assert {w for w in want if w[1] - w[0] <= 15 * S} >= short and short <= want


@pytest.mark.parametrize("k", [2, 6, 7])
def test_pointers_go_over_buckets_of_time(spark, monkeypatch, k):
    monkeypatch.setattr(restarts, "ROWS", 15)
    e, rows = event(PATTERNS[k]), random_rows(k + 20)
    assert sorted(rows_of(e, compile_event(e, spark.createDataFrame(rows, SCHEMA))), key=str) == sorted(exact(e, rows), key=str)


def test_states_without_a_binding_leaf_are_not_written(spark, monkeypatch):
    """Greedy leaves are looked up: no table is written, and the plan has no join."""
    from wayline.plans import compiler

    monkeypatch.setattr(compiler, "written", lambda df, tag: pytest.fail(tag))
    rows = spark.createDataFrame(random_rows(3), SCHEMA)
    for pattern in (PATTERNS[2], {"seq": [one("a", "X"), inside("9s", one("b", "X"), "2s"), one("c", "X")]}):
        plan = compile_event(event(pattern), rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan


ENDING = [
    {"seq": [one("a", "X"), inside("9s", {"all": [one("b", "X"), one("c", "X")]})]},
    {"seq": [one("a", "X"), inside("30s", {"seq": [one("b", "X"), inside("8s", one("c", "X"))]})]},
    {"k_of_n": {"k": 2, "patterns": [one("a", "X"), {"seq": [one("b", "X"), inside("4s", one("c", "X"))]}, one("c", "X")]}},
    {"seq": [one("a", "X"), inside("12s", {"for": {"duration": "3s", "pattern": one("b", "X")}}, "2s"), one("c", "X")]},
    {"seq": [one("a", "X"), inside("9s", two("X", "Y")), inside("9s", one("b", "X"))]},
]


@pytest.mark.parametrize("k", range(len(ENDING)))
def test_ends_of_candidates_are_those_of_the_exact_matcher(spark, k):
    """Open candidates, and what ended the others: by the node whose window passed first."""
    e, rows = event(ENDING[k]), random_rows(k + 60, 90)
    keyed = {}
    for r in rows:
        if who := r[6].get("x") or r[6].get("object"):
            keyed.setdefault(who, []).append(r)
    used = {x.predicate for x in e.pattern.leaves()}
    open_, why, done = Counter(), Counter(), set()
    for who, own in keyed.items():
        matcher = Matcher(e)
        last = None
        for r in own:
            if r[2] not in used:
                continue
            if last is not None:  # windows pass one by one, so that the first names the reason
                for t in range(last + 1, r[1], S // 2):
                    matcher.forget_before(t)
            for c in matcher.feed(Match(r[1], r[0], r[2], r[3], r[4], r[6], r[7])):
                done.add((who, c.matched_at, c.completed_at, c.matched_source, tuple(sorted(c.bindings.items()))))
            last = r[1]
        matcher.forget_before(last if last is not None else 0)
        open_.update((who, c.seed_t, len(c.hits), c.bindings) for c in matcher.candidates)
        why.update({f"{path}: {text}": n for (path, text), n in matcher.failures.items()})
    got = compile_ends(e, spark.createDataFrame(rows, SCHEMA)).collect()
    us = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    bound = lambda r: tuple((x, r[x.lower()]) for x in sorted(e.pattern.role_names()) if r[x.lower()] is not None)
    assert Counter((r.key, us(r.matched_at), r.satisfied, bound(r)) for r in got if r.status == "open") == open_
    assert Counter(r.reason for r in got if r.status == "expired") == why and (why or k == 2)
    assert {(r.key, us(r.matched_at), us(r.ended_at), r.matched_source, bound(r)) for r in got if r.status == "completed"} == done
    assert all((r.ended_at is None) == (r.status == "open") for r in got)


def test_what_has_no_bound_needs_a_horizon_or_a_key(spark):
    e = nested_event({"seq": [one("a", "X"), one("b", "Y")]})
    df = spark.createDataFrame(random_rows(5), SCHEMA)
    with pytest.raises(Unsupported, match="horizon"):
        occurrences(e, df)
    assert set(rows_of(e, occurrences(e, df, horizon_ms=900_000))) == exact(e, random_rows(5))
    e = event({"seq": [one("a", "X"), {"within": {"min": "1s", "max": "9s", "pattern": one("b", "X")}}]})
    lead = event({"seq": [{"within": {"min": "1s", "max": "9s", "pattern": {"seq": [one("a", "X"), one("b", "X")]}}}, one("c", "X")]})
    with pytest.raises(Unsupported):
        compile_event(lead, df)
    assert set(rows_of(lead, occurrences(lead, df))) == exact(lead, random_rows(5))


def test_echoed_literals_are_compared_as_values():
    assert echoes("0.50", 0.5) and echoes("5", 5.0) and not echoes("x", 0.5) and not echoes("0.6", 0.5)
    assert echoes("true", True) and echoes("False", False) and not echoes("1", True) and echoes(None, 3) and echoes("a", "a")


def test_empty_tables(spark):
    e = event(PATTERNS[0])
    assert occurrences(e, spark.createDataFrame([], SCHEMA)).collect() == []


def streamed(spark, folder, e, df, parts, lateness, forget_us=None):
    """The occurrences of a stream of the rows, in so many files, and the rows of state of each micro-batch."""
    from wayline.streaming.live import match_stream

    for k in range(parts):
        df.where(df["part"] == k).drop("part").coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder / "in"))
    out = match_stream(e, stream, "who", lateness, forget_us)
    run = out.writeStream.format("parquet").option("checkpointLocation", str(folder / "state")).outputMode("append").trigger(availableNow=True).start(str(folder / "out"))
    run.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    return set(rows_of(e, spark.read.parquet(str(folder / "out")))), states


def test_streams_give_what_batches_give(spark, tmp_path):
    from pyspark.sql import functions as F

    e, rows = event({"seq": [one("a", "X"), {"within": {"max": "20s", "pattern": one("b", "X")}}]}), random_rows(9)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("time", F.timestamp_micros("t")).withColumn("who", F.col("arguments")["object"]).where("who IS NOT NULL")
    got, _ = streamed(spark, tmp_path, e, df.withColumn("part", F.floor(F.col("seq") / 40)), 3, "1 minute")
    assert got == exact(e, rows)


def test_the_state_of_idle_keys_is_dropped(spark, tmp_path):
    """Eight keys speak once, a ninth goes on: the watermark passes the windows of the eight, whose state goes."""
    from pyspark.sql import functions as F

    e = event({"seq": [one("a", "X"), {"within": {"max": "20s", "pattern": one("b", "X")}}]})
    rows = [(k, k * S, "a", "s", 1.0, "t", {"object": f"idle{k}"}, {}) for k in range(8)]
    rows += [(100 + k, (100 * k + 50) * S, "ab"[k % 2], "s", 1.0, "t", {"object": "busy"}, {}) for k in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("time", F.timestamp_micros("t")).withColumn("who", F.col("arguments")["object"])
    got, states = streamed(spark, tmp_path, e, df.withColumn("part", F.when(F.col("seq") < 100, 0).otherwise(F.col("seq") - 99).cast("int")), 6, "1 second")
    assert got == exact(e, rows) and max(states) >= 8 and states[-1] <= 1


def test_how_long_candidates_live():
    ms = lambda pattern: longest_ms(event(pattern).pattern)
    assert ms(one("a", "X")) == 0 and ms({"seq": [one("a", "X"), one("b", "X")]}) is None
    assert ms({"seq": [one("a", "X"), {"within": {"max": "20s", "pattern": one("b", "X")}}, {"within": {"min": "1s", "max": "2s", "pattern": one("c", "X")}}]}) == 23_000
    assert ms({"all": [one("a", "X"), one("b", "X")]}) == 300_000 and ms({"for": {"duration": "2s", "pattern": one("a", "X")}}) is None


def test_equal_candidates_complete_once():
    """Two matches at one time by two arrivals are one observation, and candidates that become equal are told once."""
    e = event({"seq": [one("a", "X"), {"any": [one("b", "X"), one("c", "X")]}]})
    matcher = Matcher(e)
    rows = trace("0:a(x) 0:a(x) 1:b(x) 1:c(x)")
    done = [c for r in rows for c in matcher.feed(Match(r[1], r[0], r[2], r[3], r[4], r[6], r[7]))]
    assert len(done) == 1


def test_the_matcher_in_order_keeps_little():
    e = event({"seq": [one("a", "X"), {"within": {"max": "20s", "pattern": one("b", "X")}}]})
    rows = [(k, k * S, "ab"[k % 3 == 1], "s", 1.0, "t", {"object": "x"}, {}) for k in range(8000)]
    some, every = Matcher(e, in_order=True), Matcher(e)
    feed = lambda m: [c for r in rows for c in m.feed(Match(r[1], r[0], r[2], r[3], r[4], r[6], r[7]))]
    assert feed(some) == feed(every) and len(some.seen) < 1200 < len(every.seen)


def test_a_leaf_without_objects_is_looked_up(spark, monkeypatch):
    """Meetings are not joined with every alarm of their horizon, nor written for it."""
    from wayline.plans import compiler

    monkeypatch.setattr(compiler, "written", lambda df, tag: pytest.fail(tag))
    e = event({"seq": [{"all": [one("a", "X"), one("b", "Y")]}, ALARM, inside("20s", one("c", "X"))]})
    rows = random_rows(31)
    assert set(rows_of(e, compile_event(e, spark.createDataFrame(rows, SCHEMA), 60_000))) <= exact(e, rows)


@pytest.mark.parametrize("pattern", [{"all": [one("a", "X"), one("b", "Y")]}, {"seq": [one("a", "X"), inside("9s", one("b", "Y"))]}])
def test_the_first_match_of_each_binding_needs_no_grouping(spark, pattern):
    e, rows = event(pattern), random_rows(33)
    found = compile_event(e, spark.createDataFrame(rows, SCHEMA))
    assert sorted(rows_of(e, found), key=str) == sorted(exact(e, rows), key=str)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    twice = [*rows, *((r[0] + 1000, *r[1:6], r[6] | {"more": "1"}, r[7]) for r in rows)]  # two matches of one time and object
    assert sorted(rows_of(e, compile_event(e, spark.createDataFrame(twice, SCHEMA))), key=str) == sorted(exact(e, twice), key=str)


def test_matches_from_which_nothing_completes_meet_no_candidates(spark, monkeypatch):
    """Of a convoy, those that never go, or go after the horizon, are joined with nothing."""
    from wayline.plans import compiler

    met = []
    monkeypatch.setattr(compiler._Compiler, "reaching", lambda self, *a, own=compiler._Compiler.reaching: met.append(own(self, *a)) or met[-1])
    e = event({"seq": [one("a", "X"), {"all": [one("b", "X"), {"seq": [one("a", "Y"), one("b", "Y")]}]}]})
    rows = trace("0:a(x) 1:a(p) 2:a(y) 3:b(x) 4:b(y) 90:b(p) 91:a(z)")
    assert set(rows_of(e, compile_event(e, spark.createDataFrame(rows, SCHEMA), 60_000))) == {(0, 4 * S, "s", "a", "x", "y")}
    assert {r.r_X for r in met[0].where("e_1.m_t <= t + 60000000").collect()} == {"x", "y"} and all("z" not in r for d in met for r in d.collect())


@pytest.mark.parametrize(
    "second", [one("b", "Y"), {"any": [lasting("3s", one("b", "Y")), one("c", "Y")]}, {"any": [one("c", "Y"), lasting("2s", one("c", "Y"))]}]
)
def test_children_without_common_roles_are_neither_grouped_nor_written(spark, monkeypatch, second):
    """Threes of a sequence of three: each is told once, by joins in slots of time alone."""
    from wayline.plans import compiler

    monkeypatch.setattr(compiler, "written", lambda df, tag: pytest.fail(tag))
    e, rows = event({"seq": [one("a", "X"), second, one("a", "Z")]}), random_rows(41)
    df, every = spark.createDataFrame(rows, SCHEMA), exact(e, rows)
    for horizon in (600, 20):
        found = compile_event(e, df, horizon * 1000)
        assert sorted(rows_of(e, found), key=str) == sorted((r for r in every if r[1] - r[0] <= horizon * S), key=str)
        top = found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
        assert "Aggregate" not in top and every
