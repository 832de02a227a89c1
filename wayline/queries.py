"""Registered queries of the event engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import vectors as V
from wayline.operators import audio, evidence, identity, restarts, sequential, tracks, workload
from wayline.operators import matching
from wayline.operators.matching import match_by_key, occurrences
from wayline.plans.events import Event, parse_event
from wayline.plans.matches import from_events, observed_once
from wayline.session import scratch, table
from wayline.sources import history, recordings
from wayline.streaming import candidates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000_000
#: The events table's types as predicates of a user.
USER = {x: "object: visual_object, minimum_confidence?: number 0..1" for x in ("signup", "purchase", "error", "view", "click")}
PREDICATES = USER


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def event(name: str, pattern: dict) -> Event:
    return parse_event({"event": name, "roles": {r: {"class": "user"} for r in "UVW"}, "pattern": pattern}, USER, None)


def pattern_query(name: str, pattern: dict, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: occurrences(event(name, pattern), from_events(table(spark, sf_dir, "events")))
    if sql:
        SQL[name] = sql


# patterns over events

SEED = "{name!r} AS event, s.ts AS matched_at, {done} AS completed_at, 'cam' || (s.user_id % 4) AS matched_source, s.event_type AS predicate, CAST(s.user_id AS VARCHAR) AS u"
AFTER = "(p.ts > s.ts OR (p.ts = s.ts AND p.event_id > s.event_id))"


def _seed(name: str, done: str) -> str:
    return SEED.format(name=name, done=done)


pattern_query("leaf_confident", {"purchase": {"object": "U", "minimum_confidence": 0.2}}, f"SELECT {_seed('leaf_confident', 's.ts')} FROM events s WHERE s.event_type = 'purchase' AND least(s.value / 500, 1.0) >= 0.2")
pattern_query(
    "seq_within_greedy",
    {"seq": [{"signup": {"object": "U"}}, {"within": {"max": "24h", "pattern": {"purchase": {"object": "U"}}}}]},
    f"""SELECT {_seed("seq_within_greedy", "MIN(p.ts)")} FROM events s JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase' AND {AFTER} AND p.ts <= s.ts + INTERVAL 24 HOUR
    WHERE s.event_type = 'signup' GROUP BY s.event_id, s.user_id, s.ts, s.event_type""",
)
pattern_query(
    "seq_unbounded",
    {"seq": [{"signup": {"object": "U"}}, {"purchase": {"object": "U"}}]},
    f"""SELECT {_seed("seq_unbounded", "MIN(p.ts)")} FROM events s JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase' AND {AFTER}
    WHERE s.event_type = 'signup' GROUP BY s.event_id, s.user_id, s.ts, s.event_type""",
)
pattern_query(
    "seq_branching",
    {"seq": [{"signup": {"object": "U"}}, {"within": {"max": "10m", "pattern": {"purchase": {"object": "V"}}}}]},
    f"""SELECT {_seed("seq_branching", "MIN(p.ts)")}, CAST(p.user_id AS VARCHAR) AS v FROM events s JOIN events p ON p.user_id <> s.user_id AND p.event_type = 'purchase' AND {AFTER} AND p.ts <= s.ts + INTERVAL 10 MINUTE
    WHERE s.event_type = 'signup' GROUP BY s.event_id, s.user_id, s.ts, s.event_type, p.user_id""",
)
pattern_query(
    "within_minimum",
    {"seq": [{"signup": {"object": "U"}}, {"within": {"min": "2h", "max": "24h", "pattern": {"purchase": {"object": "U"}}}}]},
    f"""SELECT {_seed("within_minimum", "MIN(p.ts)")} FROM events s JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN s.ts + INTERVAL 2 HOUR AND s.ts + INTERVAL 24 HOUR
    WHERE s.event_type = 'signup' GROUP BY s.event_id, s.user_id, s.ts, s.event_type""",
)
pattern_query(
    "seq_of_three",
    {"seq": [{"signup": {"object": "U"}}, {"within": {"max": "24h", "pattern": {"error": {"object": "U"}}}}, {"within": {"max": "24h", "pattern": {"purchase": {"object": "U"}}}}]},
    f"""WITH first AS (SELECT s.event_id, s.user_id, s.ts, s.event_type, min_by(p.event_id, p.event_id) AS id2, MIN(p.ts) AS ts2 FROM events s JOIN events p ON p.user_id = s.user_id AND p.event_type = 'error' AND {AFTER} AND p.ts <= s.ts + INTERVAL 24 HOUR
        WHERE s.event_type = 'signup' GROUP BY s.event_id, s.user_id, s.ts, s.event_type)
    SELECT {_seed("seq_of_three", "MIN(p.ts)")} FROM first s JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase' AND (p.ts > s.ts2 OR (p.ts = s.ts2 AND p.event_id > s.id2)) AND p.ts <= s.ts2 + INTERVAL 24 HOUR
    GROUP BY s.event_id, s.user_id, s.ts, s.event_type""",
)
pattern_query(
    "all_two_objects",
    {"all": [{"signup": {"object": "U"}}, {"purchase": {"object": "V"}}]},
    """SELECT 'all_two_objects' AS event, least(a.ts, b.ts) AS matched_at, greatest(a.ts, b.ts) AS completed_at, 'cam' || (CASE WHEN a.ts < b.ts THEN a.user_id ELSE b.user_id END % 4) AS matched_source,
    CASE WHEN a.ts < b.ts THEN 'signup' ELSE 'purchase' END AS predicate, CAST(a.user_id AS VARCHAR) AS u, CAST(b.user_id AS VARCHAR) AS v FROM
    (SELECT MIN(greatest(a.ts, b.ts)) AS done, a.user_id AS au, b.user_id AS bu, least(a.ts, b.ts) AS seed FROM events a JOIN events b ON a.event_type = 'signup' AND b.event_type = 'purchase' AND a.user_id <> b.user_id AND b.ts BETWEEN a.ts - INTERVAL 5 MINUTE AND a.ts + INTERVAL 5 MINUTE GROUP BY 2, 3, 4) k
    JOIN events a ON a.user_id = k.au AND a.event_type = 'signup' JOIN events b ON b.user_id = k.bu AND b.event_type = 'purchase' AND least(a.ts, b.ts) = k.seed AND greatest(a.ts, b.ts) = k.done""",
)
pattern_query(
    "any_of_two",
    {"seq": [{"signup": {"object": "U"}}, {"within": {"max": "12h", "pattern": {"any": [{"purchase": {"object": "U"}}, {"error": {"object": "U"}}]}}}]},
    f"""SELECT {_seed("any_of_two", "MIN(p.ts)")} FROM events s JOIN events p ON p.user_id = s.user_id AND p.event_type IN ('purchase', 'error') AND {AFTER} AND p.ts <= s.ts + INTERVAL 12 HOUR
    WHERE s.event_type = 'signup' GROUP BY s.event_id, s.user_id, s.ts, s.event_type""",
)
pattern_query(
    "two_of_three",
    {"k_of_n": {"k": 2, "patterns": [{x: {"object": "U"}} for x in ("click", "view", "purchase")]}},
    f"""SELECT {_seed("two_of_three", "MIN(p.ts)")} FROM events s JOIN events p ON p.user_id = s.user_id AND p.event_type IN ('click', 'view', 'purchase') AND p.event_type <> s.event_type AND {AFTER} AND p.ts <= s.ts + INTERVAL 5 MINUTE
    WHERE s.event_type IN ('click', 'view', 'purchase') GROUP BY s.event_id, s.user_id, s.ts, s.event_type""",
)
pattern_query(
    "sustained_two_hours",
    {"for": {"duration": "2h", "pattern": {"view": {"object": "U"}}}},
    f"""SELECT {_seed("sustained_two_hours", "MIN(p.ts)")} FROM events s JOIN events p ON p.user_id = s.user_id AND p.event_type = 'view' AND p.ts >= s.ts + INTERVAL 2 HOUR
    WHERE s.event_type = 'view' GROUP BY s.event_id, s.user_id, s.ts, s.event_type""",
)


@query("matcher_by_key", SQL["seq_within_greedy"])
def matcher_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship by the exact matcher, key by key."""
    pattern = {"seq": [{"signup": {"object": "U"}}, {"within": {"max": "24h", "pattern": {"purchase": {"object": "U"}}}}]}
    return match_by_key(event("seq_within_greedy", pattern), from_events(table(spark, sf_dir, "events")))


# SQL of nested patterns: k orders events by time and arrival, and first() is the first event of a type in a range of it
BILLION = 1_000_000_000
KEYED = f"e AS (SELECT *, epoch_us(ts)::HUGEINT * {BILLION} + event_id AS k FROM events)"


def _until(k: str, us: int) -> str:
    """The first k that is more than so many microseconds after another's time."""
    return f"({k} // {BILLION} + {us + 1}) * {BILLION}"


def _first(kind: str, user: str | None, after: str, before: str) -> str:
    who = f"q.user_id = {user} AND " if user else ""
    return f"(SELECT MIN(q.k) FROM e q WHERE {who}q.event_type = '{kind}' AND q.k > {after} AND q.k < {before})"


def _at(k: str) -> str:
    return f"make_timestamp(CAST({k} // {BILLION} AS BIGINT))"


MINUTES = 60_000_000
_OF_U = "CAST(user_id AS VARCHAR) AS u"
_NESTED = f"""WITH {KEYED}, s AS (SELECT *, {_until("k", 24 * HOUR)} AS h FROM e WHERE event_type = 'signup'),
    f AS (SELECT *, {_first("view", "s.user_id", "s.k", "s.h")} AS v, {_first("click", "s.user_id", "s.k", "s.h")} AS c FROM s),
    viewed AS (SELECT *, least(h, {_until("v", 5 * MINUTES)}) AS w FROM f WHERE v IS NOT NULL AND (c IS NULL OR v < c)),
    then_clicked AS (SELECT *, {_first("click", "x.user_id", "x.v", "x.w")} AS c2 FROM viewed x),
    clicked AS (SELECT *, {_first("view", "x.user_id", "x.c", "x.h")} AS v2, {_first("purchase", "x.user_id", "x.c", "x.h")} AS p FROM f x WHERE c IS NOT NULL AND (v IS NULL OR c < v)),
    done AS (SELECT ts, user_id, {_first("purchase", "x.user_id", "x.c2", "x.w")} AS d FROM then_clicked x
      UNION ALL SELECT ts, user_id, {_first("purchase", "x.user_id", "x.v2", "least(x.h, " + _until("x.v2", 5 * MINUTES) + ")")} AS d FROM clicked x WHERE v2 IS NOT NULL AND (p IS NULL OR v2 < p)
      UNION ALL SELECT ts, user_id, {_first("view", "x.user_id", "x.p", "least(x.h, " + _until("x.p", 5 * MINUTES) + ")")} AS d FROM clicked x WHERE p IS NOT NULL AND (v2 IS NULL OR p < v2))
    SELECT 'nested_all' AS event, ts AS matched_at, {_at("d")} AS completed_at, 'cam' || (user_id % 4) AS matched_source, 'signup' AS predicate, {_OF_U} FROM done WHERE d IS NOT NULL"""
_USERS = lambda *kinds: [{k: {"object": "U"}} for k in kinds]
_NESTED_ALL = {"seq": [*_USERS("signup"), {"within": {"max": "24h", "pattern": {"all": [*_USERS("view"), {"seq": _USERS("click", "purchase")}]}}}]}


@query("nested_all_by_key", _NESTED)
def nested_all_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators nested in all, by the exact matcher for each user."""
    return match_by_key(event("nested_all", _NESTED_ALL), from_events(table(spark, sf_dir, "events")))


@query("nested_all", _NESTED)
def nested_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a plan of joins."""
    return occurrences(event("nested_all", _NESTED_ALL), from_events(table(spark, sf_dir, "events")))


@query(
    "convoy",
    f"""WITH {KEYED}, s AS (SELECT *, {_until("k", 6 * HOUR)} AS h FROM e WHERE event_type = 'signup'),
    x AS (SELECT *, {_first("view", "s.user_id", "s.k", "s.h")} AS v FROM s), pair AS (SELECT x.ts, x.user_id, x.v, x.h, y.user_id AS other, y.k AS y FROM x JOIN s y ON y.user_id <> x.user_id AND y.k > x.k AND y.k < x.h WHERE v IS NOT NULL),
    done AS (SELECT *, {_first("view", "pair.other", "pair.y", "pair.h")} AS w FROM pair)
    SELECT 'convoy' AS event, ts AS matched_at, {_at("MIN(greatest(v, w))")} AS completed_at, 'cam' || (user_id % 4) AS matched_source, 'signup' AS predicate, {_OF_U}, CAST(other AS VARCHAR) AS v
    FROM done WHERE abs(v // {BILLION} - w // {BILLION}) <= {5 * MINUTES} GROUP BY ts, user_id, other""",
)
def convoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A convoy's shape: one comes, and while it stays and goes another does. Candidates live for six hours."""
    pattern = {"seq": [{"signup": {"object": "U"}}, {"all": [{"view": {"object": "U"}}, {"seq": [{"signup": {"object": "V"}}, {"view": {"object": "V"}}]}]}]}
    return occurrences(event("convoy", pattern), from_events(table(spark, sf_dir, "events")), horizon_ms=6 * HOUR // 1000)


@query(
    "rendezvous",
    f"""WITH {KEYED}, s AS (SELECT *, {_until("k", 10 * MINUTES)} AS h FROM e WHERE event_type = 'signup'),
    met AS (SELECT s.event_id, s.ts, s.user_id, s.h, p.user_id AS v, MIN(p.k) FILTER (p.event_type = 'click') AS c, MIN(p.k) FILTER (p.event_type = 'view') AS b FROM s JOIN e p ON p.user_id <> s.user_id AND p.event_type IN ('click', 'view') AND p.k > s.k AND p.k < s.h GROUP BY ALL),
    held AS (SELECT *, {_first("view", "met.v", _until("met.b", 2 * MINUTES - 1), "met.h")} AS f FROM met), anyway AS (SELECT *, least(coalesce(c, f), coalesce(f, c)) AS a FROM held)
    SELECT 'rendezvous' AS event, x.ts AS matched_at, {_at("MIN(d.k)")} AS completed_at, 'cam' || (x.user_id % 4) AS matched_source, 'signup' AS predicate, CAST(x.user_id AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v, CAST(d.user_id AS VARCHAR) AS w
    FROM anyway x JOIN e d ON d.event_type = 'purchase' AND d.user_id <> x.user_id AND d.user_id <> x.v AND d.k > x.a AND d.k < x.h GROUP BY x.event_id, x.ts, x.user_id, v, d.user_id""",
)
def rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendezvous' shape: one comes, a second is sustained or acts, a third leaves; no roles in common, ten minutes in all."""
    second = {"any": [{"for": {"duration": "2m", "pattern": {"view": {"object": "V"}}}}, {"click": {"object": "V"}}]}
    pattern = {"seq": [{"signup": {"object": "U"}}, second, {"purchase": {"object": "W"}}]}
    return occurrences(event("rendezvous", pattern), from_events(table(spark, sf_dir, "events")), horizon_ms=10 * MINUTES // 1000)


@query(
    "alarm_after_meeting",
    f"""WITH {KEYED}, pair AS (SELECT a.user_id AS u, b.user_id AS v, least(a.k, b.k) AS s, greatest(a.k, b.k) AS m, CASE WHEN a.k < b.k THEN a.user_id ELSE b.user_id END AS who, CASE WHEN a.k < b.k THEN 'signup' ELSE 'purchase' END AS predicate FROM e a JOIN e b
      ON a.event_type = 'signup' AND b.event_type = 'purchase' AND a.user_id <> b.user_id AND b.ts BETWEEN a.ts - INTERVAL 5 MINUTE AND a.ts + INTERVAL 5 MINUTE),
    x AS (SELECT *, {_until("s", 4 * HOUR)} AS h FROM pair), y AS (SELECT *, {_first("error", None, "x.m", "x.h")} AS a FROM x), z AS (SELECT *, {_first("view", "y.u", "y.a", "least(y.h, " + _until("y.a", 2 * HOUR) + ")")} AS d FROM y WHERE a IS NOT NULL)
    SELECT 'alarm_after_meeting' AS event, {_at("s")} AS matched_at, {_at("MIN(d)")} AS completed_at, 'cam' || (who % 4) AS matched_source, predicate, CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v FROM z WHERE d IS NOT NULL GROUP BY s, who, predicate, u, v""",
)
def alarm_after_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robbery's shape: two are there, an alarm without any object, then one of the two acts; four hours in all."""
    rows = from_events(table(spark, sf_dir, "events"))
    alarm = F.col("predicate") == "error"
    rows = rows.withColumn("arguments", F.when(alarm, F.create_map(F.lit("class"), F.lit("alarm"))).otherwise(F.col("arguments"))).withColumn("predicate", F.when(alarm, "alarm").otherwise(F.col("predicate")))
    pattern = {"seq": [{"all": [{"signup": {"object": "U"}}, {"purchase": {"object": "V"}}]}, {"alarm": {"class": "alarm"}}, {"within": {"max": "2h", "pattern": {"view": {"object": "U"}}}}]}
    found = parse_event({"event": "alarm_after_meeting", "roles": {r: {"class": "user"} for r in "UV"}, "pattern": pattern}, USER | {"alarm": "class: audio_class"}, None)
    return occurrences(found, rows, horizon_ms=4 * HOUR // 1000)


_WAITED = f"""WITH {KEYED}, s AS (SELECT *, {_until("k", 48 * HOUR)} AS h FROM e WHERE event_type = 'signup'), f AS (SELECT *, {_first("error", "s.user_id", "s.k", "s.h")} AS x FROM s), g AS (SELECT *, {_first("purchase", "f.user_id", "f.x", "f.h")} AS p FROM f),
    last AS (SELECT user_id, MAX(k) AS l FROM e WHERE event_type IN ('signup', 'error', 'purchase') GROUP BY 1), r AS (SELECT g.*, p IS NULL AND l < h AS waits, p IS NULL AND l >= h AS late FROM g JOIN last USING (user_id))"""
_WAITING = f"""{_WAITED}, n AS (SELECT *, COUNT(*) FILTER (p IS NOT NULL) OVER w AS completed, COUNT(*) FILTER (late) OVER w AS expired FROM r WINDOW w AS (PARTITION BY user_id))
    SELECT CAST(user_id AS VARCHAR) AS key, ts AS matched_at, 'U=' || user_id AS bindings, CAST(1 + (x IS NOT NULL)::INT AS INT) AS satisfied, (1 + (x IS NOT NULL)::INT) / 3 AS fraction, CAST(completed AS INT) AS completed, CAST(expired AS INT) AS expired, CAST(0 AS INT) AS late, CASE WHEN expired > 0 THEN '1: window ' || expired ELSE '' END AS failures FROM n WHERE waits"""
_SIGNUP_ERROR_PURCHASE = {"seq": [*_USERS("signup"), {"within": {"max": "48h", "pattern": {"seq": _USERS("error", "purchase")}}}]}


@query("progress", _WAITING)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open candidates of signup, then error and purchase, per user."""
    return matching.progress_by_key(event("progress", _SIGNUP_ERROR_PURCHASE), from_events(table(spark, sf_dir, "events")))


@query("failures", f"{_WAITED} SELECT CASE WHEN x IS NULL THEN '0' ELSE '0,1' END AS state, CAST(1 + (x IS NOT NULL)::INT AS INT) AS satisfied, '1: window' AS reason, COUNT(*) AS n FROM r WHERE late GROUP BY ALL")
def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of them expired in which state."""
    return matching.failures(event("failures", _SIGNUP_ERROR_PURCHASE), from_events(table(spark, sf_dir, "events")))


@query("streamed_within", SQL["seq_within_greedy"].replace("'seq_within_greedy'", "'streamed_within'"))
def streamed_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship on a stream: the events as files in the order of time, users as keys."""
    rows = from_events(table(spark, sf_dir, "events")).withColumn("who", F.col("arguments")["object"])
    pattern = {"seq": [*_USERS("signup"), {"within": {"max": "24h", "pattern": _USERS("purchase")[0]}}]}
    return candidates.replayed_matches(event("streamed_within", pattern), rows, "who").where("late IS NULL").drop("late")


@query("observed_once", "SELECT MIN(event_id) AS seq, ts AS at, event_type AS predicate, CAST(user_id AS VARCHAR) AS object FROM events GROUP BY ts, event_type, user_id")
def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = from_events(table(spark, sf_dir, "events"))
    again = twice.withColumn("seq", F.col("seq") + 1_000_000_000)
    return observed_once(twice.unionByName(again)).select("seq", F.timestamp_micros("t").cast("timestamp_ntz").alias("at"), "predicate", F.col("arguments")["object"].alias("object"))


# predicates over tracks: an hour is a frame, a user an object

TRACKS = """tracks AS (SELECT 'cam' || (user_id % 4) AS source, epoch_us(date_trunc('hour', ts)) AS t, CAST(user_id AS VARCHAR) AS object_id,
    CASE user_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'car' ELSE 'backpack' END AS class, least(value / 50, 1.0) AS confidence,
    CAST(event_id * 37 % 900 AS DOUBLE) AS x1, CAST(event_id * 53 % 500 AS DOUBLE) AS y1, CAST(event_id * 37 % 900 + 20 + user_id % 30 AS DOUBLE) AS x2, CAST(event_id * 53 % 500 + 30 + user_id % 20 AS DOUBLE) AS y2,
    CAST(event_id % 7 - 3 AS DOUBLE) AS velocity_x, CAST(event_id % 5 - 2 AS DOUBLE) AS velocity_y
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY event_id DESC) AS n FROM events) WHERE n = 1),
  hours AS (SELECT DISTINCT t FROM tracks), frames AS (SELECT DISTINCT s.source, h.t FROM hours h, (SELECT DISTINCT source FROM tracks) s)"""


def user_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    last = evidence.latest_by(rows, ["user_id", "hour"], ["event_id"])
    real = lambda text: F.expr(text).cast("double")
    return last.select(
        F.concat(F.lit("cam"), F.col("user_id") % 4).alias("source"), F.unix_micros("hour").alias("t"), F.col("user_id").cast("string").alias("object_id"),
        F.element_at(F.array(*map(F.lit, ("person", "car", "backpack"))), (F.col("user_id") % 3 + 1).cast("int")).alias("class"), F.least(F.col("value") / 50, F.lit(1.0)).alias("confidence"),
        real("event_id * 37 % 900").alias("x1"), real("event_id * 53 % 500").alias("y1"), real("event_id * 37 % 900 + 20 + user_id % 30").alias("x2"), real("event_id * 53 % 500 + 30 + user_id % 20").alias("y2"),
        F.lit(None).cast("double").alias("world_x"), F.lit(None).cast("double").alias("world_y"), F.lit(None).cast("string").alias("world_frame"),
        real("event_id % 7 - 3").alias("velocity_x"), real("event_id % 5 - 2").alias("velocity_y"), F.lit(5).alias("age"),
    )


def hour_frames(found: DataFrame, size: tuple[float, float] | None = None) -> DataFrame:
    """Every hour that any source saw, for each of the four sources; with a frame size if one is given."""
    sources = F.array(*(F.lit(f"cam{k}") for k in range(4)))
    frames = found.select("t").distinct().select(F.explode(sources).alias("source"), "t")
    return frames if size is None else frames.withColumns({"frame_width": F.lit(size[0]), "frame_height": F.lit(size[1])})


def _flat(rows: DataFrame, *arguments: str) -> DataFrame:
    return rows.select("t", "predicate", "source", "confidence", *(F.col("arguments")[a].alias(a) for a in arguments))


EPISODES = """, ticks AS (SELECT source, t, lead(t) OVER w AS after, lag(t) OVER w AS before FROM frames WINDOW w AS (PARTITION BY source ORDER BY t)),
  seen AS (SELECT tracks.*, after, before, lag(tracks.t) OVER o AS was, lag(after) OVER o AS was_after, lead(tracks.t) OVER o AS again FROM tracks JOIN ticks ON tracks.source = ticks.source AND tracks.t = ticks.t WINDOW o AS (PARTITION BY tracks.source, object_id ORDER BY tracks.t)),
  numbered AS (SELECT *, SUM(CASE WHEN was IS NULL OR (before > was AND before - was_after >= 18000000000) THEN 1 ELSE 0 END) OVER (PARTITION BY source, object_id ORDER BY t) AS episode FROM seen)"""


@query("present", f"WITH {TRACKS}{EPISODES} SELECT t, 'present' AS predicate, source, confidence, object_id AS object FROM (SELECT *, row_number() OVER (PARTITION BY source, object_id, episode ORDER BY t) AS n FROM numbered WHERE confidence >= 0.5) WHERE n = 1")
def present(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = user_tracks(spark, sf_dir)
    return _flat(tracks.present(found, hour_frames(found), 5 * HOUR), "object")


GONE = """gone AS (SELECT s.source, s.object_id, s.t, MIN(f.t) AS gone FROM numbered s JOIN frames f ON f.source = s.source AND f.t >= s.after + 18000000000
      AND (s.again IS NULL OR f.t < s.again) WHERE s.again IS NULL OR s.again > s.after GROUP BY s.source, s.object_id, s.t)"""


@query(
    "exits",
    f"""WITH {TRACKS}{EPISODES}, {GONE}, spans AS (SELECT *, MIN(t) OVER (PARTITION BY source, object_id, episode) AS since, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM numbered)
    SELECT g.gone AS t, 'exits' AS predicate, s.source, s.confidence, s.object_id AS object FROM spans s JOIN gone g ON g.source = s.source AND g.object_id = s.object_id AND g.t = s.t
    WHERE s.t - s.since >= 3600000000 AND CASE WHEN least(cx, 960 - cx) <= least(cy, 560 - cy) THEN least(cx, 960 - cx) <= 240 ELSE least(cy, 560 - cy) <= 140 END""",
)
def exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = user_tracks(spark, sf_dir)
    return _flat(tracks.exits(found, hour_frames(found, (960.0, 560.0)), 5 * HOUR, HOUR), "object")


@query(
    "enters",
    f"""WITH {TRACKS}{EPISODES}, {GONE}, fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, object_id, episode ORDER BY t) AS n FROM numbered) WHERE n = 1 AND t > (SELECT MIN(f.t) FROM frames f)),
    held AS (SELECT s.*, g.gone FROM numbered s LEFT JOIN gone g ON g.source = s.source AND g.object_id = s.object_id AND g.t = s.t)
    SELECT x.t, 'enters' AS predicate, x.source, x.confidence, x.object_id AS object FROM fresh x WHERE NOT EXISTS (SELECT 1 FROM held o WHERE o.source = x.source AND o.object_id <> x.object_id AND o.class = x.class AND o.t < x.t AND (o.again IS NULL OR o.again > x.t) AND (o.gone IS NULL OR o.gone >= x.t)
      AND sqrt(((x.x1 + x.x2) / 2 - (o.x1 + o.x2) / 2) * ((x.x1 + x.x2) / 2 - (o.x1 + o.x2) / 2) + ((x.y1 + x.y2) / 2 - (o.y1 + o.y2) / 2) * ((x.y1 + x.y2) / 2 - (o.y1 + o.y2) / 2)) <= greatest(x.x2 - x.x1, x.y2 - x.y1, o.x2 - o.x1, o.y2 - o.y1))""",
)
def enters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = user_tracks(spark, sf_dir)
    return _flat(sequential.enters(found, hour_frames(found), absence_us=5 * HOUR), "object")


@query(
    "moving",
    f"""WITH {TRACKS}, m AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, lag(t) OVER o AS wt, lag((x1 + x2) / 2) OVER o AS wx, lag((y1 + y2) / 2) OVER o AS wy, lag(x2 - x1) OVER o AS ww, lag(confidence) OVER o AS wc FROM tracks WINDOW o AS (PARTITION BY source, object_id ORDER BY t))
    SELECT t, 'moving' AS predicate, source, least(confidence, wc) AS confidence, object_id AS object FROM m WHERE t - wt >= 200000 AND sqrt((cx - wx) * (cx - wx) + (cy - wy) * (cy - wy)) / greatest((x2 - x1 + ww) / 2, 1.0) / ((t - wt) / 1000000) >= 0.0005""",
)
def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(tracks.moving(user_tracks(spark, sf_dir), least_widths=0.0005), "object")


GAP = "sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) * ((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) * ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2)) / greatest((a.x2 - a.x1 + (b.x2 - b.x1)) / 2, 1.0)"
NOMINAL = "CASE {0}.class WHEN 'person' THEN 0.55 WHEN 'car' THEN 4.0 ELSE 0.45 END"
METRES = f"{GAP} * ({NOMINAL.format('a')} + {NOMINAL.format('b')}) / 2"
PAIR = "a.source = b.source AND a.t = b.t AND a.object_id <> b.object_id"


@query("near", f"WITH {TRACKS} SELECT a.t, 'near' AS predicate, a.source, least(a.confidence, b.confidence) AS confidence, a.object_id AS object_a, b.object_id AS object_b FROM tracks a JOIN tracks b ON {PAIR} WHERE NOT (a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2) AND {GAP} <= 4")
def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(tracks.near(user_tracks(spark, sf_dir), max_gap=4.0), "object_a", "object_b")


@query(
    "follows",
    f"""WITH {TRACKS}, v AS (SELECT *, sqrt(velocity_x * velocity_x + velocity_y * velocity_y) AS speed FROM tracks) SELECT a.t, 'follows' AS predicate, a.source, least(a.confidence, b.confidence) AS confidence, a.object_id AS leader, b.object_id AS follower FROM v a JOIN v b ON {PAIR}
    WHERE a.speed > 1e-9 AND b.speed > 1e-9 AND a.velocity_x * b.velocity_x + a.velocity_y * b.velocity_y >= 0.5 * a.speed * b.speed AND ((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) * a.velocity_x + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) * a.velocity_y > 0 AND {METRES} <= 15""",
)
def follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(tracks.follows(user_tracks(spark, sf_dir)), "leader", "follower")


@query(
    "interactions",
    f"""WITH {TRACKS}, d AS (SELECT a.source, a.t, a.object_id AS item, b.object_id AS holder, {METRES} AS metres FROM tracks a JOIN tracks b ON a.source = b.source AND a.t = b.t AND a.class = 'backpack' AND b.class IN ('person', 'car')),
    r AS (SELECT *, row_number() OVER (PARTITION BY source, t, item ORDER BY metres, holder) AS n FROM d) SELECT one.source, one.t, one.item, one.holder AS participant_a, two.holder AS participant_b, 1 - two.metres / 20 AS score FROM r one JOIN r two ON one.source = two.source AND one.t = two.t AND one.item = two.item AND one.n = 1 AND two.n = 2 WHERE two.metres <= 20""",
)
def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.interactions(user_tracks(spark, sf_dir), 20.0)


@query("conversations", f"WITH {TRACKS}, speech AS (SELECT source, t, MIN(x1 / 900) AS sure FROM tracks GROUP BY source, t HAVING COUNT(DISTINCT class) >= 2) SELECT a.t, 'conversation' AS predicate, a.source, least(a.confidence, b.confidence, sure) AS confidence, a.object_id AS participant_a, b.object_id AS participant_b FROM tracks a JOIN tracks b ON {PAIR} AND a.class = 'person' AND b.class = 'person' JOIN speech ON speech.source = a.source AND speech.t = a.t WHERE {METRES} <= 2.5")
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = user_tracks(spark, sf_dir)
    speech = found.groupBy("source", "t").agg(F.count_distinct("class").alias("speakers"), F.lit("any words").alias("text"), F.min(F.col("x1") / 900).alias("confidence"))
    return _flat(tracks.conversations(found, speech, required_terms="Words, any"), "participant_a", "participant_b")


# hours stand for frames here, so the waits are hours too

TICKS = "ticks AS (SELECT source, t, lag(t) OVER (PARTITION BY source ORDER BY t) AS before FROM frames)"
_SPEED = "sqrt({0}.velocity_x * {0}.velocity_x + {0}.velocity_y * {0}.velocity_y) / greatest({0}.x2 - {0}.x1, 1.0) * 4.0"
_CLOSEST = f"SELECT a.source, a.t, a.object_id AS person, b.object_id AS vehicle, row_number() OVER (PARTITION BY a.source, a.t, a.object_id ORDER BY {METRES}, b.object_id) AS n, {METRES} AS metres FROM tracks a JOIN tracks b ON a.source = b.source AND a.t = b.t AND a.class = 'person' AND b.class = 'car'"


@query(
    "boarding",
    f"""WITH {TRACKS}, {TICKS}, closest AS (SELECT * FROM ({_CLOSEST}) WHERE n = 1 AND metres <= 12),
    came AS (SELECT c.source, c.t, c.person, c.vehicle FROM closest c JOIN ticks k USING (source, t) JOIN tracks v ON v.source = c.source AND v.t = c.t AND v.object_id = c.vehicle
      WHERE {_SPEED.format("v")} <= 1.0 AND NOT EXISTS (SELECT 1 FROM tracks w WHERE w.source = c.source AND w.object_id = c.person AND w.t = k.before)),
    came2 AS (SELECT *, lead(t) OVER (PARTITION BY source, person ORDER BY t) AS next FROM came),
    off AS (SELECT DISTINCT ON (c.source, c.person, c.vehicle) a.t, 'disembarks' AS predicate, c.source, least(a.confidence, b.confidence) AS confidence, c.person, c.vehicle FROM came2 c JOIN tracks a ON a.source = c.source AND a.object_id = c.person AND a.t >= c.t AND a.t - c.t <= 172800000000 AND (next IS NULL OR a.t < next)
      JOIN tracks b ON b.source = c.source AND b.object_id = c.vehicle AND b.t = a.t WHERE {METRES} >= 20 ORDER BY c.source, c.person, c.vehicle, a.t),
    left_ AS (SELECT c.source, c.t AS seen, k.t, c.person, c.vehicle, v.x1, v.x2, v.y1, v.y2 FROM closest c JOIN ticks k ON k.source = c.source AND k.before = c.t JOIN tracks v ON v.source = c.source AND v.t = c.t AND v.object_id = c.vehicle
      WHERE NOT EXISTS (SELECT 1 FROM tracks w WHERE w.source = c.source AND w.object_id = c.person AND w.t = k.t)),
    left2 AS (SELECT *, lead(t) OVER (PARTITION BY source, person ORDER BY t) AS next FROM left_),
    onto AS (SELECT DISTINCT ON (l.source, l.person, l.vehicle) v.t, 'boards' AS predicate, l.source, v.confidence, l.person, l.vehicle FROM left2 l JOIN tracks v ON v.source = l.source AND v.object_id = l.vehicle AND v.t >= l.t AND v.t - l.seen <= 172800000000 AND (next IS NULL OR v.t < next)
      WHERE {_SPEED.format("v")} > 1.0 OR sqrt(((v.x1 + v.x2) / 2 - (l.x1 + l.x2) / 2) * ((v.x1 + v.x2) / 2 - (l.x1 + l.x2) / 2) + ((v.y1 + v.y2) / 2 - (l.y1 + l.y2) / 2) * ((v.y1 + v.y2) / 2 - (l.y1 + l.y2) / 2)) / greatest(v.x2 - v.x1, 1.0) * 4.0 >= 2 ORDER BY l.source, l.person, l.vehicle, v.t)
    SELECT * FROM off UNION ALL SELECT * FROM onto""",
)
def boarding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = user_tracks(spark, sf_dir)
    return _flat(sequential.boarding(found, hour_frames(found), close_m=12.0, apart_m=20.0, moving_mps=1.0, stopped_us=0, wait_us=48 * HOUR), "person", "vehicle")


@query(
    "transfers",
    f"""WITH RECURSIVE {TRACKS}, {TICKS}, near AS (SELECT a.source, a.t, a.object_id AS item, a.confidence AS sure, b.object_id AS holder, b.confidence AS own, {METRES} AS metres, row_number() OVER (PARTITION BY a.source, a.t, a.object_id ORDER BY {METRES}, b.object_id) AS n
      FROM tracks a JOIN tracks b ON a.source = b.source AND a.t = b.t AND a.class = 'backpack' AND b.class IN ('person', 'car')),
    v AS (SELECT i.source, i.t, i.object_id AS item, k.before, row_number() OVER (PARTITION BY i.source, i.object_id ORDER BY i.t) AS n, h.holder, least(i.confidence, h.own, least(greatest(0.55 + 0.45 * (1 - h.metres / 40), 0.0), 1.0)) AS sure
      FROM tracks i JOIN ticks k USING (source, t) LEFT JOIN near h ON h.source = i.source AND h.t = i.t AND h.item = i.object_id AND h.n = 1 AND h.metres <= 40 WHERE i.class = 'backpack'),
    walk AS (SELECT source, item, n, t, holder AS pending, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS DOUBLE) AS held_sure, CAST(NULL AS BIGINT) AS held_t, CAST(NULL AS VARCHAR) AS giver, CAST(NULL AS DOUBLE) AS confidence FROM v WHERE n = 1
      UNION ALL SELECT source, item, n, t, holder, CASE WHEN confirmed THEN holder WHEN NOT lost THEN held END, CASE WHEN confirmed THEN sure WHEN NOT lost THEN held_sure END, CASE WHEN confirmed THEN t WHEN NOT lost THEN held_t END,
        CASE WHEN confirmed AND NOT lost AND held <> holder THEN held END, least(held_sure, sure) FROM (SELECT v.source, v.item, v.n, v.t, v.holder, v.sure, w.held, w.held_sure, w.held_t, coalesce(w.held_t IS NOT NULL AND v.before > w.t AND v.before - w.held_t > 720000000000, false) AS lost,
          coalesce(v.holder = w.pending AND NOT (w.held_t IS NOT NULL AND v.before > w.t AND v.before - w.held_t > 720000000000), false) AS confirmed FROM walk w JOIN v ON v.source = w.source AND v.item = w.item AND v.n = w.n + 1))
    SELECT t, 'transfer' AS predicate, source, confidence, item, giver, pending AS receiver FROM walk WHERE giver IS NOT NULL""",
)
def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = user_tracks(spark, sf_dir)
    return _flat(sequential.transfers(found, hour_frames(found), close_m=40.0, stable_us=0, forget_us=200 * HOUR), "item", "giver", "receiver")


@query("tracked_objects")
def tracked_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = user_tracks(spark, sf_dir)
    frames = found.groupBy("source", "t").agg(F.array_sort(F.collect_list(F.struct("object_id", "class", "confidence", "x1", "y1", "x2", "y2"))).alias("detections"))
    return sequential.track_objects(frames)


@query(
    "audio_events",
    """WITH RECURSIVE m AS (SELECT 'mic' || (user_id % 16) AS source, epoch_us(ts) AS t, least(value / 100, 1.0) AS siren, value / 400 AS shot FROM events), a AS (SELECT source, t, siren FROM m WHERE siren >= 0.4),
    n AS (SELECT source, t, MIN(t) OVER (PARTITION BY source ORDER BY t RANGE BETWEEN 1000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM a), walk AS (SELECT source, MIN(t) AS t FROM a GROUP BY source UNION ALL SELECT n.source, n.next FROM walk w JOIN n ON n.source = w.source AND n.t = w.t WHERE n.next IS NOT NULL)
    SELECT t, 'audio_event' AS predicate, source, siren AS confidence, 'alarm' AS class FROM walk JOIN a USING (source, t) UNION ALL SELECT t, 'audio_event', source, least(shot, 1.0), 'gunshot' FROM m WHERE shot >= 0.35""",
)
def audio_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("mic"), F.col("user_id") % 16).alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.create_map(F.lit("Siren"), F.least(F.col("value") / 100, F.lit(1.0)), F.lit("Machine gun"), F.col("value") / 400).alias("scores"))
    return _flat(sequential.audio_events(rows), "class")


# evidence, identity, workload


@query("gated", "SELECT user_id, ts, value FROM (SELECT *, last_value(CASE WHEN value >= 60 THEN 1 WHEN value <= 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events) WHERE g = 1")
def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.gated(table(spark, sf_dir, "events"), F.col("value"), 60, 20, "user_id", "ts").select("user_id", "ts", "value")


#: Embeddings as frames of 8 by 8 pixels of four cameras.
FRAMES = "frames AS (SELECT vec_id % 4 AS source, vec_id AS t, list_transform(embedding, lambda x: floor(128 + 200 * CAST(x AS DOUBLE))) AS pixels FROM embeddings)"


@query("gated_frames", f"WITH {FRAMES}, d AS (SELECT source, t, pixels, lag(pixels) OVER (PARTITION BY source ORDER BY t) AS was FROM frames), l AS (SELECT source, t, coalesce(list_sum(list_transform(range(1, 65), lambda i: abs(pixels[i] - was[i]))) / 64 / 255, 0) AS level FROM d) SELECT source, t, round(level, 9) AS level FROM (SELECT *, last_value(CASE WHEN level >= 0.115 THEN 1 WHEN level <= 0.1 THEN 0 END IGNORE NULLS) OVER (PARTITION BY source ORDER BY t) AS g FROM l) WHERE g = 1")
def gated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that a gate on the difference to the frame before lets through."""
    frames = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("source"), F.col("vec_id").alias("t"), F.transform("embedding", lambda x: F.floor(128 + 200 * x.cast("double"))).alias("pixels"), F.lit(8).alias("height"), F.lit(8).alias("width"))
    return evidence.gated_by_time(evidence.frame_levels(frames), F.col("level"), 0.115, 0.1).select("source", "t", F.round("level", 9).alias("level"))


def _spaced(us: int) -> str:
    """Each user's events that are at least so long after the one that was let through before: walk."""
    return f"""WITH RECURSIVE m AS (SELECT user_id, epoch_us(ts) AS t, event_id, ts FROM events), n AS (SELECT user_id, t, MIN(t) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {us} FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM m),
    walk AS (SELECT user_id, MIN(t) AS t FROM m GROUP BY user_id UNION ALL SELECT n.user_id, n.next FROM walk w JOIN n ON n.user_id = w.user_id AND n.t = w.t WHERE n.next IS NOT NULL)"""


@query("sampled", _spaced(24 * HOUR) + " SELECT user_id, ts FROM walk JOIN m USING (user_id, t)")
def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return evidence.sampled(rows, 1 / 86400, "user_id").select("user_id", "ts")


@query(
    "restart_points",
    f"""WITH g AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM events), s AS (SELECT user_id, MAX(CASE WHEN t - was >= {24 * HOUR} THEN t END) OVER (PARTITION BY user_id ORDER BY t) AS segment FROM g),
    n AS (SELECT user_id, segment, COUNT(*) AS own FROM s GROUP BY ALL) SELECT user_id, COUNT(*) AS segments, MAX(own) AS longest, CAST(SUM(own) AS BIGINT) AS rows FROM n GROUP BY user_id""",
)
def restart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the streams of users are cut where a user is quiet for a day."""
    rows = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return restarts.cuts(restarts.segments_of_rows(rows, ["user_id"], 24 * HOUR), ["user_id"])


@query("latest_value", "SELECT p.event_id, (SELECT max_by(v.value, v.event_id) FROM events v WHERE v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts) AS value FROM events p WHERE p.event_type = 'purchase'")
def latest_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return evidence.latest_per_stream(rows.where("event_type = 'purchase'").select("event_id", "user_id", "t"), rows.where("event_type = 'view'").select("user_id", "t", "value"), "user_id", "value").select("event_id", "value")


SEGMENTS = "segments AS (SELECT o_orderkey AS segment, o_custkey AS source, o_orderdate AS event_start, MAX(l_shipdate) AS event_end FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("event_end"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("event_start"))
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select(F.col("o_orderkey").alias("segment"), F.col("o_custkey").alias("source"), "event_start", "event_end")


for _how, _where in (("overlap", "event_start < TIMESTAMP '1996-03-01' AND event_end > TIMESTAMP '1996-02-01'"), ("contained", "event_start >= TIMESTAMP '1996-02-01' AND event_end <= TIMESTAMP '1996-03-01'"), ("covering", "event_start <= TIMESTAMP '1996-02-01' AND event_end >= TIMESTAMP '1996-03-01'")):
    QUERIES[f"segments_{_how}"] = lambda spark, sf_dir, how=_how: evidence.segments_touching(segments(spark, sf_dir), F.expr("TIMESTAMP_NTZ'1996-02-01'"), F.expr("TIMESTAMP_NTZ'1996-03-01'"), how)
    SQL[f"segments_{_how}"] = f"WITH {SEGMENTS} SELECT * FROM segments WHERE {_where}"


@query(
    "recent_evidence",
    """WITH e AS (SELECT user_id AS u, ts AS et, event_id AS ei FROM events WHERE event_type = 'error'),
    n AS (SELECT p.event_id, p.user_id, p.ts, MAX(e.et) AS newest FROM events p LEFT JOIN e ON e.u = p.user_id AND (e.et < p.ts OR (e.et = p.ts AND e.ei < p.event_id)) WHERE p.event_type = 'purchase' GROUP BY ALL)
    SELECT event_id, evidence FROM (SELECT n.event_id, e.ei AS evidence, row_number() OVER (PARTITION BY n.event_id ORDER BY e.et, e.ei) AS k FROM n
    LEFT JOIN e ON e.u = n.user_id AND CASE WHEN newest IS NULL THEN e.et > n.ts OR (e.et = n.ts AND e.ei > n.event_id) ELSE e.et BETWEEN newest - INTERVAL 24 HOUR AND newest END) WHERE k = 1""",
)
def recent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as openers of a stage that waits for errors of the same user, a day of which is kept."""
    rows = table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("seq"))
    openers, errors = (rows.where(F.col("event_type") == x).drop("event_type") for x in ("purchase", "error"))
    return evidence.with_recent_evidence(openers, errors, 24 * HOUR).select(F.col("seq").alias("event_id"), F.col("evidence_seq").alias("evidence"))


@query("scores", "SELECT *, tp / NULLIF(tp + fp, 0) AS precision, tp / NULLIF(tp + fn, 0) AS recall FROM (SELECT COUNT(*) FILTER (quality = 1 AND toxic = 1) AS tp, COUNT(*) FILTER (quality = 1 AND toxic <> 1) AS fp, COUNT(*) FILTER (quality <> 1 AND toxic = 1) AS fn, COUNT(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels)")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.binary_scores(table(spark, sf_dir, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query("active_seconds", "SELECT user_id, SUM(n - t) / 1000000 AS active_seconds, COUNT(*) AS starts FROM (SELECT user_id, event_type, epoch_us(ts) AS t, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts), 1709251200000000) AS n FROM events) WHERE event_type IN ('view', 'click') GROUP BY user_id")
def active_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_type").isin("view", "click").alias("active"))
    return evidence.active_seconds(log, "user_id", F.lit(1709251200000000))


@query("condition_schedule", "SELECT value AS due_seconds, 'apply' AS action, CAST(user_id AS VARCHAR) AS link FROM events UNION ALL SELECT value + 5 AS due_seconds, 'restore' AS action, CAST(user_id AS VARCHAR) AS link FROM events WHERE event_type = 'error'")
def condition_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("value").alias("starts_at_seconds"), F.when(F.col("event_type") == "error", 5.0).alias("remains_for_seconds"), F.col("user_id").cast("string").alias("affected_link_name"))
    return evidence.condition_schedule(rows)


@query("link_state", "SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def link_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.latest_by(table(spark, sf_dir, "events"), ["user_id"], ["event_id"]).select("user_id", "value")


@query("counter_rates", "SELECT event_id, CASE WHEN value >= w THEN (value - w) / ((epoch_us(ts) - wt) / 1000000) END AS rate FROM (SELECT *, lag(value) OVER o AS w, lag(epoch_us(ts)) OVER o AS wt FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts))")
def counter_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return evidence.counter_rates(rows, "user_id", "value").select("event_id", "rate")


@query("leading_candidate", "SELECT event, candidate, fraction FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY fraction DESC, candidate) AS n FROM (SELECT event_type AS event, user_id AS candidate, COUNT(*) / 100.0 AS fraction FROM events GROUP BY 1, 2)) WHERE n = 1")
def leading_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("event"), F.col("user_id").alias("candidate")).agg(F.count("*").alias("satisfied")).withColumns({"completed_at": F.lit(None).cast("timestamp"), "matched_at": F.lit(None).cast("timestamp")})
    return evidence.leading(rows, 100).select("event", "candidate", "fraction")


@query("association_candidates", "SELECT a.vec_id AS left_id, b.vec_id AS right_id FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id - 60 AND a.vec_id + 60 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3")
def association_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.association_candidates(moments(spark, sf_dir), 60_000_000, 0.3).select("left_id", "right_id")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as descriptions by two sources, one a second."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("object_id"), (F.col("vec_id") % 2).alias("source"), (F.col("vec_id") * 1_000_000).alias("t"), F.lit("m@1").alias("model"), F.col("embedding").cast("array<double>").alias("vector"))


@query(
    "associations",
    """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT a.vec_id AS l, b.vec_id AS r, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON b.vec_id BETWEEN a.vec_id - 60 AND a.vec_id + 60 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
    o AS (SELECT l, r, s, row_number() OVER (ORDER BY s DESC, l, r) AS n FROM c WHERE s >= 0.3),
    w(n, ls, rs) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) UNION ALL SELECT o.n, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END FROM w JOIN o ON o.n = w.n + 1),
    taken AS (SELECT unnest(ls) AS l, unnest(rs) AS r FROM w WHERE n = (SELECT COUNT(*) FROM o)) SELECT l AS left_id, r AS right_id, round(s, 9) AS similarity FROM taken JOIN o USING (l, r)""",
)
def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = identity.one_to_one(identity.association_candidates(moments(spark, sf_dir), 60_000_000, 0.3))
    return chosen.withColumn("similarity", F.round("similarity", 9))


@query("associations_at_any_time", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS left_id, b.vec_id AS right_id FROM v a JOIN v b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND list_cosine_similarity(a.e, b.e) >= 0.35")
def associations_at_any_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model for all vectors, whatever their times."""
    return identity.association_candidates(moments(spark, sf_dir), None, 0.35).select("left_id", "right_id")


@query(
    "open_associations",
    "WITH v AS (SELECT vec_id, vec_id % 3 AS s, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS left_id, b.vec_id AS right_id FROM v a JOIN v b ON a.label = b.label AND ((a.s = 0 AND b.s = 2) OR (a.s = 0 AND b.s = 1)) AND list_cosine_similarity(a.e, b.e) >= 0.35",
)
def open_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one model, whatever their times, between named pairs of sources."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("object_id"), (F.col("vec_id") % 3).alias("source"), F.lit(0).alias("t"), F.col("label").cast("string").alias("model"), F.col("embedding").alias("vector"))
    return identity.association_candidates(rows, None, 0.35, [(2, 0), (0, 1)]).select("left_id", "right_id")


#: Edges between users of purchases that follow one another in the table and cost about the same; users are of two classes.
LINKED = "edges AS (SELECT DISTINCT a.user_id AS l, b.user_id AS r FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_type = 'purchase' AND b.event_type = 'purchase' AND abs(a.value - b.value) <= 10 AND a.user_id <> b.user_id)"


@query("identities", f"WITH RECURSIVE {LINKED}, users AS (SELECT user_id, MIN(ts) AS f FROM events GROUP BY user_id), both_ways AS (SELECT l, r FROM edges UNION SELECT r, l FROM edges), reach(a, b) AS (SELECT user_id, user_id FROM users UNION SELECT reach.a, both_ways.r FROM reach JOIN both_ways ON reach.b = both_ways.l) SELECT reach.a AS object_id, min_by(reach.b, u.f) AS canonical_id, COUNT(DISTINCT reach.b % 5 = 0) > 1 AS conflict FROM reach JOIN users u ON u.user_id = reach.b GROUP BY reach.a")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    seen = events.groupBy(F.col("user_id").alias("object_id")).agg(F.min("ts").alias("first_seen")).withColumn("class", F.when(F.col("object_id") % 5 == 0, "car").otherwise("person"))
    a, b = events.alias("a"), events.alias("b")
    both = (F.col("a.event_type") == "purchase") & (F.col("b.event_type") == "purchase") & (F.abs(F.col("a.value") - F.col("b.value")) <= 10) & (F.col("a.user_id") != F.col("b.user_id"))
    linked = a.join(b, F.col("b.event_id") == F.col("a.event_id") + 1).where(both).select(F.col("a.user_id").alias("left_id"), F.col("b.user_id").alias("right_id")).distinct()
    return identity.identities(seen, linked).select("object_id", "canonical_id", "conflict")


@query("coalesced_demands", "SELECT user_id % 4 AS site, event_type AS predicate, MIN(ts) AS expires_at, COUNT(DISTINCT user_id) AS consumers FROM events GROUP BY 1, 2")
def coalesced_demands(spark: SparkSession, sf_dir: str) -> DataFrame:
    demands = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("site"), F.col("event_type").alias("predicate"), F.lit("").alias("arguments"), F.col("ts").alias("expires_at"), F.col("user_id").alias("consumer"))
    return workload.coalesced(demands).select("site", "predicate", "expires_at", F.size("consumers").cast("long").alias("consumers"))


@query("node_load", "SELECT plan, node, greatest(CASE WHEN cpu = 0 THEN 0 ELSE cpu / 4 END, CASE WHEN memory = 0 THEN 0 ELSE memory / 500 END) AS peak FROM (SELECT user_id AS plan, event_id % 3 AS node, CAST(COUNT(*) AS DOUBLE) AS cpu, SUM(value) AS memory FROM (SELECT * FROM events ORDER BY event_id) WHERE event_type <> 'error' GROUP BY 1, 2)")
def node_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("plan"), (F.col("event_id") % 3).alias("node"), F.lit(1.0).alias("cpu"), F.col("value").cast("decimal(12,2)").alias("memory"), F.lit(0.0).alias("gpu"), (F.col("event_type") == "error").alias("running"))
    nodes = spark.range(3).select(F.col("id").alias("node"), F.lit(4.0).alias("cpu"), F.lit(500.0).alias("memory"), F.lit(1.0).alias("gpu"))
    return workload.load(steps.withColumn("memory", F.col("memory").cast("double")), nodes).select("plan", "node", F.round("peak", 6).alias("peak"))


SQL["node_load"] = SQL["node_load"].replace("AS peak FROM", "AS p FROM", 1).join(["SELECT plan, node, round(p, 6) AS peak FROM (", ")"])


@query("ranked_plans", "SELECT request, plan, n AS rank FROM (SELECT event_type AS request, event_id AS plan, row_number() OVER (PARTITION BY event_type ORDER BY value, user_id, event_id) AS n FROM events) WHERE n <= 8")
def ranked_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("request"), F.col("event_id").alias("plan"), F.col("value").alias("completion_ms"), F.lit(0).alias("slack_ms"), F.col("user_id").alias("new_providers"), F.lit(0).alias("bytes"), F.lit(0.0).alias("peak"), F.lit(1.0).alias("quality"))
    return workload.ranked(rows).select("request", "plan", F.col("rank").cast("long").alias("rank"))


@query("reconciled", "WITH e AS (SELECT user_id * 1000 + dayofyear(ts) AS provider, event_type FROM events) SELECT coalesce(r.provider, w.provider) AS provider, CASE WHEN r.provider IS NULL THEN 'START' WHEN w.provider IS NULL THEN 'STOP' ELSE 'KEEP' END AS action FROM (SELECT DISTINCT provider FROM e WHERE event_type = 'view') r FULL JOIN (SELECT DISTINCT provider FROM e WHERE event_type = 'click') w ON r.provider = w.provider")
def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as a provider: running if it has a view, wanted if it has a click."""
    rows = table(spark, sf_dir, "events").select(F.lit("n").alias("node"), (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("provider"), "event_type")
    return workload.reconciled(rows.where("event_type = 'view'"), rows.where("event_type = 'click'")).select("provider", "action")


@query("shortest_paths", "WITH RECURSIVE l AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, CAST(1 + n_regionkey AS DOUBLE) AS ms FROM nation), p(src, dst, ms, hops) AS (SELECT src, dst, ms, 1 FROM l UNION ALL SELECT p.src, l.dst, p.ms + l.ms, hops + 1 FROM p JOIN l ON p.dst = l.src WHERE hops < 24 AND p.src <> l.dst) SELECT src, dst, MIN(ms) AS latency_ms FROM p GROUP BY 1, 2")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst"), (1.0 + F.col("n_regionkey")).cast("double").alias("latency_ms"), F.lit(100.0).alias("mbps"))
    return workload.shortest_paths(links).select("src", "dst", "latency_ms")


@query("voices", "SELECT vec_id, least(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / 64) / 0.1, 1.0) >= 1 AS loud FROM embeddings")
def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(V.voice(F.col("embedding"), 0.1) >= 1, F.lit(False)).alias("loud"))


@query("smoothed_throughput", "WITH n AS (SELECT CAST(user_id AS VARCHAR) AS link, epoch_us(ts) AS t, list(value) OVER (PARTITION BY user_id ORDER BY ts) AS l FROM events) SELECT link, t, list_reduce(l, lambda a, x: CAST(0.3 AS DOUBLE) * x + (1 - CAST(0.3 AS DOUBLE)) * a) AS smoothed FROM n")
def smoothed_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("link"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("mbps"))
    return workload.smoothed(rows)


@query("evidence_relay", _spaced(6 * HOUR) + " SELECT user_id, t, event_id FROM walk JOIN m USING (user_id, t)")
def evidence_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    return sequential.suppressed_repeats(rows, "user_id", 6 * HOUR)


@query("localized")
def localized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as one channel of sound, and the same two samples later as the other."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("left"), F.concat(F.slice("embedding", F.lit(3), F.greatest(F.size("embedding") - 2, F.lit(0))), F.slice("embedding", 1, 2)).alias("right"), F.lit(16000).alias("rate"))
    return audio.localized(rows, 0.2).select("vec_id", F.round("bearing_degrees", 3).alias("bearing_degrees"))


@query("recipes", "WITH RECURSIVE p AS (SELECT 'n' || n_nationkey AS provider, CASE WHEN n_nationkey >= 5 THEN 't' || (n_nationkey // 5) END AS i, 't' || (n_nationkey // 5 + 1) AS o FROM nation), r(chain, i) AS (SELECT provider, i FROM p WHERE o = 't5' UNION ALL SELECT p.provider || '>' || r.chain, p.i FROM r JOIN p ON p.o = r.i) SELECT chain FROM r WHERE i IS NULL")
def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as providers in five layers: every chain through them."""
    layer = F.floor(F.col("n_nationkey") / 5)
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("provider"), F.when(F.col("n_nationkey") >= 5, F.concat(F.lit("t"), layer)).alias("input"), F.concat(F.lit("t"), layer + 1).alias("output"), F.lit(True).alias("enabled"))
    return workload.recipes(rows, "t5").select(F.array_join("chain", ">").alias("chain"))


# operators of the pipelines around detectors, on the same tables


@query(
    "follows_across",
    f"""WITH {TRACKS}, w AS (SELECT *, (x1 + x2) / 2 AS wx, (y1 + y2) / 2 AS wy, sqrt(velocity_x * velocity_x + velocity_y * velocity_y) AS speed FROM tracks) SELECT a.t, 'follows' AS predicate, a.source, least(a.confidence, b.confidence) AS confidence, a.object_id AS leader, b.object_id AS follower FROM w a JOIN w b ON a.source <> b.source AND a.t = b.t AND a.object_id <> b.object_id
    WHERE a.speed > 1e-9 AND b.speed > 1e-9 AND a.velocity_x * b.velocity_x + a.velocity_y * b.velocity_y >= 0.5 * a.speed * b.speed AND (a.wx - b.wx) * a.velocity_x + (a.wy - b.wy) * a.velocity_y > 0 AND sqrt((a.wx - b.wx) * (a.wx - b.wx) + (a.wy - b.wy) * (a.wy - b.wy)) <= 120""",
)
def follows_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of different sources in one world frame, where boxes' centres stand for places in the world."""
    placed = user_tracks(spark, sf_dir).withColumns({"world_x": F.expr("(x1 + x2) / 2"), "world_y": F.expr("(y1 + y2) / 2"), "world_frame": F.lit("map")})
    return _flat(tracks.follows_across(placed, 120.0, apart_us=HOUR), "leader", "follower")


def user_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event as a box of 60 by 60 in its week's frame."""
    rows = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.date_trunc("week", F.col("ts").cast("timestamp"))))
    boxes = rows.select("event_id", F.concat(F.lit("cam"), F.col("user_id") % 4).alias("source"), "t", F.col("event_type").alias("class"), F.col("value").alias("confidence"), F.expr("CAST(event_id * 37 % 300 AS DOUBLE)").alias("x1"), F.expr("CAST(event_id * 53 % 200 AS DOUBLE)").alias("y1"))
    return boxes.withColumns({"x2": F.col("x1") + 60, "y2": F.col("y1") + 60})


@query("suppressed_boxes")
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequential.suppressed_boxes(user_boxes(spark, sf_dir)).select("event_id", "source", "t", "class")


@query("projected", "SELECT event_id, (0.5 * x + 3.0) / (0.001 * y + 1.0) AS world_x, (0.25 * y - 2.0) / (0.001 * y + 1.0) AS world_y FROM (SELECT event_id, CAST(event_id * 37 % 300 AS DOUBLE) + 30 AS x, CAST(event_id * 53 % 200 AS DOUBLE) + 60 AS y FROM events)")
def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle of each box's lower edge on the ground, through a homography."""
    x, y = V.projected((F.col("x1") + F.col("x2")) / 2, F.col("y2"), [0.5, 0.0, 3.0, 0.0, 0.25, -2.0, 0.0, 0.001, 1.0])
    return user_boxes(spark, sf_dir).select("event_id", x.alias("world_x"), y.alias("world_y"))


@query("normalized_vectors", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e)), 9) AS first, round(list_sum(list_transform(e, lambda x: x * x)) / list_dot_product(e, e), 9) AS length FROM v")
def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = V.normalized(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", unit.alias("u")).select("vec_id", F.round(F.element_at("u", 1), 9).alias("first"), F.round(V.norm(F.col("u")), 9).alias("length"))


@query("speaker_vectors", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, round(list_avg(e), 9) AS mean, round(sqrt(list_dot_product(e, e) / len(e)), 9) AS rms, round(list_sum(list_transform(range(2, len(e) + 1), lambda i: CASE WHEN (e[i - 1] < 0) <> (e[i] < 0) THEN 1 ELSE 0 END)) / (len(e) - 1), 9) AS crossings FROM v")
def speaker_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.speaker_vector(F.col("embedding").cast("array<double>")).alias("v"))
    return rows.select("vec_id", *(F.round(F.element_at("v", k + 1), 9).alias(n) for k, n in enumerate(("mean", "rms", "crossings"))))


@query("speakers")
def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as segments, one a second, of sixteen microphones."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("mic"), F.col("vec_id") % 16).alias("source"), F.col("vec_id").alias("t"), F.col("embedding").alias("vector"))
    return sequential.speakers(rows)


@query(
    "seen_and_heard",
    """WITH b AS (SELECT event_id, user_id % 4 AS site, epoch_us(date_trunc('day', ts)) AS t, event_type, event_id * 37 % 360 AS bearing, least(value / 100, 1.0) AS confidence FROM events), p AS (SELECT s.site, s.t, v.event_id AS object_id, s.event_id AS sound, abs(((s.bearing - v.bearing + 180) % 360 + 360) % 360 - 180) AS error, least(s.confidence, v.confidence) AS sure
      FROM b s JOIN b v ON s.site = v.site AND s.t = v.t AND s.event_type = 'error' AND v.event_type = 'view') SELECT site, t, object_id, CAST(error AS DOUBLE) AS error_degrees, (1 - error / 20.0::DOUBLE) * sure AS score FROM p WHERE error <= 20""",
)
def seen_and_heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors as sounds and views as sights of a day at one of four sites."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("site"), F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("t"), "event_type", F.col("event_id").alias("object_id"), F.expr("CAST(event_id * 37 % 360 AS DOUBLE)").alias("bearing_degrees"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"))
    return audio.seen_and_heard(rows.where("event_type = 'error'"), rows.where("event_type = 'view'"), 20.0)


@query(
    "recanonicalised",
    f"""WITH RECURSIVE {LINKED}, users AS (SELECT user_id, MIN(ts) AS f FROM events GROUP BY user_id), both_ways AS (SELECT l, r FROM edges UNION SELECT r, l FROM edges), reach(a, b) AS (SELECT user_id, user_id FROM users UNION SELECT reach.a, both_ways.r FROM reach JOIN both_ways ON reach.b = both_ways.l),
    named AS (SELECT reach.a AS id, min_by(reach.b, u.f) AS c FROM reach JOIN users u ON u.user_id = reach.b GROUP BY reach.a), days AS (SELECT epoch_us(date_trunc('day', ts)) AS matched_at, user_id, MAX(ts) AS done FROM events GROUP BY 1, 2)
    SELECT matched_at, c AS u, MIN(done) AS completed_at FROM days JOIN named ON id = user_id GROUP BY 1, 2""",
)
def recanonicalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day as an occurrence; after users have been merged, equal ones count once."""
    days = table(spark, sf_dir, "events").groupBy(F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("matched_at"), F.col("user_id").alias("u")).agg(F.max("ts").alias("completed_at"))
    return identity.recanonicalised(days, ["u"], identities(spark, sf_dir))


@query("stored_segments", f"WITH {SEGMENTS}, kept AS (SELECT *, event_end + INTERVAL 30 DAY AS gone FROM segments WHERE source % 2 = 0 UNION ALL SELECT *, event_end + INTERVAL 60 DAY AS gone FROM segments WHERE source % 2 = 1) SELECT segment, event_start, event_end FROM kept WHERE event_start < TIMESTAMP '1996-03-01' AND event_end > TIMESTAMP '1996-02-01' AND gone > TIMESTAMP '1996-04-15'")
def stored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments added to a store that has some of them already, then those that touch February and have not expired."""
    day = lambda n: F.expr(f"event_end + INTERVAL {n} DAY").alias("expires_at")
    every = segments(spark, sf_dir)
    store = every.where("source % 2 = 0").select("*", day(30))
    held = evidence.added(store, every.select("*", day(60)), "segment")
    at = lambda d: F.expr(f"TIMESTAMP_NTZ'{d}'")
    return evidence.segments_touching(held, at("1996-02-01"), at("1996-03-01"), at=at("1996-04-15")).select("segment", "event_start", "event_end")


HISTORY = " UNION ALL ".join(f"SELECT '{how}' AS how, segment FROM kept WHERE event_end >= event_start AND {where} AND gone > TIMESTAMP '1996-04-15'" for how, where in (("overlap", "event_start < TIMESTAMP '1996-03-01' AND event_end > TIMESTAMP '1996-02-01'"), ("contained", "event_start >= TIMESTAMP '1996-02-01' AND event_end <= TIMESTAMP '1996-03-01'"), ("covering", "event_start <= TIMESTAMP '1996-02-01' AND event_end >= TIMESTAMP '1996-03-01'")))


@query("history_by_time", f"WITH {SEGMENTS}, kept AS (SELECT *, event_end + INTERVAL 30 DAY AS gone FROM segments WHERE source % 2 = 0 UNION ALL SELECT *, event_end + INTERVAL 60 DAY AS gone FROM segments WHERE source % 2 = 1) {HISTORY}")
def history_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a store laid out by time: written, added to, rid of what has expired, and asked in three ways."""
    path, every = scratch(spark, "history"), segments(spark, sf_dir)
    day = lambda n: F.expr(f"event_end + INTERVAL {n} DAY").alias("expires_at")
    history.store_segments(every.where("source % 2 = 0").select("*", day(30)), path, "segment")
    history.add_segments(every.select("*", day(60)), path, "segment")
    at = lambda d: F.expr(f"TIMESTAMP_NTZ'{d}'")
    history.expire_segments(spark, path, at("1996-04-15"))
    found = [history.segments_between(spark, path, at("1996-02-01"), at("1996-03-01"), how).select(F.lit(how).alias("how"), "segment") for how in ("overlap", "contained", "covering")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("wav_windows", "SELECT 'mic' || (vec_id // 400) AS recording, CAST(1000000 * (vec_id % 400) AS BIGINT) AS t, list_sum(list_transform(embedding, lambda x, i: i * floor(20000 * CAST(x AS DOUBLE)))) AS total FROM embeddings")
def wav_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as seconds of sound of 64 samples, written as WAV files of 400 seconds and read by ranges of 100 windows."""
    path = scratch(spark, "sound")
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("mic"), F.floor(F.col("vec_id") / 400)).alias("recording"), F.col("vec_id").alias("t"), F.transform("embedding", lambda x: F.floor(20000 * x.cast("double")) / 32768).alias("samples"))
    recordings.write_wav(rows, path, 64)
    read = recordings.read_wav_windows(spark, path, 1000, 100)
    total = F.aggregate(F.transform("samples", lambda x, i: (i + 1) * F.rint(x.cast("double") * 32768)), F.lit(0.0), lambda a, x: a + x)
    return read.select(F.regexp_extract("path", "([^/]+)[.]wav$", 1).alias("recording"), "t", total.alias("total"))


@query("completions_written", SQL["seq_within_greedy"].replace("CAST(s.user_id AS VARCHAR) AS u", "CAST(s.user_id AS VARCHAR) AS u").replace(", s.event_type AS predicate", ""))
def completions_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's occurrences written as JSON lines and read again."""
    path = scratch(spark, "completions")
    recordings.write_completions(QUERIES["seq_within_greedy"](spark, sf_dir), ["U"], path)
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return recordings.read_completions(spark, path).select("event", plain("matched_at"), plain("completed_at"), "matched_source", F.col("bindings")["U"].alias("u"))


@query("in_one_stream", "SELECT ts AS event_time, 'b' AS stream, event_id FROM events WHERE event_type = 'view' AND user_id % 4 IN (0, 1) UNION ALL SELECT ts, 'a', event_id FROM events WHERE event_type = 'click' AND user_id % 4 IN (0, 1)")
def in_one_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks replayed together, and of that what comes from two of four sources."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("event_time"), "event_id", "event_type", F.array(F.concat(F.lit("cam"), F.col("user_id") % 4)).alias("sources"))
    both = evidence.replayed({"a": rows.where("event_type = 'click'"), "b": rows.where("event_type = 'view'")}, "event_time")
    return evidence.subscribed(both, sources=["cam0", "cam1"]).select("event_time", "stream", "event_id")
