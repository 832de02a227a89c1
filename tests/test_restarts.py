"""Restart points against folds over whole sources, and the bucketed windows against plain ones."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wayline.operators import restarts, sequential, tracks

TRACKS = "source string, t long, object_id string, class string, confidence double, x1 double, y1 double, x2 double, y2 double, world_x double, world_y double, world_frame string, velocity_x double, velocity_y double, age int"
SECOND = 1_000_000


def trace(seed, sources=3, frames=160):
    """Frames every half a second, or now and then later, with runs of frames in which nothing is seen."""
    dice = random.Random(seed)
    ticks, rows = [], []
    for source in [*(f"s{k}" for k in range(sources)), None][: sources + 1]:
        t, quiet = 0, 0
        for _ in range(frames):
            t += dice.choice([SECOND // 2, SECOND // 2, SECOND // 2, 7 * SECOND])
            ticks.append((source, t))
            quiet = quiet - 1 if quiet > 0 else dice.choice([0, 0, 0, 0, 0, 0, dice.randrange(1, 24)])
            if quiet:
                continue
            for k, kind in enumerate(["person", "person", "car", "car", "backpack", "backpack"]):
                if dice.random() < 0.6:
                    x, y = dice.randrange(0, 200), dice.randrange(0, 40)
                    rows.append((source, t, f"{kind}{k}", kind, dice.choice([0.4, 0.7, 0.9]), float(x), float(y), x + 20.0, y + 30.0, None, None, None, float(dice.choice([0, 0, 30])), 0.0, dice.randrange(1, 6)))
    return ticks, rows


def shown(df):
    plain = lambda v: tuple(sorted(v.items())) if isinstance(v, dict) else round(v, 9) if isinstance(v, float) else v
    return Counter(tuple(plain(v) for v in r) for r in df.collect())


OPERATORS = {
    "enters": lambda found, frames: sequential.enters(found, frames, 2, 3 * SECOND),
    "boarding": lambda found, frames: sequential.boarding(found, frames, 6.0, 2.0, 8.0, 0.75, SECOND // 2, 8 * SECOND),
    "tracked": lambda found, frames: sequential.track_objects(detected(found, frames)),
    "present": lambda found, frames: tracks.present(found, frames, 3 * SECOND),
    "exits": lambda found, frames: tracks.exits(found, frames, 3 * SECOND, SECOND // 2),
    "transfers": lambda found, frames: sequential.transfers(found, frames, 6.0, SECOND // 2, 5 * SECOND),
}


def detected(found, frames):
    """Detection frames, empty ones too."""
    rows = found.groupBy("source", "t").agg(F.array_sort(F.collect_list(F.struct("object_id", "class", "confidence", "x1", "y1", "x2", "y2"))).alias("detections"))
    return frames.join(rows, ["source", "t"], "left").withColumn("detections", F.coalesce("detections", F.array().cast(rows.schema["detections"].dataType)))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_segments_give_what_whole_sources_give(spark, monkeypatch, name):
    ticks, rows = trace(4)
    ticks, rows = [x for x in ticks if x[0]], [x for x in rows if x[0]]
    found, frames = spark.createDataFrame(rows, TRACKS), spark.createDataFrame(ticks, "source string, t long")
    monkeypatch.setattr(restarts, "ROWS", 40)  # many buckets
    got, seen = shown(OPERATORS[name](found, frames)), []
    monkeypatch.setattr(restarts, "ROWS", 1 << 40)
    whole = lambda found, frames, _: frames.select("source", "t").distinct().withColumn("segment", F.lit(restarts.FIRST))
    monkeypatch.setattr(sequential, "segments_of_frames", lambda *a: (seen.append(restarts.segments_of_frames(*a)), whole(*a))[1])
    assert got == shown(OPERATORS[name](found, frames)) and got
    if seen:  # many more tasks than sources
        cut = {r.source: (r.segments, r.rows) for r in restarts.cuts(seen[0], ["source"]).collect()}
        assert all(n > 5 for n, _ in cut.values()) and sum(r for _, r in cut.values()) == len(ticks)


def test_a_source_that_is_never_quiet_stays_whole(spark):
    frames = spark.createDataFrame([("a", k * SECOND) for k in range(50)], "source string, t long")
    cut = restarts.segments_of_frames(frames, frames, F.col("before") > F.col("was"))
    assert [tuple(r) for r in restarts.cuts(cut, ["source"]).collect()] == [("a", 1, 50, 50)]


@pytest.mark.parametrize("rows_a_bucket", [1, 7, 1 << 40])
def test_neighbours_and_running_values_go_over_buckets(spark, monkeypatch, rows_a_bucket):
    monkeypatch.setattr(restarts, "ROWS", rows_a_bucket)
    dice = random.Random(2)
    rows = [(k, t, dice.choice([None, dice.randrange(9)])) for k in ("a", "b", None) for t in dice.sample(range(1000), 60)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    width = restarts.bucket_width(df)
    assert (width is None) == (rows_a_bucket > len(rows))
    own = restarts.beside(df, ["k"], "t", width, {"was": "v", "was_t": "t"}, {"next_t": "t"})
    own = restarts.running(own, ["k"], "t", width, "top", F.col("v"))
    own = restarts.running(own, ["k"], "t", width, "least_on", F.col("v"), F.min, back=True)
    own = restarts.running(own, ["k"], "t", width, "sum", F.col("v"), F.sum)
    want = set()
    for key in ("a", "b", None):
        line = sorted((t, v) for k, t, v in rows if k == key)
        for n, (t, v) in enumerate(line):
            some, on = [x for _, x in line[: n + 1] if x is not None], [x for _, x in line[n:] if x is not None]
            before, after = line[n - 1] if n else (None, None), line[n + 1] if n + 1 < len(line) else (None, None)
            want.add((key, t, v, before[1], before[0], after[0], max(some, default=None), min(on, default=None), sum(some)))
    assert {tuple(r) for r in own.collect()} == want


@pytest.mark.parametrize("quiet", [0, 5, 40])
def test_repeats_are_let_through_as_one_fold_would(spark, monkeypatch, quiet):
    monkeypatch.setattr(restarts, "ROWS", 30)
    dice = random.Random(9)
    rows = [(k, t, f"{k}{t}") for k in ("a", "b", "c") for t in dice.sample(range(2000), 150)]
    want = []
    for key in ("a", "b", "c"):
        last = None
        for k, t, name in sorted(rows):
            if k == key and (last is None or t - last >= quiet):
                want.append((k, t, name))
                last = t
    df = spark.createDataFrame(rows, "k string, t long, name string")
    assert sorted(tuple(r) for r in sequential.suppressed_repeats(df, "k", quiet).collect()) == sorted(want)


@pytest.mark.parametrize("least", [1, 3])
def test_audio_events_are_those_of_one_fold(spark, monkeypatch, least):
    monkeypatch.setattr(restarts, "ROWS", 25)
    dice = random.Random(5)
    windows = [(s, t * SECOND // 4, {"Siren": dice.random(), "Machine gun": dice.random(), "Other": 1.0}) for s in ("a", "b") for t in sorted(dice.sample(range(600), 300))]
    want = []
    for source in ("a", "b"):
        for name, label, least_score, quiet in (("alarm", "Siren", 0.40, SECOND), ("gunshot", "Machine gun", 0.35, 0)):
            run, last = 0, None
            for s, t, scores in windows:
                if s != source:
                    continue
                run = run + 1 if scores[label] >= least_score else 0
                if run >= least and (last is None or t >= last + quiet):
                    run, last = 0, t
                    want.append((t, source, name, scores[label]))
    got = sequential.audio_events(spark.createDataFrame(windows, "source string, t long, scores map<string,double>"), least_consecutive=least)
    assert sorted((r.t, r.source, r.arguments["class"], r.confidence) for r in got.collect()) == sorted(want)


def test_followers_across_sources_are_found_over_the_borders_of_cells(spark):
    dice = random.Random(8)
    rows = []
    for k in range(220):
        x, y, vx, vy = dice.uniform(-40, 40), dice.choice([0.0, 15.0, dice.uniform(-40, 40)]), dice.choice([-1.0, 0.0, 1.0, 2.0]), dice.choice([0.0, 1.0, None])
        rows.append((f"s{k % 3}", dice.randrange(0, 4 * SECOND), f"o{k % 90}", "car", 0.9, 0.0, 0.0, 10.0, 10.0, x, y, dice.choice(["map", "map", None]), vx, vy, 3))
    rows += [("s0", 0, "far", "car", 0.9, 0.0, 0.0, 1.0, 1.0, float("inf"), 1e300, "map", 1.0, 0.0, 3), ("s1", 0, "near", "car", 0.9, 0.0, 0.0, 1.0, 1.0, float("-inf"), 0.0, "map", 1.0, 0.0, 3)]
    want = Counter()
    for a in rows:
        for b in rows:
            if a[0] == b[0] or a[2] == b[2] or abs(a[1] - b[1]) >= SECOND or a[11] is None or a[11] != b[11] or None in (*a[12:14], *b[12:14]):
                continue
            dx, dy, va, vb = a[9] - b[9], a[10] - b[10], (a[12] ** 2 + a[13] ** 2) ** 0.5, (b[12] ** 2 + b[13] ** 2) ** 0.5
            if va > 1e-9 and vb > 1e-9 and a[12] * b[12] + a[13] * b[13] >= 0.5 * va * vb and dx * a[12] + dy * a[13] > 0 and (dx * dx + dy * dy) ** 0.5 <= 15:
                want[max(a[1], b[1]), a[0], a[2], b[2]] += 1
    got = tracks.follows_across(spark.createDataFrame(rows, TRACKS)).collect()
    assert Counter((r.t, r.source, r.arguments["leader"], r.arguments["follower"]) for r in got) == want and want
