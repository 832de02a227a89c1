import itertools
import json
import math
import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import vectors as V
from wayline.operators import audio, evidence, identity, sequential, tracks, workload
from wayline.operators.components import components
from wayline.sources import recordings

S = 1_000_000
TRACK = "source string, t long, object_id string, class string, confidence double, x1 double, y1 double, x2 double, y2 double, world_x double, world_y double, world_frame string, velocity_x double, velocity_y double, age int"


def track(t, who, kind="car", x=100.0, y=100.0, conf=0.9, age=5, v=(None, None), world=None, size=20.0):
    w = world or (None, None)
    return ("cam", t, who, kind, conf, x, y, x + size, y + size, w[0], w[1], "map" if world else None, v[0], v[1], age)


def frames(spark, times, size=None):
    rows = [("cam", t, size, size) for t in times]
    return spark.createDataFrame(rows, "source string, t long, frame_width double, frame_height double") if size else spark.createDataFrame([r[:2] for r in rows], "source string, t long")


def found(df):
    return sorted((r.t / S, r.predicate, *(v for _, v in sorted(r.arguments.items()))) for r in df.collect())


def test_visibility(spark):
    half = S // 2
    times = [k * half for k in range(20)]
    rows = [track(t, "x") for t in times[:8]] + [track(t, "x", conf=0.3) for t in times[14:16]] + [track(times[16], "x")]
    df, clock = spark.createDataFrame(rows, TRACK), frames(spark, times)
    assert found(tracks.present(df, clock)) == [(0.0, "present", "x"), (8.0, "present", "x")]
    # last seen at 3.5, first missed at 4.0, proven gone at 5.5; the second visit is too short
    assert found(tracks.exits(df, clock)) == [(5.5, "exits", "x")]
    inside = frames(spark, times, 1000.0)
    assert found(tracks.exits(df.withColumns({"x1": F.lit(480.0), "x2": F.lit(520.0), "y1": F.lit(480.0), "y2": F.lit(520.0)}), inside)) == []


def test_a_short_absence_is_no_exit(spark):
    times = [k * S for k in range(6)]
    rows = [track(t, "x") for t in (0, S, 3 * S, 4 * S)]
    assert found(tracks.exits(spark.createDataFrame(rows, TRACK), frames(spark, times))) == []


def test_entries_and_replacements(spark):
    times = [k * S for k in range(8)]
    rows = [track(t, "old", age=k + 1) for k, t in enumerate(times[:3])]
    rows += [track(t, "new", x=100 + 30.0 * k, age=k + 1) for k, t in enumerate(times[3:])]  # takes the old one's place
    rows += [track(t, "far", x=500 + 30.0 * k, age=k + 1) for k, t in enumerate(times[2:])]
    assert found(sequential.enters(spark.createDataFrame(rows, TRACK), frames(spark, times, 1000.0))) == [(4.0, "enters", "far")]


def test_motion_and_pairs(spark):
    rows = [track(0, "a"), track(S, "a", x=140.0), track(2 * S, "a", x=141.0), track(2 * S, "b", x=180.0), track(2 * S, "c", x=900.0)]
    df = spark.createDataFrame(rows, TRACK)
    assert found(tracks.moving(df)) == [(1.0, "moving", "a")]
    assert found(tracks.near(df, both=False)) == [(2.0, "near", "a", "b")]
    pair = [track(0, "lead", x=150.0, v=(5.0, 0.0)), track(0, "tail", v=(4.0, 1.0)), track(0, "away", x=120.0, v=(-5.0, 0.0))]
    assert found(tracks.follows(spark.createDataFrame(pair, TRACK))) == [(0.0, "follows", "tail", "lead")]


@pytest.mark.parametrize("crowd", [200, 3])
def test_pairs_of_large_frames(spark, monkeypatch, crowd):
    """Objects of many sizes, some placed in one of two worlds, against all pairs: as they are, and cut into cells."""
    monkeypatch.setattr(tracks, "CROWD", crowd)
    dice = random.Random(9)
    one = lambda t, k: track(t, f"o{k}", dice.choice(["person", "car", "dog", "odd"]), dice.uniform(-300, 900), dice.uniform(0, 500), v=(dice.uniform(-2, 2), dice.uniform(-2, 2)), world=dice.choice([None, (dice.uniform(-9, 30), dice.uniform(0, 30))]), size=dice.choice([0.2, 3.0, 20.0, 60.0, 250.0]))
    rows = [list(one(t, k)) for t, n in ((0, 70), (1, 3), (2, 40)) for k in range(n)]
    for r in rows[::3]:
        r[11] = r[11] and "other"
    rows += [["cam", 0, "none", "car", 0.9, *[None] * 9, 5], ["cam", 0, "far", "car", 0.9, 1e300, 0.0, 1e300, 20.0, None, None, None, 1.0, 0.0, 5]]
    df = spark.createDataFrame(rows, TRACK)

    def told(test):
        return sorted((a[1] / S, a[2], b[2]) for a, b in itertools.permutations([r for r in rows if r[5] is not None], 2) if a[1] == b[1] and test(a, b))

    wide = lambda r: r[7] - r[5]
    same = lambda a, b: a[9] is not None and b[9] is not None and a[11] == b[11]
    apart = lambda a, b: math.hypot((a[5] + a[7] - b[5] - b[7]) / 2, (a[6] + a[8] - b[6] - b[8]) / 2)
    gap = lambda a, b: apart(a, b) / max((wide(a) + wide(b)) / 2, 1.0)
    world = lambda a, b: math.hypot(a[9] - b[9], a[10] - b[10])
    nominal = lambda r: {"person": 0.55, "car": 4.0, "dog": 0.8}.get(r[3], 1.0)
    metres = lambda a, b: world(a, b) if same(a, b) else gap(a, b) * (nominal(a) + nominal(b)) / 2
    clear = lambda a, b: iou(a[5:9], b[5:9]) <= 0
    names = lambda df: [(t, a, b) for t, _, a, b in found(df)]
    want = told(lambda a, b: clear(a, b) and (world(a, b) <= 5 if same(a, b) else gap(a, b) <= 1.5))
    assert names(tracks.near(df, max_gap=1.5)) == want and len(want) > 50
    assert names(tracks.near(df, max_distance_m=2.0)) == told(lambda a, b: clear(a, b) and metres(a, b) <= 2)
    people = told(lambda a, b: a[3] == b[3] == "person" and metres(a, b) <= 2.5)
    speech = spark.createDataFrame([("cam", t, 2, "x") for t in range(3)], "source string, t long, speakers int, text string")
    assert names(tracks.conversations(df, speech)) == people and people
    # all pairs of the rule itself
    monkeypatch.setattr(tracks, "CROWD", 10**9)
    every = names(tracks.follows(df, 4.0))
    monkeypatch.setattr(tracks, "CROWD", crowd)
    assert names(tracks.follows(df, 4.0)) == every and every


def test_no_object_looks_beyond_the_others_of_its_frame(spark, monkeypatch):
    """Cells wider than the frame: an object is in one spot a level and side, not in nine."""
    monkeypatch.setattr(tracks, "CROWD", 3)
    dice = random.Random(4)
    rows = [track(0, f"o{k}", "person", dice.uniform(10, 900), dice.uniform(10, 500), size=60.0) for k in range(40)]
    df = spark.createDataFrame(rows, TRACK)
    looking, found = tracks.placed(df, 100.0, False, 100.0)
    assert (looking.count(), found.count()) == (80, 40)
    pairs = tracks.close_pairs(df, 100.0, False, 100.0).select("a.object_id", "b.object_id").collect()
    assert len(pairs) == len(set(pairs)) == 40 * 39


def test_pairs_of_few_rows_are_many_tasks(spark):
    rows = [track(k % 30, f"o{k}") for k in range(300)]
    pairs = tracks.close_pairs(spark.createDataFrame(rows, TRACK), 4.0, True, 5.0)
    assert len(set(r.p for r in pairs.select(F.spark_partition_id().alias("p")).collect())) > 4


def test_boarding(spark):
    car = lambda t, x: track(t, "car", x=x, world=(x, 0.0), v=(0.0, 0.0))
    man = lambda t, x: track(t, "man", "person", x=x, world=(x, 1.0))
    rows = [car(0, 0.0), man(0, 1.0), car(S, 0.0), man(S, 1.0), car(2 * S, 0.0), car(3 * S, 3.0)]
    assert found(sequential.boarding(spark.createDataFrame(rows, TRACK), frames(spark, [k * S for k in range(4)]))) == [(3.0, "boards", "man", "car")]
    rows = [car(0, 0.0), car(S, 0.0), car(2 * S, 0.0), man(2 * S, 1.0), car(3 * S, 0.0), man(3 * S, 7.0)]
    assert found(sequential.boarding(spark.createDataFrame(rows, TRACK), frames(spark, [k * S for k in range(4)]))) == [(3.0, "disembarks", "man", "car")]


def test_custody(spark):
    rows = []
    for k in range(8):
        rows += [track(k * S, "bag", "backpack", world=(0.0 if k < 4 else 10.0, 0.0)), track(k * S, "p", "person", world=(0.5, 0.0)), track(k * S, "q", "person", world=(10.5, 0.0))]
    assert found(sequential.transfers(spark.createDataFrame(rows, TRACK), frames(spark, [k * S for k in range(8)]))) == [(5.0, "transfer", "p", "bag", "q")]


def test_tracker(spark):
    box = lambda x: ("car", 0.9, x, 0.0, x + 10, 10.0)
    schema = "source string, t long, detections array<struct<class:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"
    df = spark.createDataFrame([("c", 0, [box(0.0), box(100.0)]), ("c", S, [box(2.0), box(101.0)]), ("c", 2 * S, [])] + [("c", k * S, []) for k in range(3, 9)] + [("c", 9 * S, [box(2.0)])], schema)
    got = {(r.t // S, r.object_id): (r.age, r.velocity_x) for r in sequential.track_objects(df).collect()}
    assert got == {(0, "c:track_1"): (1, None), (0, "c:track_2"): (1, None), (1, "c:track_1"): (2, 2.0), (1, "c:track_2"): (2, 1.0), (9, "c:track_3"): (1, None)}


def iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / whole if whole else 0.0


def test_the_tracker_box_by_box(spark):
    """Against the rule told plainly: over ten tracks, many ties."""
    dice = random.Random(4)
    frames_ = [("c", k * S, [("car" if dice.random() < 0.7 else "bus", 0.9, x := 10.0 * dice.randint(0, 12), 0.0, x + 20.0, 20.0) for _ in range(dice.randint(0, 14))]) for k in range(40)]
    known, n, want = {}, 0, []
    for _, t, boxes in frames_:
        pairs = sorted(((iou(b[1], d[2:]), i, k) for i, b in known.items() for k, d in enumerate(boxes) if b[0] == d[0] and iou(b[1], d[2:]) >= 0.25), reverse=True)
        took, used = {}, set()
        for _, i, k in pairs:
            if i not in took and k not in used:
                took[i] = k
                used.add(k)
        for i, k in took.items():
            known[i] = [boxes[k][0], boxes[k][2:], 0, known[i][3] + 1]
        for k, d in enumerate(boxes):
            if k not in used:
                n += 1
                took[n], known[n] = k, [d[0], d[2:], 0, 1]
        want += [(t, f"c:track_{i}", known[i][0], known[i][1][0], known[i][3]) for i in took]
        for i in [i for i in known if i not in took]:
            known[i][2] += 1
            if known[i][2] > 5:
                del known[i]
    schema = "source string, t long, detections array<struct<class:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"
    got = [(r.t, r.object_id, r["class"], r.x1, r.age) for r in sequential.track_objects(spark.createDataFrame(frames_, schema)).collect()]
    assert sorted(got) == sorted(want) and n > 15


def test_suppression_of_boxes(spark):
    rows = [("c", 0, "car", 0.9, 0.0, 0.0, 10.0, 10.0), ("c", 0, "car", 0.8, 1.0, 0.0, 11.0, 10.0), ("c", 0, "car", 0.7, 50.0, 0.0, 60.0, 10.0)]
    df = spark.createDataFrame(rows, "source string, t long, class string, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.confidence for r in sequential.suppressed_boxes(df).collect()) == [0.7, 0.9]
    dice = random.Random(6)
    rows = [("c", k // 30, dice.choice(["car", "bus"]), (conf := dice.random()), x := dice.uniform(0, 40), 0.0, x + 20, 20.0) for k in range(120)]
    want = []
    for t in range(4):
        kept = []
        for r in sorted((r for r in rows if r[1] == t), key=lambda r: -r[3]):
            if all(r[2] != o[2] or iou(r[4:], o[4:]) <= 0.45 for o in kept):
                kept.append(r)
        want += kept
    got = sequential.suppressed_boxes(spark.createDataFrame(rows, df.schema)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) < 120


def test_audio(spark):
    rows = [("m", k * S // 2, {"Siren": 0.9, "Machine gun": 0.1}) for k in range(5)]
    df = spark.createDataFrame(rows, "source string, t long, scores map<string,double>")
    assert found(sequential.audio_events(df)) == [(0.0, "audio_event", "alarm"), (1.0, "audio_event", "alarm"), (2.0, "audio_event", "alarm")]
    v = spark.createDataFrame([("m", 0, [1.0, 0.0]), ("m", 1, [0.9, 0.1]), ("m", 2, [0.0, 1.0])], "source string, t long, vector array<double>")
    assert [r.speaker_id for r in sequential.speakers(v).orderBy("t").collect()] == ["speaker_1", "speaker_1", "speaker_2"]
    one = spark.createDataFrame([([0.0, 0.5, -0.5, 0.5],)], "s array<double>")
    rms, voice, vector = one.select(V.rms(F.col("s")), V.voice(F.col("s")), V.speaker_vector(F.col("s"))).first()
    assert rms == pytest.approx(math.sqrt(0.75 / 4)) and voice == 1.0 and vector[2] == pytest.approx(2 / 3)
    assert spark.range(1).select(V.bearing_error(F.lit(350.0), F.lit(10.0))).first()[0] == 20


def test_gate_windows_and_as_of(spark):
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate([0.0, 5.0, 3.0, 1.0, 3.0])], "source string, t long, level double")
    assert [r.t for r in evidence.gated(df, F.col("level"), 4, 2).orderBy("t").collect()] == [1, 2]
    left = spark.createDataFrame([("s", 1), ("s", 5), ("u", 1)], "source string, t long")
    right = spark.createDataFrame([("s", 1, "a"), ("s", 4, "b"), ("s", 6, "c")], "source string, t long, v string")
    assert sorted((r.source, r.t, r.v) for r in evidence.latest_per_stream(left, right, "source", "v").collect()) == [("s", 1, "a"), ("s", 5, "b"), ("u", 1, None)]
    cut = evidence.tumbling(spark.createDataFrame([("s", 0, [0.1] * 5)], "source string, t long, samples array<double>"), "samples", 2, 1000)
    assert sorted((r.t, len(r.samples)) for r in cut.collect()) == [(0, 2), (S, 2), (2 * S, 1)]


def test_recent_evidence(spark):
    openers = spark.createDataFrame([("k", 100, 5, "a"), ("k", 10, 1, "b"), ("m", 7, 1, "c"), (None, 50, 9, "d")], "key string, t long, seq long, name string")
    held = spark.createDataFrame([("k", 20, 2), ("k", 60, 3), ("k", 95, 4), ("k", 100, 6), (None, 40, 8)], "key string, t long, seq long")
    rows = {r["name"]: (r["evidence_t"], r["evidence_seq"]) for r in evidence.with_recent_evidence(openers, held, 40).collect()}
    # the newest before a is at 95, so 60 is kept and 20 is not; b has nothing before it; m has none at all
    assert rows == {"a": (60, 3), "b": (20, 2), "c": (None, None), "d": (40, 8)}
    assert evidence.with_recent_evidence(openers.limit(0), held, 40).count() == 0


def test_identity(spark):
    pairs = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.95), ("b", "y", 0.9), ("b", "x", 0.8)], "left_id string, right_id string, similarity double")
    assert sorted((r.left_id, r.right_id) for r in identity.one_to_one(pairs).collect()) == [("a", "y"), ("b", "x")]
    seen = spark.createDataFrame([("a", 3, "car"), ("x", 1, "car"), ("y", 2, "person"), ("z", 0, "car")], "object_id string, first_seen long, class string")
    named = {r.object_id: (r.canonical_id, r.conflict) for r in identity.identities(seen, spark.createDataFrame([("a", "x"), ("a", "y")], "left_id string, right_id string")).collect()}
    assert named == {"a": ("x", True), "x": ("x", True), "y": ("x", True), "z": ("z", False)}


@pytest.mark.parametrize("most", [identity.LINKS, 5])
def test_one_to_one_is_the_greedy_choice(spark, most):
    """A thicket with ties, a chain and a star, in one task a component and, above five pairs, by rounds."""
    dice = random.Random(3)
    rows = [(a, b, dice.randint(1, 9) / 10) for a in range(14) for b in range(14) if a != b and dice.random() < 0.4]
    rows += [(100 + k // 2, 200 + (k + 1) // 2, 0.5 + k / 1000) for k in range(8)] + [(300, 400 + k, 0.5) for k in range(4)]
    left, right, want = set(), set(), []
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.append((a, b))
    got = identity.one_to_one(spark.createDataFrame([*rows, (None, 1, 0.9)], "left_id int, right_id int, similarity double"), most).collect()
    assert sorted((r.left_id, r.right_id) for r in got) == sorted(want)
    assert identity.one_to_one(spark.createDataFrame([], "left_id int, right_id int, similarity double"), most).count() == 0


@pytest.mark.parametrize("block,least,pairs", [(identity.BLOCK, 0.9, None), (100, 0.9, None), (100, 0.0, [(2, 0)])])
def test_an_open_gap_finds_every_pair(spark, monkeypatch, block, least, pairs):
    """Clusters of two models against all pairs, cut into blocks; vectors that are zero, null, odd or of another length."""
    monkeypatch.setattr(identity, "BLOCK", block)
    g = np.random.default_rng(1)
    base = g.normal(size=(20, 8))
    v = [(i, i % 3, "m" if i % 5 else "k", (base[i % 20] + g.normal(size=8) * 0.3).tolist()) for i in range(400)]
    v += [(700, 0, "m", [0.0] * 8), (701, 1, "m", None), (702, None, "m", [1.0] * 8), (703, 1, "m", [1.0, 2.0]), (704, 2, "m", [2.0, 1.0]), (705, 2, "m", [])]
    cosine = lambda x, y: np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y) or 1.0)
    meets = lambda s, r: s is not None and r is not None and s < r and (pairs is None or (s, r) in pairs or (r, s) in pairs)
    want = {(i, j) for i, s, m, x in v for j, r, k, y in v if x and y and m == k and len(x) == len(y) and meets(s, r) and cosine(x, y) >= least}
    odd = [(706, 1, "m", [float("nan")] * 8), (707, 2, "m", [1.0] * 7 + [None])]
    rows = spark.createDataFrame(v + odd, "object_id int, source int, model string, vector array<double>").withColumn("t", F.lit(0))
    got = [tuple(r) for r in identity.association_candidates(rows, None, least, pairs).select("left_id", "right_id").collect()]
    assert len(got) == len(want) and set(got) == want
    assert identity.association_candidates(rows.limit(0), None, least, pairs).count() == 0


def test_exits_go_by_the_centre(spark):
    """A wide box in the middle of the frame does not exit, a small one near a side does; confidence is the lesser one."""
    times = [k * S for k in range(8)]
    rows = [track(t, "wide", x=200.0, y=400.0, size=600.0) for t in times[:4]] + [track(t, "small", x=30.0, y=490.0) for t in times[:4]]
    assert found(tracks.exits(spark.createDataFrame(rows, TRACK), frames(spark, times, 1000.0))) == [(6.0, "exits", "small")]
    rows = [track(0, "a", conf=0.4), track(S, "a", x=140.0, conf=0.8)]
    assert [r.confidence for r in tracks.moving(spark.createDataFrame(rows, TRACK)).collect()] == [0.4]
    people = spark.createDataFrame([track(0, "p", "person", conf=0.9), track(0, "q", "Person", x=110.0, conf=0.8)], TRACK)
    speech = spark.createDataFrame([("cam", 0, 2, "hello", 0.3), ("cam", 0, 1, "x", 0.1)], "source string, t long, speakers int, text string, confidence double")
    assert {r.confidence for r in tracks.conversations(people, speech).collect()} == {0.3}


@pytest.mark.parametrize("few", [8000, 0])
def test_components(spark, few, monkeypatch):
    from wayline.operators import components as C

    monkeypatch.setattr(C, "FEW", few)
    edges = [(k, k + 1) for k in range(30)] + [(100, 102), (102, 101), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_workload(spark):
    links = spark.createDataFrame([("a", "b", 1.0, 10.0), ("b", "c", 1.0, None), ("a", "c", 5.0, 7.0)], "src string, dst string, latency_ms double, mbps double")
    got = {(r.src, r.dst): (r.latency_ms, r.mbps) for r in workload.shortest_paths(links).collect()}
    assert got[("a", "c")] == (2.0, None)
    providers = spark.createDataFrame([("cam", None, "video", True), ("det", "video", "boxes", True), ("trk", "boxes", "tracks", True), ("alt", "video", "tracks", True), ("off", "video", "tracks", False)], "provider string, input string, output string, enabled boolean")
    assert sorted(r.chain for r in workload.recipes(providers, "tracks").collect()) == [["cam", "alt"], ["cam", "det", "trk"]]
    ms = spark.range(1).select(workload.transfer_ms(F.lit(5.0), F.lit(8.0), F.lit(1_000_000))).first()[0]
    assert ms == 1005.0


def test_recipe_trees_take_all_inputs(spark):
    rows = [("cam", ["video"], "boxes", True), ("cam2", ["video"], "boxes", True), ("trk", ["boxes"], "tracks", True), ("av", ["tracks", "audio"], "talk", True), ("loop", ["talk"], "boxes", True), ("off", ["audio"], "talk", False), ("none", [], "map", True), ("both", ["map", "talk"], "view", True)]
    df = spark.createDataFrame(rows, "provider string, inputs array<string>, output string, enabled boolean")

    def brute(target, stack=()):
        if target in ("video", "audio"):
            return [target]
        out = []
        for provider, inputs, output, on in rows:
            if on and output == target and target not in stack:
                choices = [brute(i, (*stack, target)) for i in inputs]
                for combination in itertools.product(*choices):
                    out.append(f"{provider}({','.join(combination)})")
        return out

    for target in ("boxes", "talk", "view", "map"):
        assert sorted(r.recipe for r in workload.recipe_trees(df, ["video", "audio"], target).collect()) == sorted(brute(target))
    assert workload.recipe_trees(df, ["video", "audio"], "talk", most=1).count() == 1


def test_what_is_fed_starts_first(spark):
    actions = spark.createDataFrame([("n", p, "START") for p in "abcd"] + [("n", "k", "KEEP"), ("m", "a", "START")], "node string, provider string, action string")
    feeds = spark.createDataFrame([("n", "a", "b"), ("n", "b", "c"), ("n", "a", "c"), ("n", "c", "k"), ("m", "a", "z")], "node string, provider string, consumer string")
    got = {(r.node, r.provider): r.turn for r in workload.start_order(actions, feeds).collect()}
    assert got == {("n", "a"): 2, ("n", "b"): 1, ("n", "c"): 0, ("n", "d"): 0, ("m", "a"): 0}


def test_the_leading_candidate(spark):
    rows = [("e", 1, 3, 0, None, 5), ("e", 2, 3, 1, 9, 6), ("e", 3, 3, 1, 8, 7), ("e", 4, 2, 1, 1, 1)]
    df = spark.createDataFrame(rows, "event string, candidate int, satisfied int, completed int, completed_at int, matched_at int")
    assert [r.candidate for r in evidence.leading(df, 4).collect()] == [3]


def test_shortest_paths_have_no_limit_of_hops(spark):
    schema = "src string, dst string, latency_ms double, mbps double"
    ring = [(f"n{k}", f"n{(k + 1) % 20}", 1.0 + k % 5, 100.0) for k in range(20)]
    got = {(r.src, r.dst): r.latency_ms for r in workload.shortest_paths(spark.createDataFrame(ring, schema)).collect()}
    assert got == {(f"n{a}", f"n{(a + m) % 20}"): sum(1.0 + (a + k) % 5 for k in range(m)) for a in range(20) for m in range(1, 20)}
    # a path as short as another, but wider, is found later; what follows it gets wider too
    wide = [("x", "p", 1.0, 9.0), ("p", "q", 1.0, 9.0), ("q", "y", 1.0, 9.0), ("x", "y", 3.0, 1.0), ("y", "v", 1.0, 9.0), ("v", "u", 1.0, 9.0)]
    got = {(r.src, r.dst): (r.latency_ms, r.mbps) for r in workload.shortest_paths(spark.createDataFrame(wide, schema)).collect()}
    assert got["x", "u"] == (5.0, 9.0)
    with pytest.raises(ValueError, match="negative"):
        workload.shortest_paths(spark.createDataFrame([("a", "b", -1.0, 1.0), ("b", "a", 0.0, 1.0)], schema))


def test_store(spark):
    store = spark.createDataFrame([(1, "a")], "id long, v string")
    fresh = spark.createDataFrame([(1, "b"), (2, "c")], "id long, v string")
    assert sorted(map(tuple, evidence.added(store, fresh, "id").collect())) == [(1, "a"), (2, "c")]


def test_files(spark, tmp_path):
    (tmp_path / "mic").mkdir()
    with wave.open(str(tmp_path / "mic" / "20240101_120000.wav"), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(100)
        f.writeframes(struct.pack("<250h", *([16384] * 250)))
    rows = recordings.read_wav(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r.t, len(r.samples)) for r in rows] == [(0, 100), (S, 100), (2 * S, 50)] and rows[0].samples[0] == 0.5
    seen = recordings.recordings(spark, str(tmp_path)).first()
    assert seen.device == "mic" and str(seen.start) == "2024-01-01 12:00:00"
    frame = {"type": "detections", "source_id": "c", "event_time": "2024-01-01T00:00:00Z", "frame_id": "1", "image_width": 10, "image_height": 10, "detections": [{"class_name": "car", "confidence": 0.5, "bbox": [1, 2, 3, 4], "detection_id": "d"}]}
    (tmp_path / "d.json").write_text(json.dumps(frame))
    got = recordings.read_detections(spark, str(tmp_path / "d.json")).first()
    assert got.detections[0].x2 == 3 and got.frame_width == 10
    (tmp_path / "odd.json").write_text(json.dumps(frame | {"surprise": 1}) + "\n")
    (tmp_path / "odder.json").write_text(json.dumps(frame | {"detections": [frame["detections"][0] | {"mask": 1}]}) + "\n")
    for name in ("odd", "odder"):
        with pytest.raises(Exception, match="unknown fields: (surprise|mask)"):
            recordings.read_detections(spark, str(tmp_path / f"{name}.json")).collect()
    with pytest.raises(ValueError):
        recordings.replay_sources(spark, {"version": 2})
    manifest = {"version": 1, "replay_id": "r", "sources": [{"source_id": "c", "modality": "video", "segments": [{"path": "a.mp4", "event_time_start": "2024-10-08T15:08:23Z", "duration_seconds": 2.5}, {"path": "b.mp4", "event_time_start": "2024-10-08T17:08:26+02:00", "duration_seconds": 1.0}]}]}
    got = recordings.replay_sources(spark, manifest).orderBy("path").collect()
    assert [(r.path, str(r.event_time_start), r.duration_seconds) for r in got] == [("a.mp4", "2024-10-08 15:08:23", 2.5), ("b.mp4", "2024-10-08 15:08:26", 1.0)]
    manifest["sources"][0]["segments"][0]["event_time_start"] = "2024-10-08T15:08:23"
    with pytest.raises(ValueError, match="time zone"):
        recordings.replay_sources(spark, manifest)
    (tmp_path / "a+b (1)" / "mic").mkdir(parents=True)
    (tmp_path / "a+b (1)" / "mic" / "20240101_120000.wav").write_bytes(b"x")
    assert recordings.recordings(spark, str(tmp_path / "a+b (1)")).first().device == "mic"


def test_completions_round_trip(spark, sf, tmp_path):
    from wayline.queries import QUERIES

    done = QUERIES["seq_within_greedy"](spark, sf)
    recordings.write_completions(done, ["U"], str(tmp_path / "out"))
    back = recordings.read_completions(spark, str(tmp_path / "out"))
    assert back.count() == 69 and set(back.first().bindings) == {"U"}


def test_bearings(spark):
    import numpy as np

    dice = np.random.default_rng(0)
    sound = dice.standard_normal(400)
    for delay in (-3, 0, 4):
        bearing, sure = audio.phase_delay(np.roll(sound, delay), sound, 16000, 0.2)
        assert bearing == pytest.approx(np.degrees(np.arcsin(delay / 16000 * 343 / 0.2)), abs=1e-6) and 0 < sure <= 1
    rows = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0], 100), (2, None, [1.0], 100)], "id int, left array<double>, right array<double>, rate int")
    assert {r.id: r.bearing_degrees for r in audio.localized(rows, 0.5).collect()} == {1: 0.0, 2: None}
    heard = spark.createDataFrame([("s", 0, 355.0, 0.8)], "site string, t long, bearing_degrees double, confidence double")
    seen = spark.createDataFrame([("s", 0, "a", 5.0, 0.9), ("s", 0, "b", 90.0, 0.9)], "site string, t long, object_id string, bearing_degrees double, confidence double")
    assert [(r.object_id, r.error_degrees, r.score) for r in audio.seen_and_heard(heard, seen).collect()] == [("a", 10.0, 0.4)]


def test_progress(spark):
    from wayline.operators.matching import progress_by_key
    from wayline.plans.events import parse_event
    from wayline.plans.matches import SCHEMA

    event = parse_event({"event": "e", "roles": {"X": {"class": "x"}}, "pattern": {"seq": [{"a": {"object": "X"}}, {"within": {"max": "5s", "pattern": {"b": {"object": "X"}}}}]}}, {"a": "object: visual_object", "b": "object: visual_object"}, None)
    rows = [(k, t * S, p, "s", 1.0, "t", {"object": "x"}, {}) for k, (t, p) in enumerate([(0, "a"), (1, "b"), (2, "a"), (9, "a")])]
    got = [(r.bindings, r.satisfied, r.completed, r.expired, r.failures) for r in progress_by_key(event, spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [("X=x", 1, 1, 1, "1: window 1")]


def test_catalogues(spark):
    from wayline.plans.events import EventError, parse_event
    from wayline.sources import catalogues as C

    found = C.signatures({"version": 1, "predicates": {"waves": {"description": "d", "arguments": {"object": "visual_object", "level": {"type": "number", "required": False, "minimum": 0, "maximum": 1}}}}})
    assert found == {"waves": "object: visual_object, level?: number 0..1"}
    parse_event({"event": "e", "roles": {"X": {"class": "person"}}, "pattern": {"waves": {"object": "X", "level": 0.5}}}, found)
    with pytest.raises(EventError, match="unknown type"):
        C.signatures({"version": 1, "predicates": {"waves": {"arguments": {"object": "spirit"}}}})
    document = {
        "version": 1,
        "label_spaces": {"few": {"labels": ["car", "stop sign", "backpack"]}},
        "providers": {
            "eye": {"kind": "visual_detector", "native_label_space": "few", "expose_native_labels_as_semantic_classes": True, "semantic_classes": {"package": ["backpack"]}, "inputs": ["frame"], "outputs": ["boxes"]},
            "old_eye": {"kind": "visual_detector", "native_labels": ["car"], "semantic_classes": {"car": ["car"]}, "enabled": False},
            "ear": {"kind": "predicate_implementation", "predicates": {"audio_event": {"semantic_literals": {"class": {"alarm": {"native_labels": ["Siren"]}}}}}},
            "pair": {"kind": "predicate_implementation", "predicates": {"near": {"visual_arguments": {"object_a": "*", "object_b": ["car"]}}}},
        },
    }
    tables = C.providers(spark, document)
    assert [r.labels for r in C.detectors_of(tables, "stop_sign").collect()] == [["stop sign"]] and C.detectors_of(tables, "car").count() == 1
    asked = lambda predicate, **arguments: [r.provider for r in C.implementers_of(tables, predicate, arguments).collect()]
    assert asked("near", object_a="bus", object_b="car") == ["pair"] and asked("near", object_a="bus", object_b="bus") == [] and asked("audio_event", **{"class": "alarm"}) == ["ear"]
    document["providers"]["eye"]["semantic_classes"]["x"] = ["tree"]
    document["providers"]["pair"]["colour"] = 1
    with pytest.raises(EventError) as e:
        C.providers(spark, document)
    assert "labels that it does not see" in str(e.value) and "unknown field 'colour'" in str(e.value)
    assert C.inventory(spark, {"providers": {"eye": {"implementation": ["a", "b"], "status": "ok"}}}).first().implementations == ["a", "b"]
    plan = {"version": 1, "nodes": {"s": {"cpu_free": 4}, "e": {}}, "sources": {"cam": {"node_id": "s", "data_type": "video"}}, "links": [{"source_node": "s", "destination_node": "e", "latency_ms": 2, "bandwidth_mbps": 10}, {"source_node": "e", "destination_node": "s"}]}
    got = C.deployment(spark, plan)
    assert {(r.src, r.dst): r.mbps for r in workload.shortest_paths(got["links"]).collect()} == {("s", "e"): 10.0, ("e", "s"): None} and got["nodes"].where("cpu = 4").count() == 1
    with pytest.raises(EventError, match="declared"):
        C.deployment(spark, plan | {"sources": {"cam": {"node_id": "nowhere", "data_type": "video"}}})


def test_replay_subscription_and_records(spark):
    a = spark.createDataFrame([(1, "x", ["s1"]), (5, "y", ["s1", "s2"])], "t long, type string, sources array<string>")
    both = evidence.replayed({"one": a, "two": a.where("t = 1").withColumn("t", F.lit(3).cast("long"))})
    assert [(r.t, r.stream) for r in both.collect()] == [(1, "one"), (3, "two"), (5, "one")]
    assert [r.t for r in evidence.subscribed(both, ["x"]).collect()] == [1, 3] and [r.t for r in evidence.subscribed(both, sources=["s1"]).collect()] == [1, 3]
    rows = spark.createDataFrame([("cam", 7, None), ("cam", 7, None), ("cam", 8, 1.5)], "source string, t long, level double")
    kept = evidence.recorded(rows, "level").dropDuplicates(["record_id"]).orderBy("event_time").collect()
    assert [(r.source_id, r.event_time, json.loads(r.payload)) for r in kept] == [("cam", 7, {"source": "cam", "t": 7, "level": None}), ("cam", 8, {"source": "cam", "t": 8, "level": 1.5})]


@pytest.mark.parametrize("n", [30, 400])
def test_the_nearest_are_found_by_rings(spark, n):
    """All the nearest, in image and world, as by brute force, and without a table of pairs."""
    from wayline.functions import geometry as G

    dice = random.Random(n)
    rows = []
    for k in range(n):
        x, y, w = dice.choice([dice.uniform(0, 900), 40.0]), dice.uniform(-300, 500), dice.choice([0.5, 20.0, 45.0, 300.0 if k == 3 else 30.0])
        world = dice.choice([(None, None, None)] * 3 + [(dice.uniform(0, 50), dice.uniform(0, 50), dice.choice("vw"))])
        rows.append(("s", k % 2, f"o{k}", dice.choice(["person", "car", "backpack", "dog"]), 0.9, x, y, x + w, y + 30.0, *world))
    df = spark.createDataFrame(rows, "source string, t long, object_id string, class string, confidence double, x1 double, y1 double, x2 double, y2 double, world_x double, world_y double, world_frame string")
    a, b = df.where("class = 'backpack'").alias("a"), df.where("class IN ('person', 'car')").alias("b")
    every = a.join(b, F.expr("a.t = b.t")).select("a.t", "a.object_id", G.distance_m("a", "b").alias("m"), F.col("b.object_id").alias("h")).collect()
    of = {}
    for r in every:
        of.setdefault((r.t, r.object_id), []).append((r.m, r.h))
    want = {(*who, k + 1, h, m) for who, own in of.items() for k, (m, h) in enumerate(sorted(own)[:2])}
    plan = tracks.nearest_holders(df, 2)
    assert {(r.t, r.item, r["rank"], r.holder, r.metres) for r in plan.collect()} == want and want
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_boarding_is_cut_by_vehicles(spark):
    """A source that is never empty is no single task: nothing is folded along it."""
    rows = [track(k * S, "car", x=100.0) for k in range(4)] + [track(k * S, "car", x=400.0) for k in (4, 5)] + [track(k * S, "p", "person", 110.0) for k in range(3)]
    plan = sequential.boarding(spark.createDataFrame(rows, TRACK), frames(spark, [k * S for k in range(6)]))
    assert found(plan) == [(4.0, "boards", "p", "car")]
    assert "MapInPandas" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_speakers_are_those_of_the_plain_rule():
    """Centroids as arrays choose what sums over all of them choose, also with equal, empty and unknown vectors."""
    draw = np.random.default_rng(5)
    vectors = [*(draw.normal(size=8) + 2 * draw.integers(-1, 2, 8) for _ in range(400)), np.zeros(8), np.eye(8)[0], np.eye(8)[0], np.full(8, 1e-170), np.full(8, np.nan), np.eye(8)[1]]
    draw.shuffle(vectors)
    vectors = [np.array([np.float32(x) for x in v], dtype=np.float64) for v in vectors]
    cosine = lambda v, c: (sum(a * b for a, b in zip(v, c, strict=True)) / d) if (d := math.sqrt(sum(a * a for a in v)) * math.sqrt(sum(b * b for b in c))) else 0.0
    plain, own, found = [], [], sequential.Centroids()
    for v in vectors:
        best = max(((cosine(v.tolist(), c), -k) for k, (c, _) in enumerate(plain)), default=(-1.0, 0))
        sure, at = found.nearest(v, 0.75)
        assert (sure >= 0.75) == (best[0] >= 0.75)
        if best[0] >= 0.75:
            k = -best[1]
            c, n = plain[k]
            plain[k] = ([(a * n + b) / (n + 1) for a, b in zip(c, v.tolist(), strict=True)], n + 1)
            assert at == k and sure == best[0]
            found.put(k, (found.rows[k] * n + v) / (n + 1), n + 1)
        else:
            plain.append((v.tolist(), 1))
            found.put(len(plain) - 1, v, 1)
        own.append(len(plain))
    assert found.members == [n for _, n in plain] and len(plain) > 16
    np.testing.assert_array_equal(found.rows[: len(plain)], [c for c, _ in plain])


def test_blocks_of_an_open_gap_grow_with_the_table():
    """A vector goes to each block of the other side: more vectors make larger blocks, not more, while a task can hold them."""
    assert identity.block_of(2000, 64) == identity.BLOCK and identity.block_of(600_000, 64) == 37_500
    assert identity.block_of(10_000_000, 64) == identity.NUMBERS // 64 and identity.block_of(10_000_000, 4096) == identity.BLOCK


def test_followers_across_are_those_of_all_pairs(spark):
    """Cells behind a leader, slots with a time so near: against all pairs, also far out and at the edges of slots."""
    g = random.Random(4)
    rows = []
    for k in range(300):
        x, y = (g.choice((-1, 1)) * g.uniform(0, 60) for _ in "xy")
        far = g.choice((0.0, 0.0, 0.0, 1e13))
        rows.append((f"cam{k % 3}", g.randrange(-3, 4) * S // 2 + g.choice((0, 0, 1)), f"o{k}", "person", 1.0, 0.0, 0.0, 1.0, 1.0, x + far, y, "w", float(g.randint(-2, 2)), float(g.randint(-2, 2))))
    rows.append(("cam0", 0, "unplaced", "person", 1.0, 0.0, 0.0, 1.0, 1.0, None, 0.0, "w", 1.0, 0.0))
    want = set()
    for a, b in itertools.permutations([r for r in rows if r[9] is not None], 2):
        (ax, ay, av, aw), (bx, by, bv, bw) = (a[9], a[10], a[12], a[13]), (b[9], b[10], b[12], b[13])
        speeds = math.hypot(av, aw) * math.hypot(bv, bw)
        behind = speeds > 0 and av * bv + aw * bw >= 0.5 * speeds and (ax - bx) * av + (ay - by) * aw > 0
        if a[0] != b[0] and abs(a[1] - b[1]) < S and behind and math.sqrt((ax - bx) ** 2 + (ay - by) ** 2) <= 15:
            want.add((max(a[1], b[1]), a[2], b[2]))
    kinds = "source string, t long, object_id string, class string, confidence double, x1 double, y1 double, x2 double, y2 double, world_x double, world_y double, world_frame string, velocity_x double, velocity_y double"
    across = tracks.follows_across(spark.createDataFrame(rows, kinds))
    got = [(r.t, r.arguments["leader"], r.arguments["follower"]) for r in across.collect()]
    assert len(got) == len(set(got)) > 50 and set(got) == want


@pytest.mark.parametrize("pairs", [1 << 20, 7])
def test_what_is_replaced_is_found_by_a_grid(monkeypatch, pairs):
    """Entries are held against what is lost in arrays, a bounded number of pairs at a time, and not object by object."""
    monkeypatch.setattr(sequential, "PAIRS", pairs)
    g = np.random.default_rng(6)
    x = {"t": g.integers(0, 20, 300), "x": g.uniform(-50, 900, 300), "y": g.uniform(0, 500, 300), "size": g.uniform(1, 40, 300)}
    o = {"since": g.integers(0, 15, 200), "x": g.uniform(0, 950, 200), "y": g.uniform(-40, 500, 200), "size": g.uniform(1, 40, 200)}
    o["until"] = o["since"] + g.integers(0, 9, 200)
    x["x"][0], o["y"][0] = np.nan, np.inf
    plain = [any(math.hypot(x["x"][i] - o["x"][j], x["y"][i] - o["y"][j]) <= max(x["size"][i], o["size"][j]) and o["since"][j] <= x["t"][i] <= o["until"][j] for j in range(200)) for i in range(300)]
    assert sequential.replaced(x, o).tolist() == plain and 20 < sum(plain) < 280
    assert not sequential.replaced(x, {k: v[:0] for k, v in o.items()}).any()


def test_overlaps_by_cells_are_those_of_all_pairs():
    dice = np.random.default_rng(3)
    boxes = [np.concatenate([p, p + dice.uniform(-1, 12, (n, 2))], axis=1) for n in (120, 90) for p in [dice.uniform(-40, 60, (n, 2))]]
    boxes[0][5] = np.nan
    boxes[1][7, 2] = np.inf
    for least in (0.1, 0.25, 0.0):
        with np.errstate(invalid="ignore"):
            every = sequential.overlaps(*boxes)
        score, at, spot = sequential.overlapping(*boxes, least, 500)
        assert {(i, k): s for s, i, k in zip(score, at, spot, strict=True)} == {(i, k): every[i, k] for i, k in zip(*np.nonzero(every >= least), strict=True)}


def test_sounds_meet_only_bearings_of_near_sectors(spark):
    angles = [-190.0, -10.0, 0.0, 9.99, 10.0, 30.0, 179.0, 181.0, 350.0, 359.9, 365.0, None]
    sounds = spark.createDataFrame([("p", 1, a, 0.5) for a in angles], "site string, t long, bearing_degrees double, confidence double")
    seen = sounds.withColumn("object_id", F.col("bearing_degrees").cast("string"))
    known = [a for a in angles if a is not None]
    for most in (20.0, 7.0, 90.0, 150.0, 180.0):
        found = audio.seen_and_heard(sounds, seen, most)
        assert "__sector" in found._jdf.queryExecution().optimizedPlan().toString()
        told = sorted((r.object_id, round(r.error_degrees, 6)) for r in found.collect())
        error = lambda a, b: abs((a - b + 180) % 360 - 180)
        assert told == sorted((str(b), round(error(a, b), 6)) for a in known for b in known if error(a, b) <= most)


def test_what_is_seen_and_heard_comes_in_runs(spark):
    """Rows of an object together, by the bearings of the sounds: a column holds few runs of values, not one a row."""
    dice = random.Random(6)
    one = lambda k: (0, 0, f"o{k}", float(dice.randrange(90, 96)), dice.random())
    df = spark.createDataFrame([one(k) for k in range(90)], "site int, t long, object_id string, bearing_degrees double, confidence double")
    rows = audio.seen_and_heard(df.where("object_id < 'o4'"), df.where("object_id >= 'o4'")).select("object_id", "error_degrees").collect()
    assert len(rows) == 34 * 56
    assert len(list(itertools.groupby(rows, lambda r: r.object_id))) == 56
    assert len(list(itertools.groupby(rows))) <= 56 * 6
