"""Stores by time, recordings by ranges of windows, and gates on raw frames, against their rules told plainly."""

import random
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import evidence
from wayline.sources import history, recordings



def seconds(*times):
    return tuple(None if t is None else F.timestamp_seconds(F.lit(t)) for t in times)


def intervals(spark, rows):
    plain = spark.createDataFrame(rows, "id long, a long, b long, x long")
    return plain.select("id", *(F.timestamp_seconds(c).alias(n) for c, n in (("a", "event_start"), ("b", "event_end"), ("x", "expires_at"))))


@pytest.mark.parametrize("how", ["overlap", "contained", "covering"])
def test_a_store_answers_as_its_rows_do(spark, tmp_path, how):
    dice = random.Random(5)
    rows = [(k, a, a + dice.choice([0, 5, 100, 400]), dice.choice([None, 300, 900])) for k in range(120) for a in [dice.randint(-200, 800)]]
    every, path = intervals(spark, rows), str(tmp_path / "store")
    history.store_segments(every.where("id % 2 = 0"), path, "id", 100)
    history.add_segments(every.unionByName(every), path, "id", 100)
    assert history.stored(spark, path).count() == 120
    for a, b in ((100, 200), (150, 151), (-200, 900), (0, 99), (100, 100)):
        start, end, at = seconds(a, b, 400)
        got = sorted(r.id for r in history.segments_between(spark, path, start, end, how, at, 100).collect())
        assert got == sorted(r.id for r in evidence.segments_touching(every, start, end, how, at).collect())


def test_a_store_reads_and_writes_the_buckets_it_needs(spark, tmp_path):
    path = str(tmp_path / "store")
    files = lambda: {p.relative_to(path) for p in (tmp_path / "store").glob("bucket=*/*.parquet")}
    history.store_segments(intervals(spark, [(1, 10, 20, 50), (2, 110, 350, 60), (3, 120, 130, None), (4, 520, 530, 50)]), path, "id", 100)
    before = files()
    assert {p.parts[0] for p in before} == {f"bucket={k}" for k in (0, 1, 2, 3, 5)}
    # what ends before it begins, or has no time, is no interval
    history.add_segments(intervals(spark, [(5, 210, 220, None), (1, 210, 220, None), (6, 90, 80, None), (7, None, 80, None)]), path, "id", 100)
    assert {p.parts[0] for p in files() - before} == {"bucket=2"} and before <= files()
    start, end = seconds(110, 190)
    found = history.segments_between(spark, path, start, end, seconds=100)
    said = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in said and sorted(r.id for r in found.collect()) == [2, 3]
    assert sorted(found.columns) == ["event_end", "event_start", "expires_at", "id"]
    gone = history.expire_segments(spark, path, F.timestamp_seconds(F.lit(60)))
    assert sorted(r.id for r in gone.collect()) == [1, 2, 4] and sorted(r.id for r in history.stored(spark, path).collect()) == [3, 5]
    assert {p.parts[0] for p in files()} == {"bucket=1", "bucket=2"}
    assert history.expire_segments(spark, path, F.timestamp_seconds(F.lit(60))).count() == 0


def test_recordings_are_read_by_ranges_of_windows(spark, tmp_path):
    dice = random.Random(2)
    told = {"long": 2570, "short": 30, "empty": 0}
    (tmp_path / "a b" / "mic").mkdir(parents=True)
    for name, n in told.items():
        with wave.open(str(tmp_path / "a b" / "mic" / f"{name}.WAV" if name == "short" else tmp_path / "a b" / f"{name}.wav"), "wb") as f:
            f.setnchannels(1), f.setsampwidth(2), f.setframerate(100)
            f.writeframes(struct.pack(f"<{n}h", *(dice.randint(-32768, 32767) for _ in range(n))))
    read = recordings.read_wav_windows(spark, str(tmp_path), 500, 7)
    assert read.rdd.getNumPartitions() == 8 + 1
    key = lambda r: (r.path.split("/")[-1], r.t, r.rate, tuple(r.samples))
    got = sorted(map(key, read.collect()))
    assert got == sorted(map(key, recordings.read_wav(spark, str(tmp_path), 500).collect())) + [x for x in got if x[0] == "short.WAV"]
    assert [(x[1], len(x[3])) for x in got if x[0] == "short.WAV"] == [(0, 30)] and len([x for x in got if x[0] == "long.wav"]) == 52
    (tmp_path / "none").mkdir()
    assert recordings.read_wav_windows(spark, str(tmp_path / "none")).count() == 0
    with wave.open(str(tmp_path / "none" / "two.wav"), "wb") as f:
        f.setnchannels(2), f.setsampwidth(2), f.setframerate(100)
        f.writeframes(b"\0" * 400)
    with pytest.raises(Exception, match="not mono"):
        recordings.read_wav_windows(spark, str(tmp_path / "none")).collect()


def test_recordings_are_written_in_the_order_of_time(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, [0.5, 2.0]), ("a", 1, [-0.25]), ("a", 3, None), ("b", 1, [-3.0]), (None, 1, [1.0])], "recording string, t long, samples array<double>")
    done = recordings.write_wav(rows, str(tmp_path / "out"), 8)
    assert sorted((r.recording, r.frames) for r in done.collect()) == [("a", 3), ("b", 1)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a.wav", "b.wav"]
    got = {r.path.split("/")[-1]: r.samples for r in recordings.read_wav(spark, str(tmp_path / "out")).collect()}
    assert got == {"a.wav": [-0.25, 0.5, 32767 / 32768], "b.wav": [-1.0]}
    assert recordings.write_wav(rows.limit(0), str(tmp_path / "nothing"), 8).count() == 0
    # recordings that lie over many partitions are one file each
    many = spark.range(0, 4000, 1, 16).selectExpr("concat('m', id div 300) AS recording", "id AS t", "array(id / 32768D, 0D) AS samples")
    done = recordings.write_wav(many, str(tmp_path / "many"), 8)
    assert done.count() == 14 and {r.frames for r in done.collect()} == {600, 200}


@pytest.mark.parametrize("bucket", [200_000, 3])
def test_levels_of_frames_and_the_gate(spark, monkeypatch, bucket):
    """Frames of one and three channels and of changing shape against the rule in arrays, in one bucket of time and in several."""
    monkeypatch.setattr("wayline.operators.restarts.ROWS", bucket)
    g = np.random.default_rng(4)
    shapes = [(4, 6)] * 5 + [(6, 4)] * 2 + [(150, 5)] * 3 + [(3, 3, 3)] * 3 + [(3, 3, 4)] * 2
    frames = [g.integers(0, 256, s) for s in shapes]
    rows = [("c", k, f.ravel().tolist(), f.shape[0], f.shape[1]) for k, f in enumerate(frames)]
    was, want = None, []
    for f in frames:
        gray = f[..., :3].mean(axis=2) if f.ndim == 3 else f.astype(float)
        gray = gray[:: max(1, gray.shape[0] // 64), :: max(1, gray.shape[1] // 64)]
        want.append(0.0 if was is None or was.shape != gray.shape else float(np.abs(gray - was).mean() / 255))
        was = gray
    rows += [("d", 0, None, 2, 2), ("d", 1, [1, 2], 2, 2), ("d", 2, [], 0, 0), ("d", 3, [9, 9, 9, 9], 2, 2)]
    seen = spark.createDataFrame(rows, "source string, t long, pixels array<int>, height int, width int")
    levels = evidence.frame_levels(seen)
    got = {(r.source, r.t): r.level for r in levels.collect()}
    assert [got["c", k] for k in range(len(frames))] == pytest.approx(want) and {got["d", k] for k in range(4)} == {0.0}
    open_, through = False, []
    for k, x in enumerate(want):
        open_ = x > 0.25 if open_ else x >= 0.33
        through += [k] * open_
    assert sorted(r.t for r in evidence.gated_by_time(levels, F.col("level"), 0.33, 0.25).collect()) == through and 0 < len(through) < len(frames)
    with pytest.raises(ValueError, match="below"):
        evidence.gated_by_time(levels, F.col("level"), 0.1, 0.1)


def test_a_segment_is_shuffled_once_and_copied_where_it_is_written(spark):
    rows = spark.sql("SELECT id AS segment, TIMESTAMP_NTZ'1996-01-01' AS event_start, TIMESTAMP_NTZ'1996-06-01' AS event_end FROM range(10)")
    laid = history._laid_out(rows, history.DAY)
    plan = laid._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("RebalancePartitions") and laid.count() == 10 * 153
