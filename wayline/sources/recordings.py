"""Readers and writers: audio files, recordings by name, detection frames, completions, manifests."""

from __future__ import annotations

import io
import re
import struct
import uuid
import wave
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from wayline.session import written

BOX = "x1: double, y1: double, x2: double, y2: double"
FRAMES = "type string, source_id string, event_time timestamp, frame_id string, image_width double, image_height double, detections array<struct<class_name: string, confidence: double, bbox: array<double>, detection_id: string>>"
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
COMPLETIONS = "event string, completed_at timestamp, matched_at timestamp, matched_source string, bindings map<string,string>, cell_id string, schema_version int"


def read_wav(spark: SparkSession, path: str, window_ms: int = 1000) -> DataFrame:
    """(path, t, rate, samples): windows of mono 16-bit files, scaled to -1..1; t counts microseconds from the start."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with wave.open(io.BytesIO(content.as_buffer())) as f:
                    if f.getnchannels() != 1 or f.getsampwidth() != 2:
                        raise ValueError(f"{name} is not mono 16-bit audio")
                    rate = f.getframerate()
                    size, n = rate * window_ms // 1000, 0
                    while len(data := np.frombuffer(f.readframes(size), dtype="<i2")):
                        t = pa.array([n * 1_000_000 // rate], pa.int64())
                        samples = pa.array([(data / 32768.0).astype(np.float32).tolist()], pa.list_(pa.float32()))
                        yield pa.RecordBatch.from_arrays([pa.array([name]), t, pa.array([rate], pa.int32()), samples], names=["path", "t", "rate", "samples"])
                        n += len(data)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(windows, "path string, t long, rate int, samples array<float>")


class WavWindows(DataSource):
    """spark.read.format("wav_windows").option("window_ms", ...).load(path): what read_wav gives, a partition a range of a
    file's windows, so that one long recording is read by many tasks.

    Options: window_ms (1000) and windows_per_task (4096). path is a file or a folder, searched to any depth, of any file
    system that Arrow knows; driver and executors must see it.
    """

    @classmethod
    def name(cls) -> str:
        return "wav_windows"

    def schema(self) -> str:
        return "path string, t long, rate int, samples array<float>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WavReader(self.options)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))


def _opened(fs: pa_fs.FileSystem, path: str) -> wave.Wave_read:
    f = wave.open(fs.open_input_file(path))
    if f.getnchannels() != 1 or f.getsampwidth() != 2:
        raise ValueError(f"{path} is not mono 16-bit audio")
    return f


def _file_system(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system and the path in it; file:/x, as Hadoop writes it, is a local path."""
    return pa_fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class _WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.window_ms, self.per_task = int(options.get("window_ms", 1000)), int(options.get("windows_per_task", 4096))

    def _size(self, rate: int) -> int:
        return max(1, rate * self.window_ms // 1000)

    def partitions(self) -> list[InputPartition]:
        fs, path = _file_system(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.is_file else fs.get_file_info(pa_fs.FileSelector(path, recursive=True))
        ranges = []
        for name in sorted(f.path for f in found if f.is_file and f.path.lower().endswith(".wav")):
            with _opened(fs, name) as f:
                windows = -(-f.getnframes() // self._size(f.getframerate()))
            ranges += [_Range(name, k, min(k + self.per_task, windows)) for k in range(0, windows, self.per_task)]
        return ranges or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        name, first, last = partition.value
        if first == last:
            return
        fs, _ = _file_system(self.path)
        with _opened(fs, name) as f:
            rate = f.getframerate()
            size = self._size(rate)
            f.setpos(first * size)
            for k in range(first, last, 256):
                n = min(256, last - k)
                data = np.frombuffer(f.readframes(size * n), dtype="<i2")
                starts = np.arange(0, len(data), size, dtype=np.int64)
                samples = pa.ListArray.from_arrays(pa.array(np.append(starts, len(data)), pa.int32()), pa.array((data / 32768.0).astype(np.float32)))
                t = pa.array((starts + k * size) * 1_000_000 // rate)
                columns = [pa.array([name] * len(starts)), t, pa.array([rate] * len(starts), pa.int32()), samples]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "t", "rate", "samples"])


def read_wav_windows(spark: SparkSession, path: str, window_ms: int = 1000, windows_per_task: int = 4096) -> DataFrame:
    """read_wav by ranges of windows (WavWindows)."""
    spark.dataSource.register(WavWindows)
    return spark.read.format("wav_windows").option("window_ms", window_ms).option("windows_per_task", windows_per_task).load(path)


def write_wav(rows: DataFrame, path: str, rate: int) -> DataFrame:
    """Rows (recording, t, samples in -1..1) as mono 16-bit files `recording`.wav below a folder, samples in the order of t.

    A file is streamed by one task, in batches, under a name of its own until it is whole, so that a task may be run again.
    Returns (recording, path, frames); null samples are none, rows with a null recording are left out. recording must be a
    file's name.
    """
    known = rows.where(F.col("recording").isNotNull()).select(F.col("recording").cast("string"), "t", F.coalesce("samples", F.array().cast("array<double>")).cast("array<double>").alias("samples"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(path)
        fs.create_dir(root, recursive=True)
        own, out, part, n = None, None, "", 0

        def ended() -> pa.RecordBatch:
            out.close()
            name = f"{root}/{own}.wav"
            fs.move(part, name)
            return pa.RecordBatch.from_pydict({"recording": [own], "path": [name], "frames": pa.array([n], pa.int64())})

        for batch in batches:
            names, samples, totals = batch.column("recording").to_pylist(), batch.column("samples"), batch.column("total").to_pylist()
            for k, name in enumerate(names):
                if name != own:
                    if out is not None:
                        yield ended()
                    own, part, n = name, f"{root}/.{name}.{uuid.uuid4().hex}", 0
                    out = fs.open_output_stream(part)
                    size = 2 * totals[k]
                    out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", size))
                data = np.clip(np.rint(samples[k].values.to_numpy(zero_copy_only=False) * 32768), -32768, 32767).astype("<i2")
                out.write(data.tobytes())
                n += len(data)
        if out is not None:
            yield ended()

    # dealt by a hash of the name: a shuffle by the join's own key would be left out, and adaptive execution may undo the join's
    totals = known.groupBy("recording").agg(F.sum(F.size("samples").cast("long")).alias("total"))
    in_order = known.join(totals, "recording").repartition(F.xxhash64("recording")).sortWithinPartitions("recording", "t")
    return written(in_order.select("recording", "total", "samples").mapInArrow(files, "recording string, path string, frames long"), "recordings")


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """(path, device, start, length) of media below a folder: the first folder names the device, the file the start."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = path.rstrip("/").replace("\\E", "\\E\\\\E\\Q")  # quoted: a path may have any characters
    below = F.regexp_extract("path", f"\\Q{root}\\E/(.*)$", 1)
    stamp = F.regexp_extract(below, r"(\d{8}[-_T]?\d{6})", 1)
    start = F.try_to_timestamp(F.regexp_replace(stamp, "[^0-9]", ""), F.lit("yyyyMMddHHmmss"))
    media = files.where(F.lower("path").rlike(r"\.(mp4|mkv|avi|mov|wav|flac|mp3)$"))
    return media.select("path", F.regexp_extract(below, "^([^/]+)/", 1).alias("device"), start.alias("start"), "length")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detection frames from JSON lines, one row a frame: a line that does not fit the schema, or has fields that are not
    in it, fails the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = lambda schema: F.lit(re.findall(r"(\w+):? (?:string|double|timestamp|array)", schema)).cast("array<string>")
    top, _, inner = FRAMES.partition("array<struct<")
    keys = F.flatten(F.transform(F.from_json("value", "detections array<map<string,string>>")["detections"], F.map_keys))
    odd = F.array_union(F.array_except(F.json_object_keys("value"), fields(top + "array")), F.array_except(F.coalesce(keys, F.array().cast("array<string>")), fields(inner)))
    read = F.from_json("value", FRAMES, {"mode": "FAILFAST"})
    known = F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(odd, ", "))).cast("string")).otherwise(F.lit("x"))
    rows = lines.select(F.when(known == "x", read).alias("f")).select("f.*")
    box = lambda d: F.struct(d["class_name"].alias("class"), d["confidence"].alias("confidence"), *(F.element_at(d["bbox"], k + 1).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))
    return rows.select(F.col("source_id").alias("source"), F.unix_micros("event_time").alias("t"), "frame_id", F.col("image_width").alias("frame_width"), F.col("image_height").alias("frame_height"), F.transform("detections", box).alias("detections"))


def write_completions(completions: DataFrame, roles: list[str], path: str) -> None:
    """Completions as JSON lines with a version, times to the microsecond with their zone."""
    pairs = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(r.upper()).alias("key"), F.col(r.lower()).alias("value")) for r in roles)), lambda e: e["value"].isNotNull()))
    times = [F.col(c).cast("timestamp").alias(c) for c in ("completed_at", "matched_at")]
    rows = completions.select("event", *times, "matched_source", pairs.alias("bindings"), F.lit(1).alias("schema_version"))
    rows.write.mode("append").option("timestampFormat", STAMP).json(path)


def read_completions(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Completions of the version that is asked for; rows of others are an error."""
    rows = spark.read.schema(COMPLETIONS).option("mode", "FAILFAST").option("timestampFormat", STAMP).json(path)
    checked = F.when(F.col("schema_version") == version, F.col("schema_version")).otherwise(F.raise_error(F.lit("another version of completions")))
    return rows.withColumn("schema_version", checked)


def replay_sources(spark: SparkSession, manifest: dict) -> DataFrame:
    """One row a segment of a replay manifest, with its start, which names its time zone; segments of one source may not
    repeat a path and start."""
    if manifest.get("version") != 1 or not manifest.get("replay_id") or float(manifest.get("speed", 1)) <= 0:
        raise ValueError("a manifest needs version 1, a replay_id and a positive speed")
    rows, seen = [], set()
    for s in manifest.get("sources", []):
        if s["modality"] not in ("video", "audio") or s.get("rotation_degrees", 0) not in (0, 90, 180, 270):
            raise ValueError(f"source {s['source_id']}: modality or rotation")
        for part in s.get("segments") or [s]:
            start = part["event_time_start"]
            if not (start.tzinfo if isinstance(start, datetime) else re.search(r"(Z|[+-]\d\d:?\d\d)$", str(start))):
                raise ValueError(f"source {s['source_id']}: {start} has no time zone")
            key = (s["source_id"], part["path"], str(part["event_time_start"]))
            if key in seen:
                raise ValueError(f"source {s['source_id']}: a segment twice")
            seen.add(key)
            rows.append((manifest["replay_id"], s["source_id"], s["modality"], part["path"], str(part["event_time_start"]), float(part.get("offset_seconds", 0)), part.get("duration_seconds"), int(s.get("rotation_degrees", 0))))
    frame = spark.createDataFrame(rows, "replay_id string, source_id string, modality string, path string, event_time_start string, offset_seconds double, duration_seconds double, rotation_degrees int")
    return frame.withColumn("event_time_start", F.to_timestamp("event_time_start"))
