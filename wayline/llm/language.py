"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three lower-cased characters, everything but letters counting as a space; the
value is the share of the text's n-grams times the inverse document frequency, which is taken over all training
documents. The weights are learned on the driver by follow-the-regularised-leader with elastic-net penalties from a
stratified sample of about SAMPLE distinct texts a language, a fifth of which is kept to fit the temperature.
Whole texts are used throughout. A prediction is a function of the text alone, and the model's size is fixed by the
number of buckets and languages.

A text that is null or has no letter is `und` with score 0; so is every text if there are no training rows.
Training rows need a label. In the sample a text counts once for each of its labels, however often it occurs; in the
document frequencies every row counts. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, ORDERS, SAMPLE, SCALE = 1 << 16, (1, 2, 3), 600, 10.0
UNKNOWN = "und"
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool))
    return _letters[0]


def grams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """For each text that has a letter: its place in the list and the buckets of all of its n-grams."""
    is_letter = letters()
    for k, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kept = is_letter[codes]
        if not kept.any():
            continue
        spaced = np.where(kept, codes, np.uint32(32))
        # runs of spaces count as one
        spaced = spaced[np.concatenate(([True], kept[1:] | kept[:-1]))]
        out = []
        for n in ORDERS:
            mixed = np.full(max(len(spaced) - n + 1, 0), n, dtype=np.uint32) * _MULTIPLIERS[3]
            for j in range(n):
                mixed ^= spaced[j : len(spaced) - n + 1 + j] * _MULTIPLIERS[j]
                mixed = (mixed << np.uint32(5)) ^ (mixed >> np.uint32(7)) ^ mixed
            out.append((mixed * np.uint32(2654435769)) >> np.uint32(16))
        yield k, np.concatenate(out)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """How many texts have a letter, and how many have each bucket, over all rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for _, buckets in grams(batch.column(0).to_pylist()):
                seen = np.zeros(BUCKETS, dtype=bool)
                seen[buckets] = True
                totals += seen
                n += 1
        if n:
            at = np.flatnonzero(totals)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS)), pa.array(np.append(totals[at], n))], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return int(out[-1]), out[:-1]


def sample_vectors(docs: DataFrame, label: str, per_label: int) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """Sparse term-frequency vectors of about per_label distinct texts a label, and whether they calibrate.

    A text is chosen by its hash at a rate that follows from the number of distinct texts, so copies neither fill the
    sample nor empty it. A task sends each chosen text once, and the tasks' repeats are dropped before the driver.
    """
    own = docs.withColumn("own", F.xxhash64("text", F.lit("sample")))
    sizes = {r[0]: r[1] for r in own.groupBy(label).agg(F.approx_count_distinct("own", 0.02)).collect()}
    if not sizes:
        return []
    # compared in doubles: 2^32 hashes, of which a label's share is kept
    rates = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n) if n > 20 else 1.0))))
    spot = F.pmod("own", F.lit(1 << 32)).cast("double") / float(1 << 32)
    chosen = own.where(spot < rates[F.col(label)]).select(label, "text", "own", F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(5)).alias("fold"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            held = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            fresh = [x for x in held if (x[0], x[2]) not in seen and not seen.add((x[0], x[2]))]
            rows = []
            for k, buckets in grams([x[1] for x in fresh]):
                at, n = np.unique(buckets, return_counts=True)
                rows.append((fresh[k][0], fresh[k][2], fresh[k][3] == 0, at.astype("<u2").tobytes(), (n / len(buckets)).astype("<f4").tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["label", "own", "fold", "at", "tf"])

    rows = chosen.mapInArrow(vectors, "label string, own long, fold boolean, at binary, tf binary").dropDuplicates(["label", "own"]).select("label", "fold", "at", "tf").collect()
    rows.sort(key=lambda r: (hash_of(bytes(r[2]) + bytes(r[3])), r[0]))
    return [(r[0], r[1], np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], "<f4")) for r in rows]


def hash_of(data: bytes) -> int:
    import zlib

    return zlib.crc32(data)


class FollowTheLeader:
    """Multinomial logistic regression by FTRL-proximal steps; weights are zero wherever |z| is within the l1 penalty."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / rate)

    def step(self, at: np.ndarray, x: np.ndarray, target: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[target] -= 1
        g = x[:, None] * p
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    labels: list[str]
    #: inverse document frequency times weight, by bucket; the last row is the bias
    weights: np.ndarray
    temperature: float

    def scores(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.labels:
            for k, buckets in grams(texts):
                counts = np.bincount(buckets, minlength=BUCKETS).astype(np.float32) if len(buckets) > 20000 else None
                total = counts @ self.weights[:-1] if counts is not None else self.weights[buckets].sum(axis=0)
                p = softmax((total * (SCALE / len(buckets)) + self.weights[-1]) / self.temperature)
                names[k], scores[k] = self.labels[int(p.argmax())], float(p.max())
        return names, scores


def train(docs: DataFrame, label: str = "lang", per_label: int = SAMPLE, epochs: int = 3) -> Model:
    """A model of the label of docs (text, label); per_label bounds the sample, not the document frequencies."""
    docs = docs.where(F.col(label).isNotNull()).select(F.col("text").cast("string"), F.col(label).cast("string").alias(label))
    rows = sample_vectors(docs.where(F.col("text").isNotNull()), label, per_label)
    labels = sorted({r[0] for r in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS + 1, 0), dtype=np.float32), 1.0)
    n, df = document_frequencies(docs)
    idf = np.append(np.log((1 + n) / (1 + df)) + 1, 1.0)
    learner = FollowTheLeader(BUCKETS + 1, len(labels))
    prepared = [(np.append(at, BUCKETS), np.append(tf * idf[at] * SCALE, 1.0), labels.index(name), fold) for name, fold, at, tf in rows]
    for _ in range(epochs):
        for at, x, target, fold in prepared:
            if not fold:
                learner.step(at, x, target)
    weights = learner.weights()
    kept = [(x @ weights[at], target) for at, x, target, fold in prepared if fold]
    return Model(labels, (weights * idf[:, None]).astype(np.float32), temperature(kept))


def temperature(kept: list[tuple[np.ndarray, int]]) -> float:
    """The temperature with the least log loss on the rows kept for calibration."""
    if not kept:
        return 1.0
    logits, targets = np.array([z for z, _ in kept]), np.array([t for _, t in kept])

    def loss(t: float) -> float:
        p = softmax(logits / t)[np.arange(len(targets)), targets]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, and what else they have) with lang_pred and score in place of the text and of columns so called."""

    names_kept = [c for c in docs.columns if c.lower() not in ("text", "lang_pred", "score")]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.scores(batch.column("text").to_pylist())
            kept = [n for n in batch.schema.names if n in names_kept]
            columns = [batch.column(n) for n in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names_kept)
    return docs.select(*names_kept, "text").mapInArrow(scored, f"{fields}, lang_pred string, score double")


def fold_of(id_column: str, folds: int) -> Column:
    """The remainder of the CRC-32 of an id as text."""
    return F.pmod(F.crc32(F.encode(F.col(id_column).cast("string"), "UTF-8")), F.lit(folds))
