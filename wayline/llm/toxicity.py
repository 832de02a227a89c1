"""Toxicity scores: gradient-boosted trees over dense features, calibrated isotonically.

A lexicon is learned from labelled training texts: words, beginnings of words (three to eight letters) and words
with look-alike characters undone, each with the log-odds of its documents being toxic. The features of a text are
densities and counts of lexicon entries at several strengths, their nearness to second-person words, the shares of
capitals, punctuation and obfuscated words, and its length. Histogram trees are boosted on the driver on those
features of about SAMPLE labelled texts at most, whose words also bound the lexicon; a fifth of them is kept for the
isotonic fit. Whole texts are read, and a score depends on the text alone.

Null texts count as empty and get a score like any other. Rows without a label, or with another than 0 and 1, teach
nothing; without rows of both labels every score is the share of ones, or 0. A text counts once for each of its labels,
however many rows have it, so the sample is bounded whatever repeats. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from wayline.session import written

SAMPLE, LEAST_DOCUMENTS = 12000, 4
PREFIXES = range(3, 9)
# Second-person words of the four languages, and look-alikes with the letters they stand for.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")
FEATURES = (
    "length", "words", "strong", "strong_share", "medium", "medium_share", "weak_share", "sum", "mean", "best", "second", "third",
    "clean_share", "near_you", "you_share", "capitals", "capital_words", "exclamations", "punctuation", "digits", "obfuscated", "spaced", "distinct", "mean_word",
)

_WORD = re.compile(r"[^\W_]+(?:[@$!0-9][^\W_]+)*", re.UNICODE)
_SPACED = re.compile(r"\b(?:\w[ .*_-]){3,}\w\b")


def keys(word: str) -> list[str]:
    """What the lexicon may know of a word: the word, without look-alikes, and its beginnings."""
    plain = word.translate(LOOKALIKES)
    return ["=" + plain, *("^" + plain[:n] for n in PREFIXES if len(plain) > n)]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        """The log-odds of the entry that tells most about a word; 0 if none does."""
        w = self.known.get(word)
        if w is None:
            found = [self.weights[k] for k in keys(word) if k in self.weights]
            w = max(found, key=abs) if found else 0.0
            if len(self.known) > 120_000:
                self.known.clear()
            self.known[word] = w
        return w


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    words = _WORD.findall(text)
    lower = [w.lower() for w in words]
    counts = Counter(lower)
    weights = {w: lexicon.weight(w) for w in counts}
    n = max(len(words), 1)
    total = sum(weights[w] * c for w, c in counts.items())
    strong = sum(c for w, c in counts.items() if weights[w] >= 3)
    medium = sum(c for w, c in counts.items() if weights[w] >= 1.5)
    weak = sum(c for w, c in counts.items() if weights[w] >= 0.5)
    clean = sum(c for w, c in counts.items() if weights[w] <= -0.5)
    top = sorted((w for w in weights.values() if w > 0), reverse=True)[:3] + [0.0] * 3
    you = sum(c for w, c in counts.items() if w in SECOND_PERSON)
    near = 0
    if you and medium:
        spots = [k for k, w in enumerate(lower) if w in SECOND_PERSON]
        hits = [k for k, w in enumerate(lower) if weights[w] >= 1.5]
        at = np.searchsorted(spots, hits)
        spots = np.array([-(10**9), *spots, 10**9])
        hits = np.array(hits)
        near = int((np.minimum(hits - spots[at], spots[at + 1] - hits) <= 6).sum())
    chars = max(len(text), 1)
    letters = max(sum(map(len, words)), 1)
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    odd = sum(c for w, c in counts.items() if not w.isalpha() and not w.isdigit())
    capitals = sum(map(len, re.findall(r"[A-ZÀ-ÖØ-Þ]+", text)))
    digits = sum(map(len, re.findall(r"[0-9]+", text)))
    marks = sum(map(len, re.findall(r"[!?#$%&*@^~]+", text)))
    return [
        np.log1p(len(text)), np.log1p(len(words)), strong, strong / n, medium, medium / n, weak / n, total, total / n, *top[:3],
        clean / n, near, you / n, capitals / letters, upper / n, text.count("!") / n, marks / chars, digits / chars, odd / n, sum(1 for _ in _SPACED.finditer(text)), len(counts) / n, letters / n,
    ]


class Trees:
    """Boosted regression trees of fixed depth on the logistic loss, over features cut into quantile bins."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, least: int = 10, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = rounds, depth, rate, bins, least, l2
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += _values(tree, x)
        return self

    def _tree(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> list[tuple]:
        """Nodes (feature, threshold, left, right, value) in a list; a leaf has feature -1."""
        nodes: list[tuple] = [()]
        todo = [(0, np.arange(len(g)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            leaf = (-1, 0.0, 0, 0, float(-self.rate * total_g / (total_h + self.l2)))
            best = (1e-6, -1, 0)
            if depth < self.depth and len(rows) >= 2 * self.least:
                for j, cuts in enumerate(edges):
                    if not len(cuts):
                        continue
                    size = len(cuts) + 1
                    b = binned[rows, j]
                    n = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    lg = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                    lh = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                    gain = lg**2 / (lh + self.l2) + (total_g - lg) ** 2 / (total_h - lh + self.l2) - total_g**2 / (total_h + self.l2)
                    gain[(n < self.least) | (len(rows) - n < self.least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            _, j, k = best
            if j < 0:
                nodes[at] = leaf
                continue
            left = binned[rows, j] <= k
            nodes[at] = (j, float(edges[j][k]), len(nodes), len(nodes) + 1, 0.0)
            nodes += [(), ()]
            todo += [(len(nodes) - 2, rows[left], depth + 1), (len(nodes) - 1, rows[~left], depth + 1)]
        return nodes

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_values(t, x) for t in self.trees), np.zeros(len(x)))


def _values(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    feature, threshold, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
    at = np.zeros(len(x), dtype=np.int64)
    while (inner := feature[at] >= 0).any():
        rows = np.flatnonzero(inner)
        node = at[rows]
        low = x[rows, feature[node]] <= threshold[node]
        at[rows] = np.where(low, left[node], right[node])
    return value[at]


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing fit: pooled adjacent violators, each block at the mean of its scores.

    Every block's share is shrunk by one row of each label, so that no score is 0 or 1 outright.
    """
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []
    for s, t in zip(raw[order], y[order], strict=True):
        blocks.append([s, t, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    at = np.array([s / n for s, _, n in blocks])
    return at, np.maximum.accumulate(np.array([(t + 0.5) / (n + 1) for _, t, n in blocks]))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    share: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        if not texts:
            return np.zeros(0)
        x = np.array([features(t, self.lexicon) for t in texts], dtype=np.float64)
        raw = self.trees.raw(x)
        # the trees' own order breaks ties inside a block, by less than blocks differ
        return np.clip(np.interp(raw, *self.knots) * 0.999 + 0.001 / (1 + np.exp(-raw)), 0, 1)


def learn_lexicons(rows: DataFrame) -> list[Lexicon]:
    """Log-odds of words and their beginnings from rows (text, label, half): of all rows, and of each half's others.

    Tasks count documents by key, half and label, and Spark sums the counts; only keys of LEAST_DOCUMENTS are kept.
    """
    names = ("zeros0", "ones0", "zeros1", "ones1")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = zip(*held.values(), strict=True) if held else [[]] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), *(pa.array(c, pa.int32()) for c in columns)], names=["key", *names])
            held.clear()
            return batch

        for batch in batches:
            for text, label, half in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = {k for w in {w.lower() for w in _WORD.findall(text or "")} for k in keys(w)}
                for k in (*own, ""):
                    held.setdefault(k, [0, 0, 0, 0])[2 * half + label] += 1
                if len(held) > 400_000:
                    yield out()
        yield out()

    counts = rows.select("text", "label", "half").mapInArrow(counted, "key string, zeros0 int, ones0 int, zeros1 int, ones1 int").groupBy("key").agg(*(F.sum(n).alias(n) for n in names))
    counts = written(counts.where((sum((F.col(n) for n in names), F.lit(0)) >= LEAST_DOCUMENTS) | (F.col("key") == "")), "lexicon")
    total = counts.where("key = ''").first()
    return [_lexicon(counts, total, halves) for halves in ("01", "1", "0")]


def _lexicon(counts: DataFrame, total: Row | None, halves: str) -> Lexicon:
    n = [sum(total[f"{label}{h}"] for h in halves) if total else 0 for label in ("zeros", "ones")]
    if not all(n):
        return Lexicon()
    zeros, ones = (sum((F.col(f"{label}{h}") for h in halves), F.lit(0)) for label in ("zeros", "ones"))
    odds = F.log((ones + 0.5) / (n[1] + 1.0)) - F.log((zeros + 0.5) / (n[0] + 1.0))
    certain = F.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))
    scored = counts.where("key <> ''").withColumn("odds", odds).withColumn("z", F.abs(odds) / certain).where(F.col("z") >= 2)
    return Lexicon({r["key"]: float(r["odds"]) for r in scored.select("key", "odds").collect()})


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from rows (text, label 0 or 1); sample bounds the labelled rows that it is fitted on."""
    content = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.where(F.col("label").isin(0, 1)).select(content.alias("text"), F.col("label").cast("int"))
    rows = rows.withColumn("own", F.xxhash64("text", F.lit("sample")))
    sizes = {r[0]: r[1] for r in rows.groupBy("label").agg(F.approx_count_distinct("own", 0.02)).collect()}
    total = sum(sizes.values())
    share = sizes.get(1, 0) / total if total else 0.0
    if len(sizes) < 2:
        return Model(Lexicon(), None, (np.zeros(1), np.zeros(1)), share)
    # the share of distinct texts that makes the sample; counts are off by a few hundredths
    rate = sample / total if total > 1.05 * sample else 1.0
    spot = F.pmod("own", F.lit(1 << 32)).cast("double") / float(1 << 32)
    fold, half = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(5)), F.pmod(F.xxhash64("text", F.lit("half")), F.lit(2))
    once = rows.where(spot < rate).dropDuplicates(["own", "label"])
    chosen = written(once.select("text", "label", fold.alias("fold"), half.alias("half")), "toxicity-sample")
    # a lexicon flatters the rows that it has learned from, so rows are measured by that of the other half
    lexicon, *others = learn_lexicons(chosen)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)
            x = [np.array(features(t, others[half]), dtype=np.float64).tobytes() for t, half in held]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1), batch.column(2)], names=["x", "label", "fold"])

    held = chosen.select("text", "label", "fold", "half").mapInArrow(measured, "x binary, label int, fold long").collect()
    held.sort(key=lambda r: (bytes(r["x"]), r["label"]))
    x = np.array([np.frombuffer(r["x"]) for r in held]).reshape(-1, len(FEATURES))
    y, folds = np.array([r["label"] for r in held], dtype=np.float64), np.array([r["fold"] for r in held])
    fit, keep = folds < 4, folds == 4
    if not fit.any() or len(set(y[fit])) < 2:
        return Model(lexicon, None, (np.zeros(1), np.zeros(1)), share)
    trees = Trees().fit(x[fit], y[fit])
    on = keep if keep.sum() >= 20 and len(set(y[keep])) == 2 else fit
    return Model(lexicon, trees, isotonic(trees.raw(x[on]), y[on]), share)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with their scores in a column of that name, besides whatever columns they have."""

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.scores([None if t is None else t for t in texts]), dtype="float64")

    return docs.withColumn(name, scored(F.col(text).cast("string")))
