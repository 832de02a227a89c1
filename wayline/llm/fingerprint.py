"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes triggers a boundary wherever it leaves a remainder fixed by the block
size; each chunk between boundaries adds one character, taken from its CRC-32, to the signature. A fingerprint is
"block size:signature:signature at twice the block size". The block size is the smallest power of two times
MIN_BLOCK at which a text of that many bytes gets at most 64 characters or so, halved while the signature is short.
Two fingerprints compare at equal block sizes, by the edit distance of their signatures, computed bit-parallel.

Null texts count as empty. The empty text's fingerprint is "3::", which is like itself (1.0) and nothing else.
Equal texts have equal fingerprints; repeated rows are neighbours in the order of ids like any others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

MIN_BLOCK, SIGNATURE, WINDOW = 3, 64, 7
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
NEIGHBOURS = "doc_id long, text string, edited string, next_id long, fingerprint string, edited_fingerprint string, next_fingerprint string"


def rolling(data: bytes) -> np.ndarray:
    """A hash of the last WINDOW bytes at each position: their sum, their weighted sum and a shifted mix."""
    b = np.zeros(len(data) + WINDOW - 1, dtype=np.uint32)
    b[WINDOW - 1 :] = np.frombuffer(data, dtype=np.uint8)
    n = len(data)
    total = np.zeros(n, dtype=np.uint32)
    mixed = np.zeros(n, dtype=np.uint32)
    for back in range(WINDOW):
        c = b[WINDOW - 1 - back : WINDOW - 1 - back + n]
        total += c * np.uint32(WINDOW - back + 1)
        mixed ^= c << np.uint32(5 * back % 32)
    return total + mixed


def signature(data: bytes, ends: np.ndarray, most: int) -> str:
    """A character for each chunk; from `most` chunks on, the rest of the text is the last one."""
    out, start = [], 0
    view = memoryview(data)
    for end in [*(ends[: most - 1] + 1).tolist(), len(data)]:
        if end > start:
            out.append(ALPHABET[zlib.crc32(view[start:end]) & 63])
        start = end
    return "".join(out)


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "surrogatepass")
    block = MIN_BLOCK
    while block * SIGNATURE < len(data):
        block *= 2
    hashes = rolling(data)
    while True:
        ends = np.flatnonzero(hashes % np.uint32(block) == block - 1)
        if block == MIN_BLOCK or len(ends) >= SIGNATURE // 2:
            break
        block //= 2
    twice = np.flatnonzero(hashes % np.uint32(2 * block) == 2 * block - 1)
    return f"{block}:{signature(data, ends, SIGNATURE)}:{signature(data, twice, SIGNATURE // 2)}"


def distance(a: str, b: str) -> int:
    """Edit distance, with one machine word of the shorter string's length as a column."""
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if not m:
        return len(a)
    at: dict[str, int] = {}
    for k, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    for c in a:
        equal = at.get(c, 0)
        x = equal | minus
        d = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | ~(d | plus) & full
        down = plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | 1) & full
        down = down << 1 & full
        plus = down | ~(x | up) & full
        minus = up & x
    return score


def likeness(one: str, other: str) -> float:
    """0 to 1: the best of the signatures that have one block size; equal fingerprints are alike wholly."""
    if one == other:
        return 1.0
    (size, *own), (their_size, *their) = one.split(":"), other.split(":")
    sizes = {int(size) * k: s for k, s in zip((1, 2), own, strict=True)}
    best = 0.0
    for k, s in zip((1, 2), their, strict=True):
        mine = sizes.get(int(their_size) * k)
        if mine and s:
            best = max(best, 1 - distance(mine, s) / max(len(mine), len(s)))
    return best


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the following text's beginning, or all of it."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut] if cut else text


def in_order(docs: DataFrame, bytes_a_part: int = 16 << 20, most_parts: int = 20000) -> DataFrame:
    """The documents in parts by ranges of ids, each part with the row that follows its last one (ahead = true).

    One pass over ids and lengths takes the ids at which parts begin, quantiles that are ids themselves; then the
    texts are moved once. The row at which a part begins is sent to the part before it as well, the first one of
    all to the last part. Null ids come before all others.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size, n, nulls, least = rows.agg(F.sum(F.length("text")), F.count("*"), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    wanted = max((size or 0) // bytes_a_part, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = int(min(max(1, n // 16), most_parts, wanted))
    firsts = [] if least is None else [least]
    if parts > 1 and firsts:
        cuts = rows.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
        firsts = sorted({least, *cuts})
    part = _part(firsts)
    begins = F.lit(nulls > 0) & F.col("doc_id").isNull()
    if firsts:
        at = F.element_at(F.lit(firsts).cast("array<bigint>"), F.col("part") + 1) == F.col("doc_id")
        begins = begins | (F.coalesce(at, F.lit(False)) & ((F.col("part") > 0) | F.lit(nulls == 0)))
    total = max(len(firsts), 1)
    own = F.struct(F.col("part"), F.lit(False).alias("ahead"))
    before = F.struct(((F.col("part") + (total - 1)) % total).alias("part"), F.lit(True).alias("ahead"))
    places = F.when(begins, F.array(own, before)).otherwise(F.array(own))
    placed = rows.withColumn("part", part).withColumn("place", F.explode(places)).select("doc_id", "text", "place.part", "place.ahead")
    return placed.repartitionById(total, F.col("part")).sortWithinPartitions("ahead", "doc_id", "text")


def _part(firsts: list[int]):
    """The number of the part that an id is in, found in blocks of bounds; a null id is in the first."""
    if len(firsts) < 2:
        return F.lit(0)
    step = max(2, round(len(firsts) ** 0.5))
    blocks = [firsts[k : k + step] for k in range(0, len(firsts), step)]
    heads = F.lit([b[0] for b in blocks]).cast("array<bigint>")
    within = F.lit([b + [b[-1]] * (step - len(b)) for b in blocks]).cast("array<array<bigint>>")
    block = F.greatest(F.size(F.filter(heads, lambda x: x <= F.col("doc_id"))) - 1, F.lit(0))
    spot = F.size(F.filter(F.array_distinct(F.element_at(within, block + 1)), lambda x: x <= F.col("doc_id"))) - 1
    return F.greatest(F.coalesce(block * step + spot, F.lit(0)), F.lit(0))


def neighbours(docs: DataFrame) -> DataFrame:
    """Every document with its edited text, the following document's id, and the fingerprints of all three.

    The following document is the next in ascending (doc_id, text), after the last one the first.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = None, [], 0
        for batch in batches:
            for doc, text, ahead in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if held is not None:
                    before, its_text, its_print = held
                    own = its_print if text == its_text else fingerprint(text)
                    changed = edited(its_text, text)
                    again = its_print if changed == its_text else fingerprint(changed)
                    out.append((before, its_text, changed, doc, its_print, again, own))
                    size += 2 * len(its_text)
                else:
                    own = fingerprint(text)
                held = (doc, text, own)
                if ahead:
                    held = None
                    break  # rows that repeat the first id of the next part
                if size > 4_000_000:
                    yield _rows(out)
                    out, size = [], 0
            if held is None:
                break
        for _ in batches:
            pass
        yield _rows(out)

    return in_order(docs).select("doc_id", "text", "ahead").mapInArrow(pairs, NEIGHBOURS)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = [x.split() for x in NEIGHBOURS.split(", ")]
    columns = zip(*out, strict=True) if out else [[]] * len(names)
    types = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


@F.pandas_udf(DoubleType())
def likeness_of(one, other):
    import pandas as pd

    return pd.Series([likeness(a, b) for a, b in zip(one, other, strict=True)], dtype="float64")


def compared(docs: DataFrame) -> DataFrame:
    """neighbours() with the likeness of each fingerprint to the edited text's and to the following document's."""
    rows = neighbours(docs)
    return rows.withColumn("near_edited", likeness_of("fingerprint", "edited_fingerprint")).withColumn("near_next", likeness_of("fingerprint", "next_fingerprint"))
