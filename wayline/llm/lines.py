"""Line deduplication: of each class of equal or nearly equal lines, one occurrence in the corpus stays.

Equal lines link, whatever their length, and so do lines of at least min_chars code points within `edits` edit
operations of one another; shorter ones leave nothing to cut. A line is cut into edits + 1 segments, so one segment of
the shorter line occurs unchanged in the other, at one of few offsets. Keys of segment number, length and content
index the lines; each line probes the index at its own and up to `edits` smaller lengths with the substrings that can
match there. Probes that meet an index key must have sketches, parities of hashed character pairs, as near as so many
edits leave them; what remains is verified by banded bit-parallel edit distance. Classes are the components of the
links, and the occurrence that stays is the first by document and line.

Lines are told apart by 64-bit hashes of their content. Lines of nothing but white space are layout, not content: they
always stay. Null texts have no lines and stay null, empty texts have one blank line. Rows are documents of their own,
also where they repeat a doc_id with another text (their order is then that of the texts' hashes); rows that repeat
both share their lines' places, so that of a repeated row the same lines go. Lines of rows with a null doc_id stay, and
count as nobody's first occurrence. Tables may be empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.components import components
from wayline.llm.shingles import BASE, BATCH, INVERSE, _tables, mix
from wayline.session import unused, written

EDITS, MIN_CHARS = 2, 20
#: Ids that may be broadcast; more are joined by a shuffle.
FEW_IDS = 200_000
#: Lines that a task remembers to have met.
SEEN = 250_000
_WORD = (1 << 64) - 1


def _items(texts: list[str | None]) -> Iterator[tuple[int, int, str]]:
    """(place, number of the first line, piece): texts of more than a batch are cut between lines."""
    for k, text in enumerate(texts):
        text, at, line = text or "", 0, 0
        while len(text) - at > BATCH:
            cut = text.rfind("\n", at, at + BATCH)
            if cut < 0 and (cut := text.find("\n", at + BATCH)) < 0:
                break
            piece = text[at:cut]
            yield k, line, piece
            at, line = cut + 1, line + piece.count("\n") + 1
        yield k, line, text[at:]


def _batches(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """Places, first line numbers and pieces, of about a batch's characters together."""
    held, size = [], 0
    for item in _items(texts):
        if held and size + len(item[2]) > BATCH:
            places, numbers, pieces = zip(*held, strict=True)
            yield np.array(places), np.array(numbers), list(pieces)
            held, size = [], 0
        held.append(item)
        size += len(item[2]) + 1
    if held:
        places, numbers, pieces = zip(*held, strict=True)
        yield np.array(places), np.array(numbers), list(pieces)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _powers_at(base: np.uint64, n: np.ndarray) -> np.ndarray:
    """The base to each of the powers, by squaring."""
    out, square, n = np.ones(len(n), dtype=np.uint64), np.full(1, base), n.astype(np.int64)
    while n.any():
        out = np.where(n & 1, out * square, out)
        square, n = square * square, n >> 1
    return out


class Sums:
    """Running polynomial sums of a text, from which substrings are hashed.

    Up to a batch they are held for every place. Of a longer text, which is one long line, they are taken batch by
    batch at the places that are asked for.
    """

    def __init__(self, text: str):
        self.text = text
        self.held = self._of(text) if len(text) <= 2 * BATCH else None

    @staticmethod
    def _of(text: str) -> np.ndarray:
        codes = _codes(text)
        return np.concatenate(([np.uint64(0)], np.cumsum((codes + np.uint64(1)) * _tables(len(codes))[0][: len(codes)])))

    def _at(self, spots: np.ndarray) -> np.ndarray:
        out, before = np.zeros(len(spots), dtype=np.uint64), np.zeros(1, dtype=np.uint64)
        for at in range(0, len(self.text), BATCH):
            own = self._of(self.text[at : at + BATCH]) * _powers_at(BASE, np.array([at]))
            inside = (spots > at) & (spots <= at + BATCH)
            out[inside] = (before + own[spots[inside] - at])
            before = before + own[-1:]
        return out

    def hashes(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hashes of the substrings; equal content gives equal hashes anywhere."""
        tail = length.astype(np.uint64) * BASE
        if self.held is not None:
            return mix((self.held[start + length] - self.held[start]) * _tables(len(self.held))[1][start] + tail)
        return mix((self._at(start + length) - self._at(start)) * _powers_at(INVERSE, start) + tail)


def lines_of(texts: list[str | None], min_chars: int = 0, cut: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(places of texts, line numbers, ids, and, if asked for, the lines) of lines that are not blank and long enough."""
    for places, numbers, held in _batches(texts):
        joined = "\n".join(held)
        codes = _codes(joined)
        breaks = np.flatnonzero(codes == 10)
        starts, ends = np.concatenate(([0], breaks + 1)), np.append(breaks, len(codes))
        begins = np.cumsum([0] + [len(x) + 1 for x in held])
        item = np.searchsorted(begins, starts, side="right") - 1
        number = np.arange(len(starts)) - np.searchsorted(starts, begins)[item] + numbers[item]
        shown = np.concatenate(([0], np.cumsum((codes > 32) | (codes < 9) | ((codes > 13) & (codes < 32)))))
        kept = np.flatnonzero((shown[ends] > shown[starts]) & (ends - starts >= min_chars))
        ids = Sums(joined).hashes(starts[kept], (ends - starts)[kept]).astype(np.int64)
        spans = zip(starts[kept].tolist(), ends[kept].tolist(), strict=True) if cut else ()
        yield places[item[kept]], number[kept], ids, [joined[a:b] for a, b in spans]


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, own, line, id) of every line of docs (doc_id, own, text) that is not blank."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, number, ids, _ in lines_of(batch.column(2).to_pylist(), cut=False):
                at = pa.array(place)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int64()), pa.array(ids)], names=["doc_id", "own", "line", "id"])

    return docs.select("doc_id", "own", "text").mapInArrow(rows, "doc_id long, own long, line long, id long")


def distinct_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text) of the lines that are long enough, each once or a few times for every task that meets it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, ids, texts in lines_of(batch.column(0).to_pylist(), min_chars):
                out = [(i, t) for i, t in zip(ids.tolist(), texts, strict=True) if i not in seen and not seen.add(i)]
                if len(seen) > SEEN:
                    seen.clear()
                if out:
                    i, t = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.string())], names=["id", "text"])

    return docs.select("text").mapInArrow(rows, "id long, text string")


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each of the edits + 1 segments of lines; the first ones are the shorter ones."""
    n = edits + 1
    short = length // n
    long = length - short * n  # so many segments at the end have one character more
    out, at = [], np.zeros_like(length)
    for i in range(n):
        size = short + (i >= n - long)
        out.append((at, size))
        at = at + size
    return out


def sketches(text: str, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64 parities of the hashed character pairs of each line; an edit changes at most four pairs."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for at in range(0, max(len(text) - 1, 1), BATCH):  # pieces share a character, and more than one is a lone long line
        codes = _codes(text[at : at + BATCH + 1])
        bits = np.concatenate((np.uint64(1) << (mix(codes[:-1] * BASE + codes[1:]) >> np.uint64(58)), [np.uint64(0)]))
        if len(text) <= BATCH + 1:
            bits[starts + lengths - 1] = 0
            inside = starts + lengths
            bits[inside[inside < len(bits)]] = 0  # the line break's own pair
            return np.bitwise_xor.reduceat(bits, starts)
        out ^= np.bitwise_xor.reduce(bits)
    return out


def _keyed(edits: int, probing: bool, min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held_ids, held_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if len(seen) > SEEN:
                seen.clear()
            fresh = [k for k, i in enumerate(held_ids) if i not in seen and not seen.add(i)]
            every = np.array([held_ids[k] for k in fresh], dtype=np.int64)
            for places, _, held in _batches([held_texts[k] for k in fresh]):
                own, joined = every[places], "\n".join(held)
                lengths = np.array([len(x) for x in held], dtype=np.int64)
                starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
                sums, sketch = Sums(joined), sketches(joined, starts, lengths).astype(np.int64)
                spots, sizes, tags, who = [], [], [], []
                for less in range(edits + 1 if probing else 1):
                    indexed = lengths - less
                    for i, (at, size) in enumerate(segments(indexed, edits)):
                        lo = max(-i, less - (edits - i)) if probing else 0
                        hi = min(i, less + (edits - i)) if probing else 0
                        for shift in range(lo, hi + 1):
                            spot = at + shift
                            fits = np.flatnonzero((spot >= 0) & (spot + size <= lengths) & (indexed >= min_chars))
                            tags.append(indexed[fits].astype(np.uint64) * np.uint64(edits + 1) + np.uint64(i))
                            spots.append(starts[fits] + spot[fits])
                            sizes.append(size[fits])
                            who.append(fits)
                at, keys = np.concatenate(who), mix(sums.hashes(np.concatenate(spots), np.concatenate(sizes)) ^ mix(np.concatenate(tags)))
                columns = [keys.astype(np.int64), own[at], sketch[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "sketch"])

    return rows


def distance_within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k (under 30), by bit vectors of the band of 2 k + 1 diagonals."""
    if abs(len(a) - len(b)) > k:
        return False
    start, n = 0, min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    end = 0
    while end < n - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if not b or len(a) <= k:
        return len(a) <= k
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    # the band's rows stand in the top bits, the lowest row of a column at bit 63; the band moves down by one a column
    plus, minus, d = (_WORD << (63 - k)) & _WORD, 0, k
    low = 1 << 62
    for j, c in enumerate(b):
        shift = j + k - 63
        found = at.get(c, 0)
        equal = (found >> shift if shift >= 0 else found << -shift) & _WORD
        diagonal = ((((equal & plus) + plus) ^ plus) | equal | minus) & _WORD
        right_plus = (minus | ~(diagonal | plus)) & _WORD
        right_minus = diagonal & plus
        if j < len(a) - k:
            d += not diagonal >> 63
        else:
            d += bool(right_plus & low)
            d -= bool(right_minus & low)
            low >>= 1
        if d > 2 * k + 1:
            return False
        plus = (right_minus | ~((diagonal >> 1) | right_plus)) & _WORD
        minus = (diagonal >> 1) & right_plus
    return d <= k


def links(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Edges (a, b) between ids of different lines within the edit distance."""
    lines = distinct_lines(docs, min_chars)
    spread = lines.repartition(F.col("id"))
    index = spread.mapInArrow(_keyed(edits, False, min_chars), "key long, id long, sketch long")
    probe = spread.mapInArrow(_keyed(edits, True, min_chars), "key long, id long, sketch long")
    i, p = index.alias("i"), probe.alias("p")
    near = F.bit_count(F.col("i.sketch").bitwiseXOR(F.col("p.sketch"))) <= 4 * edits
    met = i.join(p, (F.col("i.key") == F.col("p.key")) & (F.col("i.id") != F.col("p.id")) & near)
    pairs = written(met.select(F.least("i.id", "p.id").alias("a"), F.greatest("i.id", "p.id").alias("b")).distinct(), "line-pairs")

    wanted = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "line-ids")
    side = F.broadcast(wanted) if wanted.count() <= FEW_IDS else wanted
    texts = written(lines.join(side, "id").groupBy("id").agg(F.first("text").alias("text")), "line-texts")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = pa.array([distance_within(s, t, edits) for s, t in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("s"))
    other = texts.select(F.col("id").alias("b"), F.col("text").alias("t"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "s", "t").mapInArrow(verified, "a long, b long")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, own, text), own telling apart rows that repeat an id with another text."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("own", F.xxhash64("text"))


def repeats(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, own, line, exact) of every line that goes from docs (doc_id, own, text); exact tells whether the
    class's first line has the same text."""
    docs = docs.where("doc_id IS NOT NULL")
    found = written(components(links(docs, edits, min_chars)), "line-classes")
    every = occurrences(docs).distinct()
    # only ids that are linked have another class than themselves
    counts = every.groupBy("id").agg(F.min(F.struct("doc_id", "own", "line")).alias("first"), F.count("*").alias("n"))
    classed = written(counts.join(found, "id", "left").select("id", "first", "n", F.coalesce("component", "id").alias("class")), "line-counts")
    firsts = classed.groupBy("class").agg(F.min(F.struct("first", "id")).alias("kept"), F.sum("n").alias("in_class")).where("in_class > 1")
    dropping = classed.join(firsts, "class").select("id", "kept")
    # neither these nor the lines that go have a bound, so they are never broadcast
    going = every.join(dropping.hint("merge"), "id").where(F.struct("doc_id", "own", "line") != F.col("kept.first"))
    return going.select("doc_id", "own", "line", (F.col("id") == F.col("kept.id")).alias("exact"))


def line_report(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: its lines, how many go as exact and as near repeats, and which."""
    rows = _rows(docs)
    gone = repeats(rows, edits, min_chars).groupBy("doc_id", "own").agg(
        F.count_if("exact").alias("n_exact"), F.count_if(~F.col("exact")).alias("n_near"), F.array_sort(F.collect_list("line")).alias("gone")
    )
    own = rows.select("doc_id", "own", F.coalesce(F.size(F.split("text", "\n", -1)).cast("long") * F.when(F.col("text").isNotNull(), 1), F.lit(0)).alias("n_lines"))
    return own.join(gone, ["doc_id", "own"], "left").select(
        "doc_id", "n_lines", F.coalesce("n_exact", F.lit(0)).alias("n_exact"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed")
    )


def without_repeats(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, emptied: bool = True) -> DataFrame:
    """The documents, with all columns, without repeated lines. Documents of which nothing but white space is left
    stay only if `emptied` says so; those that had nothing else to begin with always stay."""
    doc, own, gone, lines = (unused(x, docs.columns) for x in ("__doc", "__own", "__gone", "__lines"))
    found = repeats(_rows(docs), edits, min_chars).groupBy(F.col("doc_id").alias(doc), F.col("own").alias(own))
    drops = found.agg(F.collect_list("line").alias(gone))
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own))
    joined = docs.join(drops.hint("merge"), same, "left")
    # a set difference of line numbers: looking each line up in the list would take its length times theirs
    cut = joined.withColumn(lines, F.when(F.col(gone).isNotNull(), F.split("text", "\n", -1)))
    numbers = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(numbers, lambda k: F.get(lines, k.cast("int"))), "\n"))
    cut = cut.withColumn("text", text)
    if not emptied:
        cut = cut.where(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return cut.select(docs.columns)
