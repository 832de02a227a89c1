"""Packing of documents into fixed windows by the sum-of-squares rule.

Every task packs the documents of its own partition, so nothing is shuffled and a lost task is simply run again.
A document is its token ids followed by an end id. Windows' worth of ids at its front become windows of their own;
the rest goes to the fill level that leaves the smallest sum of squared counts of partially filled windows. The
counts are kept in a level array; at most MAX_OPEN windows are open, and beyond that a document is cut to complete
the fullest one. When a partition ends, the pieces of the emptiest open window are placed in the other ones by the same
rule, again and again; a piece that fits in none is cut to complete the fullest. One partly filled window a partition
remains at most.

Null texts count as empty, an empty document is its end id alone, equal rows are packed as separate documents, a
null id stays null, an empty table gives no rows, and columns other than the two named are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_OPEN = 256
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

_LONG_RUN = re.compile(r"\S{5000}")
_OTHER_SCRIPTS = re.compile("[^\x00-ɏ‐-‧]")
_loaded: dict[str, tuple] = {}


def _libraries(path: str) -> tuple:
    """The tokenizers file itself and, where a file of ranks lies beside it, the same vocabulary in tiktoken."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        exact.no_truncation()
        exact.no_padding()
        quick, ranks = None, path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import base64

            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as lines:
                merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
            quick = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=merged, special_tokens=special)
        _loaded[path] = exact, quick
    return _loaded[path]


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids that the tokenizers library gives for a whole text, without added special tokens.

    tiktoken reads the same vocabulary several times as fast; scripts whose character tables may differ between
    the two libraries, and long runs without white space, go to the tokenizers library itself.
    """
    exact, quick = _libraries(path)
    if quick is None or _OTHER_SCRIPTS.search(text) or (len(text) > 5000 and _LONG_RUN.search(text)):
        return np.asarray(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
    return quick.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


class LevelArray:
    """Open windows by fill level, and the sum-of-squares choice among them."""

    def __init__(self, window: int, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def choose(self, size: int, new: bool = True) -> int | None:
        """The level (0: a new window) with the least change of the sum of squares; ties go to the fullest.

        Without new, None where no open window has room.
        """
        top = self.window - size
        held, then = self.counts[: top + 1], self.counts[size:]
        change = 2 * (then - held) + 2
        change[held == 0] = np.iinfo(np.int64).max
        change[0] = 2 * then[0] + 1
        if top:
            # a completed window is no longer partial
            change[top] = 1 - 2 * held[top] if held[top] else change[top]
        else:
            change[0] = 0
        if not new:
            change[0] = np.iinfo(np.int64).max
            if not held[1:].any():
                return None
        return top - int(np.argmin(change[::-1]))

    def take(self, level: int) -> list:
        if level == 0:
            return []
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def put(self, level: int, pieces: list) -> None:
        self.counts[level] += 1
        self.n_open += 1
        self.open[level].append(pieces)

    def fullest(self) -> int:
        return int(np.flatnonzero(self.counts)[-1])

    def emptiest(self) -> int:
        return int(np.flatnonzero(self.counts)[0])


def windows(documents: Iterable[tuple[int | None, np.ndarray]], window: int, max_open: int = MAX_OPEN) -> Iterator[list]:
    """Completed windows as lists of pieces (doc id, start, ids, document's ids)."""
    levels = LevelArray(window, max_open)
    for doc, ids in documents:
        n = len(ids)
        start = n - n % window
        for at in range(0, start, window):
            yield [(doc, at, ids[at : at + window], n)]
        while start < n:
            size = n - start
            level = levels.choose(size)
            if level == 0 and levels.n_open >= max_open:
                level = levels.fullest()
                size = min(size, window - level)
            pieces = levels.take(level)
            pieces.append((doc, start, ids[start : start + size], n))
            start += size
            if level + size == window:
                yield pieces
            else:
                levels.put(level + size, pieces)
    while levels.n_open > 1:
        for doc, start, ids, n in levels.take(levels.emptiest()):
            while len(ids):
                level = levels.choose(len(ids), new=False)
                if level is None:
                    level = levels.fullest() if levels.n_open else 0
                pieces = levels.take(level)
                pieces.append((doc, start, ids[: window - level], n))
                size = len(pieces[-1][2])
                start, ids = start + size, ids[size:]
                if level + size == window:
                    yield pieces
                else:
                    levels.put(level + size, pieces)
    if levels.n_open:
        yield levels.take(levels.fullest())


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, max_open: int = MAX_OPEN) -> DataFrame:
    """Pieces of the documents (doc_id, text) with their place: sequence_id and offset, gapless from 0.

    ids holds the piece's token ids as little-endian unsigned 32-bit integers. tokenizer is the path of a
    tokenizers file that every worker can read.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33

        def documents() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield doc, np.append(token_ids(text or "", tokenizer), np.uint32(end_id))

        def rows(held: list) -> pa.RecordBatch:
            doc, start, length, ids, total, sequence, offset = map(list, zip(*held, strict=True))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            columns = (doc, start, length, ids, total, sequence, offset)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        held: list[tuple] = []
        for k, pieces in enumerate(windows(documents(), window, max_open)):
            offset = 0
            for doc, start, ids, n in pieces:
                held.append((doc, start, len(ids), ids.astype("<u4").tobytes(), n, first + k, offset))
                offset += len(ids)
            if len(held) >= 2000:
                yield rows(held)
                held = []
        if held:
            yield rows(held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, SCHEMA)


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with a CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
