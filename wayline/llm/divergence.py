"""Source divergence audit: how far each source's words are from those of the other sources of its language.

A task reads its documents as concatenated UTF-8 buffers. A lookup table of 256 entries says which bytes belong to
terms (ASCII letters, lower-cased, and all of code points beyond ASCII), which gives the terms' boundaries; xxhash
groups the slices, and every slice is compared byte by byte with the first of its group, so that terms with equal
hashes stay apart. Counts are added up in the task before they are shuffled, once, by (language, term).

A language keeps the terms that are in at least LEAST_DOCUMENTS of its documents, V of them. Every (language, source)
group and every language gives each kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being the sum of its counts
over kept terms; two such shares diverge by floor((p - q)^2 / (p + q)). Blocks of a language's terms become CSR matrices,
sources by terms, and all pairs of sources are compared on the entries that are not empty (`np.add.reduceat` by row);
what empty ones give depends on two sources only. Divergences of blocks are added up. Languages with many sources are
also cut into tiles of sources. All arithmetic is on integers and exact, for N + 2 V below 9 * 10^15.

Null texts, languages and sources count as empty ones; rows that repeat an id are documents of their own; texts
without terms still make their group; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.session import written

LEAST_DOCUMENTS, TOP = 10, 10
#: Entries that a task holds before it hands them on; slices that it looks at together; entries of a block; sources of a tile.
HELD, SLICES, BLOCK, TILE = 400_000, 1 << 19, 20_000, 256
COUNTS = "lang string, source string, term string, n long, d long"

_TERM = np.zeros(256, dtype=bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def boundaries(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in concatenated texts, of which breaks are the starts: no term goes over one."""
    inside = _TERM[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    own = breaks[(breaks > 0) & (breaks < len(data))]
    first[own], last[own - 1] = inside[own], inside[own - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the terms. Slices are grouped by hash; all bytes of a group are compared."""
    text = data.tobytes()
    keys = np.fromiter((hashed(text[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    sizes, like = ends - starts, starts[first][of]
    other = sizes != sizes[first][of]
    same = np.flatnonzero(~other)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes[same]) >> 20)) + 1
    for part in np.split(same, cuts):
        n = sizes[part]
        along = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differs = data[np.repeat(starts[part], n) + along] != data[np.repeat(like[part], n) + along]
        if differs.any():
            other[part[np.add.reduceat(differs, np.cumsum(n) - n) > 0]] = True
    terms = [text[starts[k] : ends[k]] for k in first.tolist()]
    late: dict[bytes, int] = {}
    for k in np.flatnonzero(other).tolist():
        of[k] = late.setdefault(text[starts[k] : ends[k]], len(terms) + len(late))
    return of, [*terms, *late]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's texts, one after the other, and the offsets of the texts; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return _LOWER[data], offsets - offsets[0]


def _tallied(column: pa.Array, hashed: Callable[[bytes], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Documents, terms (numbers) and counts of a batch's (document, term) pairs, and the terms."""
    data, offsets = _buffers(column)
    starts, ends = boundaries(data, offsets)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    number: dict[bytes, int] = {}
    found = []
    for at in range(0, len(starts), SLICES):
        part = slice(at, at + SLICES)
        low, high = starts[part][0], ends[part][-1]
        of, terms = grouped(data[low:high], starts[part] - low, ends[part] - low, hashed)
        names = np.array([number.setdefault(t, len(number)) for t in terms], dtype=np.int64)
        pairs, times = np.unique((doc[part] << 32) | names[of], return_counts=True)
        found.append((pairs, times))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(3)), [])
    pairs, times = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    if len(found) > 1:
        pairs, of = np.unique(pairs, return_inverse=True)
        times = np.bincount(of, weights=times).astype(np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF, times, list(number)


def counted(docs: DataFrame, hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """(lang, source, term, n, d): parts of the occurrences of each term in each group, and of its documents there.

    Each group also has rows without a term, so that those without any terms are known.
    """

    def batch_of(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            terms, packed = [None, *own], np.array([0, *own.values()], dtype=object)
            for at in range(0, len(terms), 50_000):
                part = terms[at : at + 50_000]
                values = packed[at : at + 50_000]
                n, d = (np.array([f(x) for x in values], dtype=np.int64) for f in (lambda x: x >> 40, lambda x: x & ((1 << 40) - 1)))
                columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(n), pa.array(d)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        for batch in batches:
            groups = list(zip(*(batch.column(c).fill_null("").to_pylist() for c in ("lang", "source")), strict=True))
            for g in groups:
                held.setdefault(g, {})
            name = {g: k for k, g in enumerate(dict.fromkeys(groups))}
            of_doc = np.array([name[g] for g in groups], dtype=np.int64)
            doc, term, times, terms = _tallied(batch.column("text"), hashed)
            if len(doc):
                pairs, of = np.unique((of_doc[doc] << 32) | term, return_inverse=True)
                n, d = np.zeros(len(pairs), np.int64), np.bincount(of)
                np.add.at(n, of, times)
                cut = np.searchsorted(pairs, np.arange(len(name) + 1) << 32)
                for k, g in enumerate(name):
                    own, part = held[g], slice(cut[k], cut[k + 1])
                    for t, a, b in zip((pairs[part] & 0xFFFFFFFF).tolist(), n[part].tolist(), d[part].tolist(), strict=True):
                        x = terms[t]
                        own[x] = own.get(x, 0) + (a << 40 | b)
            if sum(map(len, held.values())) > HELD:
                yield from batch_of(held)
                held = {}
        yield from batch_of(held)

    named = docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    return named.mapInArrow(rows, COUNTS)


def share(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / whole), by long division in steps of 1000: exact, and no step overflows."""
    out, rest = np.zeros(np.broadcast(count, whole).shape, dtype=np.int64), np.asarray(count, dtype=np.int64) + 2
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + step
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def divergences(blank: np.ndarray, start: np.ndarray, term: np.ndarray, p: np.ndarray, width: int, pairs_from: Callable[[int], int], upto: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each source s of the first `upto` rows of a CSR matrix (start, term, p), its divergences from the rows
    pairs_from(s) and on, summed over the matrix's `width` terms. blank: what a source gives a term that it lacks."""
    source = np.repeat(np.arange(len(blank)), np.diff(start))
    dense = np.empty(width, dtype=np.int64)
    for s in range(upto):
        lo = pairs_from(s)
        if lo >= len(blank):
            continue
        dense[:] = blank[s]
        dense[term[start[s] : start[s + 1]]] = p[start[s] : start[s + 1]]
        # as if the others lacked every term: equal shares go together
        values, times = np.unique(dense, return_counts=True)
        out = np.zeros(len(blank) - lo, dtype=np.int64)
        for at in range(0, len(values), 4096):
            out += times[at : at + 4096] @ apart(values[at : at + 4096, None], blank[None, lo:])
        # and what their entries change
        cells = slice(start[lo], start[-1])
        own = dense[term[cells]]
        change = apart(own, p[cells]) - apart(own, blank[source[cells]])
        full = np.flatnonzero(np.diff(start[lo:]))
        if len(full):
            out[full] += np.add.reduceat(change, start[lo:-1][full] - start[lo])
        yield s, out


def _audited(top: int):
    def rows(entries: pa.Table, groups: pa.Table) -> pa.Table:
        at = {n: groups.column(n).to_pylist() for n in groups.column_names}
        lang, low, high = at["lang"][0], at["lo"][0], at["hi"][0]
        order = sorted(range(len(at["source"])), key=lambda k: (at["tile"][k] != low, at["source"][k]))
        sources = [at["source"][k] for k in order]
        split = sum(at["tile"][k] == low for k in order)
        whole = np.array([at["whole"][k] for k in order], dtype=np.int64)
        name = {s: k for k, s in enumerate(sources)}
        words = entries.column("term").to_pylist()
        terms = sorted(set(words))  # code points sort as UTF-8 does
        number = {t: k for k, t in enumerate(terms)}
        source = np.array([name[s] for s in entries.column("source").to_pylist()], dtype=np.int64)
        term, n, total = np.array([number[w] for w in words], dtype=np.int64), entries.column("n").to_numpy(), entries.column("total").to_numpy()
        by = np.lexsort((term, source))
        source, term, n, total = source[by], term[by], n[by], total[by]
        start = np.searchsorted(source, np.arange(len(sources) + 1))
        p = share(n, whole[source]) if len(n) else np.zeros(0, np.int64)
        blank = share(np.zeros(len(sources), np.int64), np.maximum(whole, 1))
        out: tuple[list, ...] = ([], [], [], [])

        def add(part: str, source: str, items: list[str], values: list[int]) -> None:
            for column, x in zip(out, ([part] * len(items), [source] * len(items), items, values), strict=True):
                column += x

        # the task's own terms are those that one of its sources has; a language's others are added once, by block 0
        lacking = (at["v"][0] if at["block"][0] == 0 else 0) - len(terms)
        apart_tiles = low != high
        for s, values in divergences(blank, start, term, p, len(terms), (lambda s: split) if apart_tiles else (lambda s: s + 1), split):
            lo = split if apart_tiles else s + 1
            add("pair", sources[s], sources[lo:], (values + lacking * apart(blank[s], blank[lo:])).tolist())
        if not apart_tiles and len(n):
            q = share(total, at["lang_whole"][0])
            for s in range(len(sources)):
                own = np.arange(start[s], start[s + 1])
                own = own[p[own] > q[own]]
                value = apart(p[own], q[own])
                best = np.lexsort((term[own], -value))[:top]
                add("term", sources[s], [terms[k] for k in term[own[best]].tolist()], value[best].tolist())
        return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), "part": pa.array(out[0], pa.string()), "source": pa.array(out[1], pa.string()), "item": pa.array(out[2], pa.string()), "value": pa.array(out[3], pa.int64())})

    return rows


def kept_terms(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """(lang, source, term, n, total, leads): occurrences of each kept term in each group that has it and in the language;
    leads marks one row of each (lang, term). Each group also has a row without a term."""
    # one shuffle: it serves the sums by group and the windows over the groups of a term
    sums = counted(docs, hashed).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    word = Window.partitionBy("lang", "term")
    rows = sums.withColumns({"total": F.sum("n").over(word), "df": F.sum("d").over(word), "leads": F.row_number().over(word.orderBy("source")) == 1})
    return rows.where(F.col("term").isNull() | (F.col("df") >= least_documents)).select("lang", "source", "term", "n", "total", (F.col("leads") & F.col("term").isNotNull()).alias("leads"))


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK, tile: int = TILE, hashed: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    Part `pair`: the other sources of the language by divergence over all kept terms, 0 if there are none. Part `term`:
    the `top` terms to which the group gives more than its language does. Ranks go by value, then by item.
    """
    kept = written(kept_terms(docs, least_documents, hashed), "kept-terms")
    groups = written(kept.groupBy("lang", "source").agg(F.sum("n").alias("sum")), "groups")
    langs = written(
        kept.groupBy("lang").agg(F.count_if("leads").alias("v"), F.sum(F.when(F.col("leads"), F.col("total")).otherwise(0)).alias("lang_sum"), F.count("term").alias("entries"), F.count_if(F.col("term").isNull()).alias("sources")).select(
            "lang", "v", (F.col("lang_sum") + 2 * F.col("v")).alias("lang_whole"),
            F.greatest(F.lit(1), F.ceil(F.col("entries") / block)).cast("int").alias("blocks"), F.ceil(F.col("sources") / tile).cast("int").alias("tiles"),
        ),
        "langs",
    )

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows with (lang, block, lo, hi) of each task that needs them: a row of a tile meets every tile."""
        own = rows.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return own.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")})

    key = ["lang", "block", "lo", "hi"]
    entries = kept.where(F.col("term").isNotNull()).join(langs, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
    every = groups.join(langs, "lang").withColumn("whole", F.col("sum") + 2 * F.col("v")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = dealt(entries).select(*key, "source", "term", "n", "total").groupBy(*key)
    right = dealt(every).select(*key, "source", "tile", "whole", "lang_whole", "v").groupBy(*key)
    found = written(left.cogroup(right).applyInArrow(_audited(top), "lang string, part string, source string, item string, value long"), "divergences")

    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    sums = found.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    terms = found.where("part = 'term'").select("lang", "part", "source", "item", "value")
    return ranked(both).union(ranked(terms).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
