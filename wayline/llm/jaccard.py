"""Exact Jaccard join of documents on word n-grams, as a blocked sparse matrix product.

1. Word counts over all documents, in a table of fixed size, order n-grams from rare words to common ones. Any
   fixed order serves a correct join.
2. Each document's set is profiled: size, signature, and its prefix, the n-grams of which two sets as alike as asked
   must share one. Equal sets collapse to their least id. N-grams that more than HEAVY prefixes have, boilerplate of
   rare words, are then put last in the order, the more frequent the later, and the sets that had one in their prefix
   get another. Otherwise they would chain most of a large table to one candidate group.
3. The product of the prefix incidences gives, for each pair of sets, how many prefix n-grams they share; pairs whose
   sizes, counts and positions leave no room for the overlap asked for are discarded. An n-gram that more than HEAVY
   sets of about one size have in their prefixes is not multiplied out: it makes one candidate group of them. N-grams
   are counted by partial sums and joined back, so one that a third of all sets have is split like any skewed join.
4. A candidate group is cut into blocks. For each pair of blocks, the incidence matrices of documents by n-grams are
   multiplied, which accumulates the overlap counts; pairs below the bound that the sizes give are discarded, and
   each task returns edges that connect what it has linked, not all pairs.
5. Components of those edges give the result.

Equal sets are one class, known by 128 bits of sums over its hashed n-grams; the first 64 stand for it in edges. Rows
are documents of their own, also where they repeat an id: one id in two texts links neither to the other. Null and
empty texts and texts without words have empty sets and link with nothing. A null id is kept and links with nothing.
Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.operators.components import Forest, components
from wayline.llm.shingles import mix, shingle_hashes, shingle_rarity, word_hashes
from wayline.session import unused, written

TABLE_BITS, CHUNK, HEAVY = 20, 1 << 14, 64
#: N-grams that are put last, at most: others keep their place.
LAST = 1 << 20
#: A block has so many documents or n-grams, about, at most.
BLOCK, BLOCK_GRAMS = 512, 700_000
#: Rows of ids that may be broadcast; more are joined by a shuffle, of the texts whose bit is set among so many.
FEW_IDS, BITS = 200_000, 1 << 26
#: Places in the order: those of n-grams by their words, and above them, those of the n-grams that are put last.
LEVELS, TOP = 4031, 4095
TAIL = (1 << 52) - 1
#: Words that a task holds before it counts them.
WORDS = 1 << 20
#: A set of at least STEPS[k] n-grams must share k + 2 prefix n-grams with another such set.
STEPS = (16, 48, 128)


def commonness(docs: DataFrame) -> np.ndarray:
    """For each of 2^TABLE_BITS buckets of words, eight times the logarithm of the occurrences in all texts.

    Tasks count in a table of that size; its chunks are summed in two steps, so no task reads one of every task.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1 << TABLE_BITS, dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, words in word_hashes(batch.column(0).to_pylist()):
                held.append((words >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
                size += len(words)
                if size > WORDS:
                    totals += np.bincount(np.concatenate(held), minlength=len(totals))
                    held, size = [], 0
        if held:
            totals += np.bincount(np.concatenate(held), minlength=len(totals))
        yield _chunks(totals, TaskContext.get().partitionId() % 64)

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), dtype=np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"chunk": [table.column("chunk")[0].as_py()], "salt": pa.array([0], pa.int32()), "counts": [zlib.compress(total.tobytes(), 1)]}).cast(_CHUNKS)

    parts = docs.select("text").mapInArrow(counted, "chunk int, salt int, counts binary")
    parts = parts.groupBy("chunk", "salt").applyInArrow(summed, "chunk int, salt int, counts binary")
    parts = parts.groupBy("chunk").applyInArrow(summed, "chunk int, salt int, counts binary")
    out = np.zeros(1 << TABLE_BITS, dtype=np.int64)
    for r in parts.collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), dtype=np.int64)
    return np.minimum(8 * np.log2(1 + out), 255).astype(np.uint8)


_CHUNKS = pa.schema([("chunk", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())])


def _chunks(totals: np.ndarray, salt: int) -> pa.RecordBatch:
    n = len(totals) // CHUNK
    counts = [zlib.compress(totals[k * CHUNK : (k + 1) * CHUNK].tobytes(), 1) for k in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([salt] * n, pa.int32()), pa.array(counts, pa.binary())], schema=_CHUNKS)


def ordered_set(words: np.ndarray, n: int, common: np.ndarray, last: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The distinct shingles, those of rare words first; rarity is in the top 12 bits, the hash in the others.

    last has the hashes, sorted, and the rarities of those that come after all others.
    """
    rarity, tails = np.minimum(shingle_rarity(words, n, common), LEVELS), shingle_hashes(words, n) >> np.uint64(12)
    if last is not None and len(last[0]):
        at = np.minimum(np.searchsorted(last[0], tails), len(last[0]) - 1)
        rarity = np.where(last[0][at] == tails, last[1][at], rarity)
    return np.unique((rarity << np.uint64(52)) | tails)


def frequent(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes, sorted, of those of grams (gram) that are in more than HEAVY rows, and their places in the order."""
    counted = grams.groupBy(F.col("gram").bitwiseAND(F.lit(TAIL)).alias("tail")).agg(F.count("*").alias("sets")).where(F.col("sets") > HEAVY)
    found = counted.orderBy(F.desc("sets")).limit(LAST).toArrow()
    tails, sets = (found.column(c).to_numpy().astype(np.int64) for c in ("tail", "sets"))
    order = np.argsort(tails)
    levels = np.minimum(LEVELS + 1 + np.floor(2 * np.log2(np.maximum(sets, 1))), TOP)
    return tails[order].astype(np.uint64), levels[order].astype(np.uint64)


def prefix_length(size: int, share: tuple[int, int]) -> int:
    """Two sets as alike as the share have in common, in prefixes so long in any one order, needed(size) elements."""
    return size - -(-share[0] * size // share[1]) + needed(size) if size else 0


def needed(size: int) -> int:
    return 1 + sum(size >= s for s in STEPS)


def candidates(classes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Edges (a, b) between sets that may link: from classes (rep, n_shingles, prefix)."""
    rows = classes.select("rep", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("pos", "gram"))
    shared = rows.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1").select("gram")
    columns = rows.join(shared.hint("merge"), "gram", "left_semi")
    # sizes of linked sets differ by the share at most: they are in one class of sizes, or in two that are neighbours
    size_class = F.floor(F.log(F.col("n").cast("double")) / (math.log(share[1] / share[0]) * 1.000001)).cast("int")
    places = F.array(F.struct(size_class.alias("class"), F.lit(True).alias("home")), F.struct((size_class + 1).alias("class"), F.lit(False).alias("home")))
    placed = columns.withColumn("place", F.explode(places)).select(F.xxhash64("gram", "place.class").alias("spot"), "rep", "n", "pos", "place.home")
    placed = written(placed, "placed")
    counts = placed.groupBy("spot").agg(F.count("*").alias("sets"), F.max("home").alias("homes"), F.min("rep").alias("first")).where("sets > 1 AND homes").drop("homes")
    # no step after this join needs its partitioning, so that a skewed n-gram can be split
    met = written(placed.join(counts.hint("merge"), "spot"), "met")
    heavy = met.where((F.col("sets") > HEAVY) & (F.col("rep") != F.col("first"))).select(F.col("rep").alias("a"), F.col("first").alias("b"))
    light = met.where(F.col("sets") <= HEAVY).groupBy("spot").agg(F.collect_list(F.struct("rep", "n", "pos", "home")).alias("held"))
    size_bound = lambda x, y: share[1] * F.least(x, y) >= share[0] * F.greatest(x, y)
    partner = lambda y: y["home"] & (~F.col("x.home") | (y["rep"] > F.col("x.rep"))) & size_bound(y["n"], F.col("x.n"))
    pairs = light.select("held", F.explode("held").alias("x")).select("x", F.explode(F.filter("held", partner)).alias("y"))
    product = pairs.groupBy(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).agg(
        F.count("*").alias("both"), F.max("x.pos").alias("at"), F.max("y.pos").alias("bt"), F.first("x.n").alias("n"), F.first("y.n").alias("m")
    )
    step = lambda c: sum(((c >= s).cast("int") for s in STEPS), F.lit(1))
    # what both have so far and what the shorter rest could add, against the least overlap for the share
    room = F.col("both") + F.least(F.col("n") - 1 - F.col("at"), F.col("m") - 1 - F.col("bt"))
    enough = (share[0] + share[1]) * room >= share[0] * (F.col("n") + F.col("m"))
    kept = product.where(enough & (F.col("both") >= F.least(step(F.col("n")), step(F.col("m")))))
    return kept.select("a", "b").unionByName(heavy)


def profiles(docs: DataFrame, n: int, share: tuple[int, int], common: Broadcast) -> DataFrame:
    """Size, signature and prefix of the set of each of docs (doc_id, own, text)."""
    return _profiled(docs, n, share, common, None, 1)


def _profiled(docs: DataFrame, n: int, share: tuple[int, int], common: Broadcast, last: Broadcast | None, times: int) -> DataFrame:
    """profiles() with prefixes in the order of `last`, and so many times as long; signatures know nothing of it."""

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ones, twos, prefixes = [], [], [], []
            for _, words in word_hashes(batch.column(2).to_pylist()):
                own = ordered_set(words, n, common.value)
                sizes.append(len(own))
                ones.append(int(np.add.reduce(mix(own), dtype=np.uint64).astype(np.int64)))
                twos.append(int(np.add.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64).astype(np.int64)))
                if last is not None:
                    own = ordered_set(words, n, common.value, last.value)
                prefixes.append(own[: times * prefix_length(len(own), share)].astype(np.int64))
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, dtype=np.int64)
            offsets = np.cumsum([0, *map(len, prefixes)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, ones, twos)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "own", "n_shingles", "s1", "s2", "prefix"])

    return docs.select("doc_id", "own", "text").mapInArrow(profiled, "doc_id long, own long, n_shingles long, s1 long, s2 long, prefix array<long>")


def having(classes: DataFrame, last: Broadcast, wanted: bool = True) -> DataFrame:
    """The classes (doc_id, own, rep, n_shingles, prefix) with an n-gram in their prefix that comes last, or those without one."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tails = last.value[0]
        for batch in batches:
            lists = batch.column(4)
            own = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64) & np.uint64(TAIL)
            hits = np.cumsum(tails[np.minimum(np.searchsorted(tails, own), len(tails) - 1)] == own)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            sums = np.concatenate(([0], hits))[np.concatenate(([0], ends))]
            yield batch.filter(pa.array((sums[1:] > sums[:-1]) == wanted))

    columns = classes.select("least.doc_id", "least.own", "rep", "n_shingles", "prefix")
    return columns.mapInArrow(found, columns.schema)


def marked(docs: DataFrame, side: DataFrame) -> DataFrame:
    """The documents whose doc_id and own are in a table, and few others: a bitmap of a fixed size tells them, no shuffle."""
    spot = F.pmod(F.xxhash64("doc_id", "own"), F.lit(BITS)) + 1
    at = F.bitmap_bit_position(spot)
    marks = side.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = docs.join(F.broadcast(marks), F.bitmap_bucket_number(spot) == F.col("__bucket"))
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(docs.columns)


def picked(docs: DataFrame, side: DataFrame) -> DataFrame:
    """docs joined with a written table by doc_id and own; texts that take no part are not shuffled."""
    if side.count() <= FEW_IDS:
        return docs.join(F.broadcast(side), ["doc_id", "own"])
    return marked(docs, side).join(side.hint("merge"), ["doc_id", "own"])


def settled(docs: DataFrame, classes: DataFrame, n: int, share: tuple[int, int], common: Broadcast) -> DataFrame:
    """(rep, n_shingles, prefix) of the classes, in an order in which what many prefixes have comes last.

    What comes instead of it is looked up in the sets that have it, three prefixes far, as it may be as frequent. All sets
    that have any of it in their prefix are profiled again; the others' prefixes are the same in the new order.
    """
    context = docs.sparkSession.sparkContext
    last = frequent(classes.select(F.explode("prefix").alias("gram")))
    if not len(last[0]):
        return classes.select("rep", "n_shingles", "prefix")

    def again(order: Broadcast, times: int) -> DataFrame:
        side = written(having(classes, order).select("doc_id", "own", "rep"), "having")
        found = _profiled(marked(docs, side), n, share, common, order, times).drop("s1", "s2")
        return found.join(side, ["doc_id", "own"]).dropDuplicates(["doc_id", "own"]).select("rep", "n_shingles", "prefix")

    more = frequent(again(context.broadcast(last), 3).select(F.explode("prefix").alias("gram")))
    tails, levels = (np.concatenate(x) for x in zip(last, more, strict=True))
    high = np.lexsort((levels, tails))[::-1]  # the higher of two levels
    tails, first = np.unique(tails[high], return_index=True)
    order = context.broadcast((tails, levels[high][first]))
    return having(classes, order, False).select("rep", "n_shingles", "prefix").unionByName(written(again(order, 1), "prefixes"))


def linked(sets: list[np.ndarray], sides: np.ndarray | None, share: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of places that link; where sides are given, of different sides only. Overlaps by matrix products."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    kept = times[column] > 1
    if not kept.any():
        return []
    rows, column = rows[kept], (np.cumsum(times > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    overlap = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, column[-1] + width, width))
    for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if lo == hi:
            continue
        present = np.unique(rows[lo:hi])
        block = np.zeros((len(present), width), dtype=np.float32)
        block[np.searchsorted(present, rows[lo:hi]), column[lo:hi] - k * width] = 1
        overlap[np.ix_(present, present)] += block @ block.T
    a, b = np.nonzero(np.triu(overlap, 1))
    bound = share[1] * np.minimum(sizes[a], sizes[b]) >= share[0] * np.maximum(sizes[a], sizes[b])
    if sides is not None:
        bound &= sides[a] != sides[b]
    a, b = a[bound], b[bound]
    both = overlap[a, b].astype(np.int64)
    link = share[1] * both >= share[0] * (sizes[a] + sizes[b] - both)
    return list(zip(a[link].tolist(), b[link].tolist(), strict=True))


def _grouped(docs: DataFrame, n: int, share: tuple[int, int], block: int) -> DataFrame:
    """(doc_id, own, n_shingles, kept) of documents (doc_id, own, text), own being a hash of the text.

    kept (doc_id, own) is the least row of the row's component; null where the set is empty or the id null.
    """
    common = docs.sparkSession.sparkContext.broadcast(commonness(docs))
    profile = written(profiles(docs, n, share, common), "profiles")
    useful = profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
    grouped = useful.groupBy(F.col("s1").alias("rep"), "s2").agg(F.min(F.struct("doc_id", "own")).alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix"))
    classes = written(grouped, "classes")

    group = written(components(candidates(settled(docs, classes, n, share, common), share)), "candidates")
    counted = group.join(classes.select(F.col("rep").alias("id"), "n_shingles", "least"), "id")
    counted = written(counted, "candidate-sizes")
    sizes = counted.groupBy("component").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("grams"))
    sizes = written(sizes.withColumn("blocks", F.greatest(F.ceil(F.col("count") / block), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")), "group-sizes")
    alone = sizes.where("blocks = 1").agg(F.sum("count"), F.sum("grams")).first()

    small = F.col("blocks") == 1
    bins = int(max(1, (alone[0] or 0) // block, (alone[1] or 0) // BLOCK_GRAMS))
    member = (
        counted.join(sizes.select("component", "blocks"), "component")
        .withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("lo", F.least("mine", "other"))
        .withColumn("hi", F.greatest("mine", "other"))
        .withColumn("task", F.when(small, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.xxhash64("component", "lo", "hi")))
        .withColumn("side", F.when(F.col("lo") == F.col("hi"), -1).otherwise((F.col("mine") == F.col("hi")).cast("int")))
        .select("least.doc_id", "least.own", "id", "task", "side")
    )

    def multiplied(table: pa.Table) -> pa.Table:
        ids, sides = np.array(table.column("id").to_pylist(), dtype=np.int64), np.array(table.column("side").to_pylist())
        _, once = np.unique(ids, return_index=True)  # rows that repeat id and text
        texts = table.column("text").to_pylist()
        sets = [np.unique(shingle_hashes(words, n)) for _, words in word_hashes([texts[k] for k in once])]
        ids, sides, forest = ids[once], sides[once], Forest()
        for a, b in linked(sets, sides if (sides >= 0).all() else None, share):
            forest.join(int(ids[a]), int(ids[b]))
        edges = forest.edges()
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    blocks = picked(docs, written(member, "members")).select("id", "text", "task", "side")
    found = written(components(blocks.groupBy("task").applyInArrow(multiplied, "a long, b long")), "linked")
    # the least row of each component of more than one class, for the members that are not alone
    least = found.join(classes.select(F.col("rep").alias("id"), "least"), "id").groupBy("component").agg(F.min("least").alias("kept"))
    named = found.join(least, "component").select(F.col("id").alias("rep"), "kept")
    named = classes.select("rep", "s2", "least").join(named, "rep", "left").select(F.col("rep").alias("s1"), "s2", F.coalesce("kept", "least").alias("kept"))
    whole = profile.select("doc_id", "own", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("s1")).alias("s1"), "s2")
    return whole.join(named, ["s1", "s2"], "left").select("doc_id", "own", "n_shingles", "kept")


def jaccard_groups(docs: DataFrame, n: int = 5, share: tuple[int, int] = (80, 100), block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of documents (doc_id, text).

    Two documents link when the intersection of their sets is at least share[0] / share[1] of the union.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("own", F.xxhash64("text"))
    return _grouped(rows, n, share, block).select("doc_id", "n_shingles", F.coalesce("kept.doc_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """The documents, with all of their columns, that are the least row, by id and text, of their component.

    Rows with a null id or an empty set stay. Of rows that have id and text in common one stays. What goes is the
    smaller part, so the documents are held against that.
    """
    doc, own, times = (unused(x, docs.columns) for x in ("__doc", "__own", "__times"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("own", F.xxhash64("text"))
    decided = _grouped(rows, n, share, BLOCK).where("kept IS NOT NULL")
    keys = decided.groupBy("doc_id", "own").agg(F.first("kept").alias("kept"), F.count("*").alias("times"))
    keys = keys.where("times > 1 OR kept <> struct(doc_id, own)").select(F.col("doc_id").alias(doc), F.col("own").alias(own), F.when(F.expr("kept = struct(doc_id, own)"), F.col("times")).alias(times))
    keys = written(keys, "gone")
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own))
    kept = docs.join(keys.where(F.col(times).isNull()), same, "left_anti")
    again = keys.where(F.col(times).isNotNull())
    if not again.take(1):
        return kept
    once = kept.join(again, same).dropDuplicates([doc, own]).select(docs.columns)
    return kept.join(again, same, "left_anti").unionByName(once)
