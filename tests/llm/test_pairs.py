"""Embeddings, lines, shingles and the pipeline."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayline.llm import collisions, jaccard, lines, packing, queries, secrets
from wayline.llm import shingles as hashing
from wayline.operators.components import Forest
from wayline.session import table, written

DOCS = "doc_id long, text string"


def test_embeddings(spark):
    dice = np.random.default_rng(0)
    base = dice.standard_normal((700, 32))
    near = base[:200].repeat(3, axis=0) + 0.1 * dice.standard_normal((600, 32))
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate((base, near, base[:20])))]
    got = {r.vec_id: r for r in collisions.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    found = sum(got[k].n_links for k in got) / link.sum()
    assert 0.95 <= found <= 1
    assert all(got[k].n_links <= link[k].sum() for k in got)
    exact = Forest()
    for a, b in zip(*np.nonzero(link), strict=True):
        exact.join(int(a), int(b))
    assert sum(exact.find(k) == got[k].component_id for k in got) / len(got) > 0.97


def test_recall_at_the_least_cosine(spark):
    """Pairs barely above the least cosine, strangers otherwise: at least 0.95 of them are found, and no others."""
    dice = np.random.default_rng(11)
    a, b = dice.standard_normal((2, 1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    cosine = 0.9505
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate((a, cosine * a + np.sqrt(1 - cosine**2) * b)))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in collisions.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    found = sum(got[k + 1500] == (1, k) for k in range(1500)) / 1500
    assert found >= 0.95
    assert all(n == 0 and c == k or (n, c) == (1, k % 1500) for k, (n, c) in got.items())


def test_embedding_edges(spark):
    rows = [(None, [1.0]), (0, None), (1, []), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, 0.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0]), (6, [1e-200, 1e-210]), (7, [1.0, None]), (8, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id) for r in collisions.near_vectors(df).collect())
    assert got == [(-1, 0, None), (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (5, 3, 4), (5, 3, 4), (6, 3, 4), (7, 0, 7), (8, 0, 8)]
    assert collisions.near_vectors(df.limit(0)).count() == 0


def lev_within(a, b, k):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
    return d[-1] <= k


def edit(dice, text, alphabet="abc"):
    out = list(text)
    for _ in range(dice.randint(0, 4)):
        k = dice.randint(0, len(out))
        kind = dice.random()
        if kind < 0.3 or k == len(out):
            out.insert(k, dice.choice(alphabet))
        elif kind < 0.6:
            out.pop(k)
        else:
            out[k] = dice.choice(alphabet)
    return "".join(out)


def test_banded_distance():
    dice = random.Random(1)
    for _ in range(4000):
        a = "".join(dice.choices("abc", k=dice.randint(0, 14)))
        b = edit(dice, a)
        for k in (1, 2, 3):
            assert lines.distance_within(a, b, k) == lev_within(a, b, k)


def removed(rows, edits, least):
    """What goes from each row (doc_id, text), by its place in rows: equal lines, and near ones that are long enough."""
    spots = defaultdict(list)
    for at, (_, text) in enumerate(rows):
        for k, line in enumerate(text.split("\n") if text is not None else ()):
            if line.strip(" \t\n\r\v\f"):
                spots[line].append((at, k))
    every, forest = sorted(spots), Forest()
    for i, a in enumerate(every):
        for j in range(i):
            if min(len(a), len(every[j])) >= least and abs(len(a) - len(every[j])) <= edits and lev_within(a, every[j], edits):
                forest.join(i, j)
    classes = defaultdict(list)
    for i, a in enumerate(every):
        classes[forest.find(i)] += [(s, a) for s in spots[a]]
    gone = defaultdict(list)
    for members in classes.values():
        members.sort()
        for (at, k), line in members[1:]:
            gone[rows[at][0]].append((k, line == members[0][1]))
    return gone


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines(spark, edits):
    dice = random.Random(edits)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    base = [" ".join(dice.choices(words, k=dice.randint(4, 8))) for _ in range(20)] + ["}", "end.", " ", ""]
    rows = [(d, "\n".join(edit(dice, dice.choice(base), "xé") for _ in range(dice.randint(0, 5)))) for d in range(50)] + [(500, None)]
    got = {r.doc_id: r for r in lines.line_report(spark.createDataFrame(rows, DOCS), edits, 20).collect()}
    want = removed(rows, edits, 20)
    for doc, text in rows:
        own = sorted(want.get(doc, []))
        assert got[doc].removed == ",".join(str(k) for k, _ in own) and got[doc].n_exact == sum(e for _, e in own)
        assert got[doc].n_lines == (0 if text is None else len(text.split("\n")))


def test_line_edges(spark):
    df = spark.createDataFrame([(1, "a" * 30 + "\nshort\n" + "a" * 31, 1), (None, "a" * 30, 2), (2, None, 3), (3, "", 4), (3, "", 4)], "doc_id long, text string, line int")
    got = lines.without_repeats(df)
    assert got.columns == df.columns
    assert sorted((r.line, r.text) for r in got.collect() if r.line != 3) == [(1, "a" * 30 + "\nshort"), (2, "a" * 30), (4, ""), (4, "")]
    assert lines.without_repeats(df.limit(0)).count() == 0


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize("n,share,heavy,block", [(4, (85, 100), 64, 512), (2, (60, 100), 3, 5)])
def test_jaccard(spark, monkeypatch, n, share, heavy, block):
    monkeypatch.setattr(jaccard, "HEAVY", heavy)
    dice = random.Random(n)
    words = [f"w{k}" for k in range(60)]
    base = [dice.choices(words, k=dice.choice([1, 2, 3, 20, 40, 120])) for _ in range(25)]
    rows = []
    for d in range(260):
        own = list(dice.choice(base))
        for _ in range(dice.choice([0, 0, 1, 1, 2, 4])):
            own[dice.randrange(len(own))] = dice.choice(words).upper()
        rows.append((d, " ".join(own)))
    sets, exact = {d: shingles(t, n) for d, t in rows}, Forest()
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if share[1] * both >= share[0] * (len(sets[a]) + len(sets[b]) - both):
                exact.join(a, b)
    got = {r.doc_id: r for r in jaccard.jaccard_groups(spark.createDataFrame(rows, DOCS), n, share, block).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(sets[d]), exact.find(d)) for d in sets}


@pytest.mark.parametrize("few", [200_000, 0])
def test_boilerplate_of_rare_words_makes_no_candidate_group_of_the_documents_that_have_it(spark, monkeypatch, few):
    dice, members = random.Random(5), []
    monkeypatch.setattr(jaccard, "FEW_IDS", few)
    monkeypatch.setattr(jaccard, "written", lambda df, tag: members.append(out := written(df, tag)) or out if tag == "members" else written(df, tag))
    line = " ".join(f"terms{k}" for k in range(60))
    rows = [(k, " ".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100)) + " " + line) for k in range(300)]
    copies = [(300 + k, rows[k][1].replace(line, line + " end")) for k in range(0, 300, 30)]
    got = jaccard.jaccard_groups(spark.createDataFrame(rows + copies, DOCS), 4, (85, 100)).collect()
    assert {r.doc_id: r.component_id for r in got} == {k: k - 300 if k >= 300 else k for k, _ in rows + copies}
    assert members[0].count() < 60


def test_the_pipeline_stage_compares_no_documents_for_their_boilerplate(spark, monkeypatch):
    dice, members = random.Random(7), []
    monkeypatch.setattr(jaccard, "written", lambda df, tag: members.append(out := written(df, tag)) or out if tag == "members" else written(df, tag))
    line = " ".join(f"terms{k}" for k in range(50))
    rows = [(k, " ".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100)) + " " + line) for k in range(200)]
    copies = [(200 + k, rows[k][1].replace(line, line + " end")) for k in range(0, 200, 20)]
    kept = jaccard.one_of_each(spark.createDataFrame(rows + copies, DOCS), 5, (80, 100)).collect()
    assert sorted(r.doc_id for r in kept) == list(range(200)) and members[0].count() < 60


def test_jaccard_edges(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (2, None), (3, ""), (4, "a b"), (5, "A b"), (6, "a b c d e"), (6, "a b c d e"), (7, " \n ")]
    df = spark.createDataFrame(rows, DOCS).withColumn("component", F.lit("x"))
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.jaccard_groups(df, 4, (85, 100)).collect())
    assert got == [(0, 2, 0), (1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 2, 1), (6, 2, 1), (7, 0, 7)]
    assert sorted(r.doc_id or 0 for r in jaccard.one_of_each(df, 4, (85, 100)).collect()) == [0, 1, 2, 3, 4, 7]
    assert jaccard.jaccard_groups(df.limit(0)).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    """A row keeps what only it has, though another row of its id repeats lines there."""
    once, same = "this sentence occurs once and nowhere else", "a line that many documents have in common"
    df = spark.createDataFrame([(1, f"{once}\nother"), (1, f"{same}\n{same}"), (2, f"{same}\n}}"), (3, "}\n\n \n}")], DOCS)
    got = sorted((r.doc_id, r.n_lines, r.n_exact, r.removed) for r in lines.line_report(df).collect())
    assert got == [(1, 2, 0, ""), (1, 2, 1, "1"), (2, 2, 1, "0"), (3, 4, 2, "0,3")]
    assert sorted((r.doc_id, r.text) for r in lines.without_repeats(df).collect()) == [(1, same), (1, f"{once}\nother"), (2, "}"), (3, "\n ")]
    assert sorted(r.doc_id for r in lines.without_repeats(df, emptied=False).collect()) == [1, 1, 2]


def test_long_lines_are_hashed_piece_by_piece(monkeypatch):
    dice = random.Random(4)
    text = "".join(dice.choices("abcdé \n", k=4000)) + "".join(dice.choices("abcdé ", k=3000))
    line, spots, sizes = text.split("\n")[-1], np.array([0, 5, 100, 64, 128, 700]), np.array([10, 0, 2000, 64, 1, 650])

    def seen():
        rows = [(int(p), int(n), int(i), t) for ps, ns, ids, ts in lines.lines_of([text, None, "x\n\ny"]) for p, n, i, t in zip(ps, ns, ids, ts, strict=True)]
        return rows, lines.Sums(line).hashes(spots, sizes).tolist(), lines.sketches(line, np.array([0]), np.array([len(line)])).tolist()

    whole = seen()
    monkeypatch.setattr(lines, "BATCH", 64)
    assert seen() == whole
    assert [(p, n, t) for p, n, _, t in whole[0]] == [(k, n, t) for k, x in enumerate([text, "", "x\n\ny"]) for n, t in enumerate(x.split("\n")) if t.strip()]


def test_jaccard_rows_that_share_an_id(spark):
    """(5, A) belongs to A's group and (5, B) to B's: neither group loses its last copy, and equal rows count once."""
    a, b = "a b c d e f g h", "p q r s t u v w x y z"
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (5, b, 4), (7, b, 5), (8, "only here and nowhere else", 6), (8, a, 7), (9, None, 8), (9, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, own int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(df, 4, (85, 100)).collect())
    assert got == [(3, 5, 3), (5, 5, 3), (5, 8, 5), (5, 8, 5), (7, 8, 5), (8, 2, 8), (8, 5, 3), (9, 0, 9), (9, 0, 9)]
    kept = sorted((r.doc_id, r.text or "", r.own) for r in jaccard.one_of_each(df, 4, (85, 100)).collect())
    assert kept[0] == (3, a, 1) and kept[1][:2] == (5, b) and kept[1][2] in (3, 4) and kept[2:] == [(8, "only here and nowhere else", 6), (9, "", 8), (9, "", 9)]


def test_words_of_long_texts_are_hashed_piece_by_piece(monkeypatch):
    monkeypatch.setattr(hashing, "BATCH", 64)
    dice, base, whole = random.Random(1), int(hashing.BASE), 1 << 64
    for _ in range(200):
        texts = ["".join(dice.choice("aB é \n") * dice.choice([1, 1, 1, 70]) for _ in range(dice.choice([0, 3, 30, 300]))) or None for _ in range(5)]
        for k, hashes in hashing.word_hashes(texts):
            words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (texts[k] or "").encode())]
            sums = [(sum(c * pow(base, i, whole) for i, c in enumerate(w)) + len(w)) % whole for w in words]
            assert hashes.tolist() == hashing.mix(np.array(sums, dtype=np.uint64)).tolist()


def test_names_that_clash(spark):
    """Columns called like the operators' own ones come back as they were; a very long text loses its repeated half."""
    half = "\n".join(f"line number {k} of a very long document" for k in range(30000))
    rows = [(1, half + "\n" + half, *"abcde"), (2, "AKIA" + "A" * 16, *"fghij"), (3, None, *"klmno")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __doc string, __gone string, __Lines string, __blob string, __spans string")
    for f, first in ((lambda d: lines.without_repeats(d, edits=0), half), (jaccard.one_of_each, rows[0][1]), (secrets.redacted, rows[0][1])):
        got = sorted(map(tuple, f(df).collect()))
        assert [(r[0], *r[2:]) for r in got] == [(r[0], *r[2:]) for r in rows] and got[0][1] == first


HOT = 3000


def test_one_line_one_ngram_one_vector_in_a_third_of_all_rows(spark):
    """Whole results where a third of the rows share a line, a passage or a vector."""
    hot = "this very line stands in a third of all of the documents"
    rows = [(k, f"{hot}\nown line of document {k * 7919} alone" if k % 3 == 0 else f"other text {k * 104729} of number {k}") for k in range(HOT)]
    df = spark.createDataFrame(rows, DOCS)
    gone = {r.doc_id: r.removed for r in lines.line_report(df, edits=0).collect()}
    assert {d for d, x in gone.items() if x} == set(range(3, HOT, 3)) and set(gone.values()) == {"", "0"}
    words = [f"w{k}" for k in range(4000)]
    dice = random.Random(8)
    shared = " ".join(words[:30])
    rows = [(k, shared + " " + " ".join(dice.choices(words, k=3 if k % 6 else 30)) if k % 3 == 0 else " ".join(dice.choices(words, k=20))) for k in range(1200)]
    sets, exact = {d: shingles(t, 4) for d, t in rows}, Forest()
    for a in range(0, 1200, 3):
        for b in range(0, a, 3):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                exact.join(a, b)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(spark.createDataFrame(rows, DOCS), 4, (85, 100)).collect()}
    assert got == {d: exact.find(d) for d in sets} and len(set(got.values())) < 1200
    noise = np.random.default_rng(5).standard_normal((HOT, 16))
    rows = [(k, [1.0] * 16 if k % 3 == 0 else noise[k].tolist()) for k in range(HOT)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in collisions.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[k] == (HOT // 3 - 1, 0) for k in range(0, HOT, 3))


def test_stages_of_empty_tables_and_clashing_names(spark, sf):
    docs = table(spark, sf, "documents").withColumns({c: F.lit("kept") for c in ("__toxicity", "__Doc", "__own", "__gone", "__lines", "__blob", "__spans", "__times")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name != "packing":
            assert stage(spark, docs, sf).where("__Doc = 'kept'").columns == docs.columns


def test_the_toxicity_stage_goes_by_the_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs, name = table(spark, sf, "documents"), corpus_pipeline.STAGES[0]
    kept = {r.doc_id for r in name[1](spark, docs, sf).collect()}
    scores = {r.doc_id: r.score for r in queries.op8_toxicity(spark, sf).collect()}
    assert kept == {d for d, s in scores.items() if s < 0.5} and 0 < len(kept) < len(scores)
    marks = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    clean = [d for d, toxic in marks.items() if toxic == 0 and d in scores]
    assert sum(d in kept for d in clean) / len(clean) > 0.97


def test_the_pipeline_stage_by_stage(spark, sf):
    docs = table(spark, sf, "documents")
    columns, seen = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), "stage")
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.dtypes == columns
    before, after = seen["line dedup"]
    old = {r.doc_id: r.text for r in before.collect()}
    gone = removed(sorted(old.items()), lines.EDITS, lines.MIN_CHARS)
    new = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in {k for k, _ in gone.get(d, [])}) for d, t in old.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {d: (t, len(t)) for d, t in new.items() if t.strip() or t == old[d]}
    before, after = seen["n-gram Jaccard join"]
    sets, exact = {r.doc_id: shingles(r.text, 5) for r in before.collect()}, Forest()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a != b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                exact.join(a, b)
    assert {r.doc_id for r in after.collect()} == {d for d in sets if exact.find(d) == d}
    before, after = seen["secret scans"]
    assert after.count() == before.count()
    assert not any(secrets.found(r.text, secrets.RULES[1:3]) for r in after.collect())
    before, after = seen["packing"]
    tokens = {r.doc_id: len(packing.token_ids(r.text, queries.public_tokenizers.path("byte_bpe_50k.json"))) + 1 for r in before.collect()}
    assert {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == tokens
