"""Chat formatting, source divergence and hard negatives against plain versions of their rules."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayline.llm import chat, divergence, negatives

CONVERSATIONS = "conv_id long, turn long, role string, text string, formatted string, turns long"
DOCUMENTS = "doc_id long, text string, lang string, source string, term string, n long"
VECTORS = "vec_id long, embedding array<double>, label long, key string, cell long"


# chat


def turns_of(rows):
    """The turns (role, text) of each conversation, in order."""
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(own)] for c, own in by.items()}


def chat_text(turns, template, learn=("assistant",)):
    """The whole text and the learnt spans, told plainly."""

    def escaped(text):
        text = text.replace(template.escape, template.escape * 2)
        out = ""
        for k, c in enumerate(text):
            out += c + (template.escape if any(text.startswith(x, k) for x in template.controls) else "")
        return out

    out, spans = "", []
    for k, (role, text) in enumerate(turns):
        goes_on = k and turns[k - 1][0] == role
        out += template.joint if goes_on else template.begin + escaped(role) + template.middle
        start = len(out)
        out += escaped(text)
        if role in learn:
            spans.append((start, len(out)))
        if k + 1 == len(turns) or turns[k + 1][0] != role:
            out += template.end
    return out, spans


def odd_conversations(seed=1, n=12):
    dice = random.Random(seed)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "[", "<", "INST]", "\\", "\\\\", "ok", " é🙂", "\n", "$1", "[\\INST]", "/s>"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(dice.randrange(1, 14)):
            text = dice.choice([None, "", "".join(dice.choices(bits, k=dice.randrange(1, 9)))])
            rows.append((conv, dice.choice([turn, turn, turn, None]), dice.choice(["user", "assistant", "assistant", None, "a[/INST]b\\"]), text, "x", 7))
    return rows + rows[:3]  # some rows twice


TEMPLATES = [chat.Template(), chat.Template("<a>", "|b", "#c", "~d", "^")]


@pytest.mark.parametrize("segment", [1, 3, 512])
@pytest.mark.parametrize("template", TEMPLATES)
def test_conversations_are_formatted_and_read_back(spark, template, segment):
    rows = odd_conversations()
    want = turns_of(rows)
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(3)
    parts = defaultdict(dict)
    for r in chat.formatted(df, template, segment=segment).collect():
        parts[r.conv_id][r.segment] = (r.formatted, [(s.start, s.end) for s in r.loss])
    assert set(parts) == set(want) and (segment == 512) == all(len(p) == 1 for p in parts.values())
    for conv, turns in want.items():
        text, spans = chat_text(turns, template)
        whole, found = "", []
        for _, (own, loss) in sorted(parts[conv].items()):
            found += [(len(whole) + a, len(whole) + b) for a, b in loss]
            whole += own
        assert (whole, found) == (text, spans)
    got = {r.conv_id: r for r in chat.read_back(chat.whole(df, template, segment=segment), template).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        assert [(t.role, t.text) for t in got[conv].turns] == turns
        assert got[conv].learnt == "".join(t for r, t in turns if r == "assistant")
        assert got[conv].formatted == chat_text(turns, template)[0]


def test_control_strings_occur_only_where_the_template_puts_them(spark):
    template = chat.Template()
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]", "x", 1), (1, 1, "assistant", "</s>[INST] ok [/INST]", "x", 1)]
    own = chat.whole(spark.createDataFrame(rows, CONVERSATIONS)).first()
    assert [own.formatted.count(c) for c in template.controls] == [2, 2, 2, 0]
    assert own.learnt == ["<\\/s>[\\INST] ok [\\/INST]"]


def test_long_texts_and_no_conversations(spark):
    text = "[INST]\\" * 200_000
    own = chat.read_back(chat.whole(spark.createDataFrame([(1, 1, "assistant", text, "x", 1)], CONVERSATIONS))).first()
    assert own.learnt == own.turns[0].text == text
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert chat.formatted(empty).count() == chat.read_back(chat.whole(empty)).count() == 0


@pytest.mark.parametrize("marks", [("[INST]", "[INST]", "</s>", "<s>", "\\"), ("[[", "b", "c", "d", "\\"), ("[a", "<b", "#c\\", "~d", "\\"), ("[a", "<b", "#c", "~d", "")])
def test_templates_that_cannot_be_read_back_are_refused(marks):
    with pytest.raises(ValueError):
        chat.Template(*marks)


# divergence


def audited(rows, least, top):
    """The audit by sets and whole numbers of any size."""
    docs = [(lang or "", source or "", [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())]) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= least}
        counts = {s: Counter(w for d in own if d[1] == s for w in d[2] if w in kept) for s in {d[1] for d in own}}
        share = lambda c, w: 1 + 10**9 * (c[w] + 2) // (c.total() + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        every = sum(counts.values(), Counter())
        for s, c in counts.items():
            pairs = [(t, sum(f(share(c, w), share(d, w)) for w in kept)) for t, d in counts.items() if t != s]
            terms = [(w.decode(), f(share(c, w), share(every, w))) for w in c if share(c, w) > share(every, w)]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return Counter(out)


def odd_documents(seed=3, n=90):
    dice = random.Random(seed)
    words = ["the", "The", "THE", "été", "ÉTÉ", "日本", "x", "a_b", "42", "don't", "@", "`", "[", "{z}", "\x7f", "\x00y", "naïve"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for k in range(n):
        text = dice.choice([None, "", "12 34", *[dice.choice([" ", "-", "\n"]).join(dice.choices(words, k=dice.randrange(1, 30))) for _ in range(9)]])
        rows.append((k % 7, text, dice.choice(["en", "fr", None, ""]), dice.choice(["s1", "s2", "s3", "s4", "s5", None]), "t", 1))
    # a language without kept terms, a group without any terms, a term over the end of a text
    return [*rows, (1, "once", "de", "s1", "t", 1), (2, None, "de", "s2", "t", 1), (3, "...", "en", "s9", "t", 1), (4, "the", "en", "s1", "t", 1), (5, "the", "en", "s1", "t", 1)]


@pytest.mark.parametrize(("block", "tile", "hashed"), [(20_000, 256, None), (7, 2, None), (20_000, 256, lambda b: len(b) % 3)])
def test_divergences_are_those_of_plain_counting(spark, block, tile, hashed):
    rows = odd_documents()
    more = {} if hashed is None else {"hashed": hashed}  # unequal terms with equal hashes
    got = divergence.source_divergence(spark.createDataFrame(rows, DOCUMENTS).repartition(3), 4, 5, block, tile, **more).collect()
    assert Counter(tuple(r) for r in got) == audited(rows, 4, 5)


def test_slices_of_one_hash_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"ab cd ab abc cd zz ab", dtype=np.uint8)
    starts, ends = divergence.boundaries(data, np.array([0]))
    of, terms = divergence.grouped(data, starts, ends, lambda b: 1)
    assert [terms[k] for k in of] == [b"ab", b"cd", b"ab", b"abc", b"cd", b"zz", b"ab"] and len(set(terms)) == 4


def test_terms_of_a_long_text_are_counted_once_a_document(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICES", 50)  # one text in many windows
    import pyarrow as pa

    texts = pa.array(["aa bb " * 500, "bb", None, "é" * 300_000])
    doc, term, times, terms = divergence._tallied(texts, xxhash.xxh3_64_intdigest)
    got = Counter({(d, terms[t].decode()[:2]): n for d, t, n in zip(doc.tolist(), term.tolist(), times.tolist(), strict=True)})
    assert got == {(0, "aa"): 500, (0, "bb"): 500, (1, "bb"): 1, (3, "éé"): 1}


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10**15, 9 * 10**14 + 7], dtype=np.int64)
    whole = 9 * 10**15 - 1
    assert divergence.share(counts, whole).tolist() == [1 + 10**9 * (int(c) + 2) // whole for c in counts]


def test_no_documents_have_no_divergences(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCUMENTS)).count() == 0


# hard negatives


def mined(rows, every=5, positives=5, least=3):
    """The first negatives of each positive, by comparing all rows."""
    kept = set()
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in own) < 2**63:
            kept.add((vec_id, label, own))
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in kept if b != a and len(b[2]) == len(a[2]))
        near = [s for s in scored if s[2] == a[1]][:positives]
        for p, pid, _ in near:
            fit = [s for s in scored if s[2] != a[1] and 50 * -p <= 100 * -s[0] <= 95 * -p][:least]
            out += [(a[0], pid, k + 1, s[1], -p, -s[0]) for k, s in enumerate(fit)]
    return Counter(out)


def odd_vectors(seed=5, n=260):
    dice = random.Random(seed)
    rows = []
    for k in range(n):
        centre = dice.choice([(1.0, 0.2, 0.1), (0.8, 0.6, 0.0), (-0.5, 0.5, 0.7)])
        rows.append((k, [round(c + dice.gauss(0, 0.15), 2) for c in centre], dice.choice([0, 0, 1, 1, 2, 7]), "k", 1))
    rows += [(1000 + k, [1.0, 0.2, 0.1], k % 2, "k", 1) for k in range(60)]  # many equal vectors
    rows += [(k, None, 1, "k", 1) for k in (2000, 2005)] + [(2010, [1.0, None, 2.0], 1, "k", 1), (2015, [1.0, float("nan"), 2.0], 1, "k", 1), (2020, [1.0, 0.5, 0.2], None, "k", 1), (None, [1.0, 0.5, 0.2], 1, "k", 1)]
    rows += [(3000 + 5 * k, [0.5, float(k)], k % 2, "k", 1) for k in range(6)] + [(3100, [], 0, "k", 1), (3105, [], 0, "k", 1)]  # other lengths
    rows += [(4000, [1e7, 1e6, 0.0], 0, "k", 1), (4001, [1e7, 1.0, 3.0], 0, "k", 1), (4002, [6e6, 1.0, 0.0], 1, "k", 1), (4005, [1e30, 0.0, 0.0], 1, "k", 1)]  # beyond doubles, and beyond longs
    return [*rows, rows[0], rows[10], (10, [0.9, 0.1, 0.1], 1, "k", 1)]  # rows twice, an id twice


@pytest.mark.parametrize("more", [{}, {"sample": 12, "cell": 9, "group": 4, "part": 5}])
def test_hard_negatives_are_those_of_comparing_all(spark, more):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = negatives.hard_negatives(negatives.integers(df), F.col("id") % 5 == 0, **more).collect()
    want = mined(rows)
    assert Counter(tuple(r) for r in got) == want and want


def test_node_pairs_are_dropped_and_nothing_is_lost():
    """Far groups are not scored at all, and the first candidates are those of a full product."""
    dice = np.random.Generator(np.random.PCG64(1))
    centres = dice.integers(-1000, 1000, (7, 8))
    x = (centres[np.arange(4000) % 7] + dice.integers(-20, 20, (4000, 8))).astype(np.int64)
    anchors, labels = x[:200], np.arange(200) % 3
    own, ids = np.arange(4000) % 3, np.arange(4000)
    seen = []
    was, negatives.products = negatives.products, lambda a, b: (seen.append(len(a) * len(b)), a @ b.T)[1]
    try:
        low, high = np.full((200, 1), negatives.LOWEST), np.full((200, 1), negatives.HIGHEST)
        got = {r: (s.tolist(), ids[c].tolist()) for r, _, c, s in negatives.searched(anchors, labels, np.arange(200), x, own, ids, ids, negatives.Wanted(True, 5, low, high))}
    finally:
        negatives.products = was
    score = anchors @ x.T
    for r in range(200):
        best = sorted((-score[r, c], c) for c in range(4000) if own[c] == labels[r] and c != r)[:5]
        assert got[r] == ([-s for s, _ in best], [c for _, c in best])
    assert sum(seen) < 0.2 * 200 * 4000  # labels alone leave a third


def test_shares_of_scores_round_as_the_rule_says(spark):
    scores = [0, 1, -1, 99, -99, 100, 101, 12345, -12345, 2**62 + 7, -(2**62) - 7]
    df = spark.createDataFrame([(s,) for s in scores], "s long").select("s", negatives._share(F.col("s"), 50, 100, up=True).alias("lo"), negatives._share(F.col("s"), 95, 100, up=False).alias("hi"))
    for r in df.collect():
        assert (r.lo, r.hi) == (-(-50 * r.s // 100), 95 * r.s // 100)


def test_no_vectors_and_no_anchors(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(negatives.integers(empty), F.col("id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(1, [1.0], 0, "k", 1), (2, [1.0], 0, "k", 1)], VECTORS)
    assert negatives.hard_negatives(negatives.integers(one), F.col("id") % 5 == 0).count() == 0
