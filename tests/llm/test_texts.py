"""Packing, WARC, language, fingerprints, BPE, secrets, toxicity."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayline.llm import bpe, fingerprint, language, packing, queries, secrets, toxicity, warc
from wayline.session import scratch, table, written

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "hello <|endoftext|> x", "a\u0085b   c\n\n  d", "naïve ĉ 漢字 😀 é", "İSTANBUL Σς ΑΣ", "I'll they're 12345 !!!???", "x" * 7000, "<|startoftext|>Don'T", "ǅ ß ẞ K", "a\x00b\x1fc", "a,b ,. c.d"]


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        p, d[0] = d[0], i + 1
        for j, y in enumerate(b):
            p, d[j + 1] = d[j + 1], min(d[j + 1] + 1, d[j] + 1, p + (x != y))
    return d[-1]


def test_packing(spark, sf):
    known, whole = texts(spark, sf), Tokenizer.from_file(BYTES)
    rows = packing.pack(table(spark, sf, "documents"), BYTES).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4"), r.doc_tokens))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    for doc, pieces in docs.items():
        ids = np.concatenate([p[1] for p in sorted(pieces, key=lambda p: p[0])])
        assert ids.tolist() == [*whole.encode(known[doc], add_special_tokens=False).ids, 1] and pieces[0][2] == len(ids)
    assert set(docs) == set(known)
    padding = sum(2048 - sum(n for _, n in p) for p in sequences.values())
    assert padding < 2048 * table(spark, sf, "documents").rdd.getNumPartitions()


def test_the_packing_query(spark, sf):
    """Every id of every document once, by the library, and the checksum of each piece's ids."""
    import zlib

    known, whole, filled = texts(spark, sf), Tokenizer.from_file(BYTES), defaultdict(int)
    for r in queries.op1_packing(spark, sf).collect():
        ids = [*whole.encode(known[r.doc_id], add_special_tokens=False).ids, 1]
        own = np.array(ids[r.start : r.start + r.length], dtype="<u4")
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(own.tobytes())
        filled[r.doc_id] += r.length
        assert r.offset + r.length <= 2048
    assert filled == {d: len(whole.encode(t, add_special_tokens=False).ids) + 1 for d, t in known.items()}


def test_the_tokenizers_library_agrees():
    whole = Tokenizer.from_file(BYTES)
    for text in ODD:
        assert packing.token_ids(text, BYTES).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_levels_take_the_least_sum_of_squares():
    dice = random.Random(1)
    levels = packing.LevelArray(16)
    for _ in range(300):
        size = dice.randint(1, 16)
        counts = levels.counts.copy()

        def cost(level, counts=counts, size=size):
            after = counts.copy()
            if level:
                after[level] -= 1
            if level + size < 16:
                after[level + size] += 1
            return int((after[1:16] ** 2).sum())

        options = [0] + [h for h in range(1, 17 - size) if counts[h]]
        level = levels.choose(size)
        assert level in options and cost(level) == min(map(cost, options))
        pieces = levels.take(level)
        if level + size < 16:
            levels.put(level + size, pieces)


def test_open_windows_are_bounded_and_packed_to_the_end():
    docs = [(k, np.arange(1100, dtype="u4")) for k in range(2000)]
    done = list(packing.windows(docs, 2048, 8))
    assert sum(len(p[2]) for w in done for p in w) == 2000 * 1100
    assert len(done) == -(-2000 * 1100 // 2048)


def test_what_is_open_at_the_end_is_placed_by_the_rule():
    """Every id is in one piece, one window at most is not full, and few documents are cut that a window could hold."""
    sizes = np.maximum(1, np.random.default_rng(0).lognormal(5.5, 1.3, 3000)).astype(int)
    docs = [(k, np.arange(n, dtype="u4")) for k, n in enumerate(sizes)]
    done, found = list(packing.windows(docs, 2048)), defaultdict(list)
    fills = [sum(len(ids) for _, _, ids, _ in w) for w in done]
    assert max(fills) == 2048 and sum(f < 2048 for f in fills) <= 1
    for w in done:
        for doc, start, ids, n in w:
            assert n == sizes[doc] and ids.tolist() == list(range(start, start + len(ids))) and len(ids)
            found[doc].append((start, len(ids)))
    for doc, pieces in found.items():
        ends = [0, *(start + n for start, n in sorted(pieces))]
        assert [start for start, _ in sorted(pieces)] == ends[:-1] and ends[-1] == sizes[doc]
    assert sum(len(pieces) > -(-sizes[doc] // 2048) for doc, pieces in found.items()) < 10
    assert len(list(packing.windows(docs[:1], 2048))) == 1 and not list(packing.windows([], 2048))


def test_packing_edges(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, "")], "doc_id long, text string").withColumn("ids", F.lit(1))
    rows = packing.with_crc(packing.pack(df, BYTES)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in rows) == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (True, 0, 2)]
    assert packing.pack(df.limit(0), BYTES).count() == 0


def test_warc_round_trip(spark, sf):
    got = {r.page_id: r for r in queries.op2_warc(spark, sf).collect()}
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, sf, "pages").collect()}
    largest = {}
    for k, p in sorted(pages.items()):
        largest[p] = k
    assert set(got) == set(pages)
    for k, p in pages.items():
        r, own = got[k], largest[p] == k
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if own else "revisit", None if own else largest[p])
        assert r.error is None


def test_warc_segments_and_edges(spark):
    long = "é" * 40_000 + "\r\n\r\nWARC/1.1\r\n"
    df = spark.createDataFrame([(1, "u\r\nv", long), (2, None, None), (3, "u", ""), (4, "u", ""), (None, "x", "zz"), (4, "u", "")], "page_id long, url string, html string")
    path = scratch(spark, "w")
    warc.write_archives(df, path, segment_bytes=1000, chunk_bytes=77)
    rows = warc.read_pages(spark, path).collect()
    assert all(r.error is None for r in rows)
    assert sorted((r.page_id or 0, r.record_type, r.payload_bytes, r.refers_to) for r in rows) == [(0, "response", 2, None), (1, "response", len(long.encode()), None), (2, "revisit", 0, 4), (3, "revisit", 0, 4), (4, "response", 0, None), (4, "response", 0, None)]
    records = warc.read_records(spark, path)
    assert records.where("warc_type = 'continuation'").count() > 50
    lost = records.where("NOT coalesce(segment_number = 3, false)")
    assert [r.error for r in warc.reassembled(lost).where("page_id = 1").collect()] == ["a segment is missing or repeated"]


def test_warc_of_damaged_archives(spark, tmp_path):
    import gzip

    good = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<a>"), ("X-Page-Id", 1)], warc.framed(b"hello", 2)) + b"\r\n\r\n"
    lost = b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 2\r\nContent-Length: many\r\n\r\nwhatever\r\n\r\n"
    endless = warc.record([("WARC-Type", "response"), ("X-Page-Id", 3)], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1\r\nA\r\n-6\r\n") + b"\r\n\r\n"
    odd = warc.record([("WARC-Type", "continuation"), ("WARC-Segment-Number", "two"), ("X-Page-Id", "x")], b"") + b"\r\n\r\n"
    for name, data in {"a.warc": good + lost + good + endless + odd, "b.warc.gz": gzip.compress(good)[:-9], "c.warc": b"", "d.warc": good[:-20]}.items():
        (tmp_path / name).write_bytes(data)
    got = sorted(((r.page_id or 0, r.payload_bytes if r.error is None else 0, r.error or "") for r in warc.read_pages(spark, str(tmp_path)).collect()))
    damaged = [g for g in got if "damaged" in g[2]]
    rest = [g for g in got if g not in damaged]
    assert len(damaged) == 1 and rest == [(0, 0, "the segment's number is not one"), (1, 0, "the archive ends inside a block"), (1, 5, ""), (1, 5, ""), (2, 0, "the block's length is not a number"), (3, 0, "a chunk's size is not hexadecimal")]
    empty = scratch(spark, "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_pages(spark, empty).count() == 0


def test_unframing():
    for size in (1, 7, 100):
        assert warc.unframed(warc.framed(b"abc\r\n0\r\n\r\n" * 9, size)) == b"abc\r\n0\r\n\r\n" * 9
    with pytest.raises(ValueError):
        warc.unframed(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab")


def test_language(spark):
    got = queries.op3_language(spark, "/root/testdata/sf0.01").collect()
    known = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(known) and 0.25 < len(held) / len(got) < 0.42
    assert sum(r.lang_pred == known[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    df = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, None, "en"), (3, "12 !", "de"), (4, "der Hund und die Katze", "de"), (5, "das", None)], "doc_id long, text string, lang string")
    model = language.train(df.select("text", "lang"))
    got = {r.doc_id: r for r in language.predict(df.select("doc_id", "text"), model).collect()}
    assert got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred in ("en", "de")
    clash = language.predict(df.withColumns({"Score": F.lit("s"), "lang_pred": F.lit(1)}), model)
    assert clash.columns == ["doc_id", "lang", "lang_pred", "score"] and clash.count() == 5
    none = language.train(df.limit(0).select("text", "lang"))
    assert {r.lang_pred for r in language.predict(df.select("doc_id", "text"), none).collect()} == {"und"}


def test_repeated_texts_neither_fill_nor_empty_a_sample(spark, monkeypatch):
    """One text in 100,000 rows reaches the driver once for each label, and other texts are still there."""
    hot = spark.range(100_000).select(F.lit("the same old words in every row").alias("text"), F.lit("en").alias("lang"), (F.col("id") % 2).cast("int").alias("label"))
    others = [(f"der Hund und die Katze {chr(97 + k % 26)}{k}", "de", k % 2) for k in range(300)] + [(f"les chats et le chien {k}", "fr", 1) for k in range(40)]
    rows = hot.unionByName(spark.createDataFrame(others, "text string, lang string, label int"))
    got = language.sample_vectors(rows.select("text", "lang"), "lang", 100)
    count = {lang: sum(g[0] == lang for g in got) for lang in ("en", "de", "fr")}
    assert count["en"] == 1 and count["fr"] == 40 and 50 < count["de"] < 150
    assert language.train(rows.select("text", "lang")).labels == ["de", "en", "fr"]
    kept = []
    monkeypatch.setattr(toxicity, "written", lambda df, tag: kept.append(written(df, tag)) or kept[-1])
    model = toxicity.train(rows.select("text", "label"), sample=100)
    assert kept[0].where("text LIKE 'the same%'").count() <= 2 and 50 < kept[0].count() < 160 and 0.4 < model.share < 0.6
    labels = spark.createDataFrame([(7, 1)] * 5000 + [(k, k % 2) for k in range(100)], "doc_id long, toxic int")
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert queries.labelled(docs, labels).groupBy("text").count().where("count > 1").count() == 0


def plain_fingerprint(text):
    """Byte by byte, with the hash rolled forward instead of computed for all places at once."""
    import zlib

    data, letters = text.encode(), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    block = 3
    while block * 64 < len(data):
        block *= 2

    def signed(size, most):
        out, chunk, window, total, weighted, mixed, ends = "", b"", [0] * 7, 0, 0, 0, 0
        for k, c in enumerate(data):
            weighted = weighted - total + 7 * c
            total += c - window[k % 7]
            window[k % 7] = c
            mixed = (mixed << 5 ^ c) & 0xFFFFFFFF
            chunk += bytes([c])
            if ((total + weighted + mixed) & 0xFFFFFFFF) % size == size - 1:
                ends += 1
                if len(out) < most - 1:
                    out, chunk = out + letters[zlib.crc32(chunk) & 63], b""
        return (out + letters[zlib.crc32(chunk) & 63] if chunk else out), ends

    while block > 3 and signed(block, 64)[1] < 32:
        block //= 2
    return f"{block}:{signed(block, 64)[0]}:{signed(2 * block, 32)[0]}"


def test_fingerprints_byte_by_byte():
    dice = random.Random(2)
    cases = ["", "a", "é" * 50, "x" * 5000, "漢字かな" * 40]
    cases += ["".join(dice.choices("abc de\n", k=dice.choice([10, 200, 3000]))) for _ in range(25)]
    cases += [" ".join(dice.choice(["word", "other", "thing", str(dice.random())]) for _ in range(dice.choice([20, 400]))) for _ in range(10)]
    for text in cases:
        assert fingerprint.fingerprint(text) == plain_fingerprint(text)
    for _ in range(300):
        one, other = dice.choice(cases), dice.choice(cases)
        a, b = plain_fingerprint(one).split(":"), plain_fingerprint(other).split(":")
        pairs = [(x, y) for m, x in ((1, a[1]), (2, a[2])) for n, y in ((1, b[1]), (2, b[2])) if m * int(a[0]) == n * int(b[0]) and x and y]
        want = 1.0 if a == b else max((1 - lev(x, y) / max(len(x), len(y)) for x, y in pairs), default=0.0)
        assert fingerprint.likeness(":".join(a), ":".join(b)) == pytest.approx(want)


def test_fingerprints(spark, sf):
    rows = sorted(texts(spark, sf).items())
    got = {r.doc_id: r for r in queries.op4_fingerprint(spark, sf).collect()}
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        changed = text[: len(text) - cut] + following[:cut] if cut else text
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.fingerprint(text), fingerprint.fingerprint(changed))
        assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint(following))
    long = [r for r in got.values() if r.n_chars > 300]
    assert np.median([r.near_edited for r in long]) > 0.6 > 0.3 > np.median([r.near_next for r in long])


def test_fingerprint_edges(spark):
    df = spark.createDataFrame([(None, "a" * 30), (None, "b" * 40), (5, None), (5, "x y z" * 9), (5, "x y z" * 9), (9, "")], "doc_id long, text string").withColumn("part", F.lit(1))
    rows = fingerprint.compared(df).collect()
    assert sorted((r.doc_id or 0, r.next_id or 0) for r in rows) == [(0, 0), (0, 5), (5, 5), (5, 5), (5, 9), (9, 0)]
    assert fingerprint.compared(df.limit(0)).count() == 0
    dice = random.Random(3)
    for _ in range(300):
        a, b = ("".join(dice.choices("abcd", k=dice.randint(0, 20))) for _ in "ab")
        assert fingerprint.distance(a, b) == lev(a, b)


def test_bpe(spark, sf):
    whole = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in queries.op5_bpe(spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for doc, text in texts(spark, sf).items():
        ids = whole.encode(text, add_special_tokens=False).ids
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False)))


def test_bpe_edges(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None), (2, ""), (3, "x y"), (3, "x y")], "doc_id long, text string").withColumn("ids", F.lit("z"))
    got = sorted((r.doc_id or 0, r.ids, r.n_tokens, r.decoded) for r in bpe.encode(df, WORDS).collect())
    whole = Tokenizer.from_file(WORDS)
    want = [(doc or 0, " ".join(map(str, ids := whole.encode(text or "", add_special_tokens=False).ids)), len(ids), whole.decode(ids, skip_special_tokens=False)) for doc, text, _ in df.collect()]
    assert got == sorted(want)
    assert bpe.encode(df.limit(0), WORDS).count() == 0


def test_decoding_token_by_token():
    whole, own = Tokenizer.from_file(WORDS), bpe.WordPieces(WORDS)
    for text in ODD:
        ids, machine = whole.encode(text, add_special_tokens=False).ids, bpe.Decoder(own)
        text_so_far = ""
        for k, i in enumerate(ids):
            text_so_far += machine.feed(i)
            assert text_so_far == whole.decode(ids[: k + 1], skip_special_tokens=False)
            if k > 50:
                break
        assert own.decode(ids) == whole.decode(ids, skip_special_tokens=False)


def test_bpe_on_odd_texts():
    whole, own = Tokenizer.from_file(WORDS), bpe.WordPieces(WORDS)
    dice = random.Random(5)
    many = ODD + ["".join(dice.choices("abcdefghij"[: dice.choice([2, 4, 10])], k=dice.randint(1, 80))) for _ in range(500)]
    many += ["".join(chr(dice.choice([dice.randint(32, 0x2FF), dice.randint(0x300, 0x2FFF)])) for _ in range(30)) for _ in range(200)]
    for text in many:
        assert own.encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_tokens_stream_out_with_bounded_memory():
    own = bpe.WordPieces(WORDS)
    read = 0

    def symbols(word):
        nonlocal read
        for c in [*word[:-1], word[-1] + "</w>"]:
            read += 1
            yield c

    whole = Tokenizer.from_file(WORDS)
    word = "singing" * 2000
    covered, out = 0, []
    for token in own.bpe.stream(symbols(word)):
        assert read - covered <= 2 * own.bpe.lookahead
        covered += own.bpe.symbols(token)
        out.append(own.bpe.ids[token])
    assert out == whole.encode(word, add_special_tokens=False).ids


def test_bytes_become_text_as_they_come():
    own = bpe.WordPieces(WORDS)
    machine = bpe.BytesToText(own.bpe)
    text = "".join(machine.feed(i) for i in own.encode("héllo 漢字 😀 wörld")) + machine.finish()
    assert text.split() == "héllo 漢字 😀 wörld".split()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secrets(spark, sf):
    got = {r.doc_id: r for r in queries.op6_secrets(spark, sf).collect()}
    for doc, text in texts(spark, sf).items():
        want = base_spans(text)
        assert got[doc].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[doc].n_assign, got[doc].n_access, got[doc].n_hex) == tuple(want.count(f"{k}:") for k in ("assign", "access", "hex"))


def test_the_ledger_scans_what_is_new(spark):
    df = spark.createDataFrame([(1, "token = abcdef12"), (2, None), (3, "é token = abcdef12 AKIA" + "A" * 20), (1, "token = abcdef12")], "doc_id long, text string")
    own = secrets.addressed(df, "doc_id", "text")
    old = written(secrets.scan(own.where("path = 1"), None, secrets.RULES[:2]), "old")
    assert old.count() == 1
    fresh = {len(r.rules) for r in secrets.scan(own, old).collect()}
    assert fresh == {len(secrets.RULES), len(secrets.RULES) - 2}
    clean = secrets.redacted(df.withColumn("blob", F.lit(7))).collect()
    assert sorted((r.doc_id, r.text or "", r.blob) for r in clean) == [(1, "[SECRET]", 7), (1, "[SECRET]", 7), (2, "", 7), (3, "é [SECRET] [SECRET]", 7)]
    assert secrets.scan_paths(df.limit(0)).count() == 0


def test_the_ledger_outlives_a_run(spark, tmp_path):
    """A second run scans new blobs and new rule versions only, and tells of all versions of all paths."""
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    first = [(1, "v1", "token = abcdef12"), (2, "v1", "nothing"), (3, "v1", "token = abcdef12")]
    second = [*first, (1, "v2", "token = abcdef12 and AKIA" + "A" * 20), (2, "v2", None), (2, "v2", None)]
    schema = "doc_id long, commit string, text string"
    found = lambda rows, rules: sorted((r.path, r.version, [tuple(s) for s in r.spans]) for r in secrets.scan_paths(spark.createDataFrame(rows, schema), version="commit", ledger=ledger, rules=rules).collect())
    token = [("assign", 0, 16)]
    assert found(first, secrets.RULES[:1]) == [(1, "v1", token), (2, "v1", []), (3, "v1", token)]
    assert ledger.read().count() == 2
    assert found(first, secrets.RULES[:1]) == [(1, "v1", token), (2, "v1", []), (3, "v1", token)]
    assert ledger.read().count() == 2
    assert found(second, secrets.RULES[:2]) == [(1, "v1", token), (1, "v2", [*token, ("access", 21, 45)]), (2, "v1", []), (2, "v2", []), (2, "v2", []), (3, "v1", token)]
    assert sorted((len(r.rules), r.rules[0]) for r in ledger.read().collect()) == [(1, "access@1"), (1, "access@1"), (1, "assign@1"), (1, "assign@1"), (2, "assign@1"), (2, "assign@1")]
    newer = (secrets.Rule("assign", 2, r"(token) = (abc)", ("token",), True, 2, 3), secrets.RULES[1])
    assert found(second, newer)[0] == (1, "v1", [("assign", 0, 11)])
    ledger.add(ledger.read().where("size(spans) > 0").limit(1))
    assert found(first, secrets.RULES[:1]) == [(1, "v1", token), (2, "v1", []), (3, "v1", token)]


def test_toxicity(spark):
    words = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(12) for j in range(12)]
    dice, rows = random.Random(7), []
    for k in range(900):
        text, bad = dice.choices(words, k=dice.randint(10, 60)), int(k % 4 == 0)
        for _ in range(3 * bad):
            text.insert(dice.randrange(len(text)), dice.choice(["nastyword", "1diot", "idiot", "vilething"]))
        rows.append((" ".join(text), bad))
    df = spark.createDataFrame(rows, "text string, label int")
    model = toxicity.train(df.where("length(text) % 5 <> 0"))
    held = df.where("length(text) % 5 = 0")
    got = toxicity.score(held, model).collect()
    assert sum((r.score >= 0.5) == r.label for r in got) / len(got) > 0.97 and all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([(None,), ("",)], "text string")
    assert all(0 <= r.score <= 0.5 for r in toxicity.score(empty, model).collect())
    assert toxicity.score(empty, toxicity.train(df.limit(0))).first().score == 0
    assert toxicity.score(empty, toxicity.train(df.where("label = 1"))).first().score == 1


def test_the_toxicity_query(spark):
    """Held-out accuracy on the given table, and every document once."""
    sf = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    got = queries.op8_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in table(spark, sf, "documents").select("doc_id").collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.score, marks[r.doc_id]) for r in got if r.held_out and marks.get(r.doc_id) in (0, 1)]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])
    assert auc > 0.9 and sum((s >= 0.5) == y for s, y in held) / len(held) > 0.9


def test_toxicity_edges(spark, tmp_path):
    docs = [(k, ("you vile idiot " if k % 3 == 0 else "a calm sentence ") + f"number {k}") for k in range(200)]
    rows = spark.createDataFrame([*docs, (None, "you idiot"), (500, None), (501, ""), (7, "again")], "doc_id long, text string").withColumn("label", F.lit("x"))
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)] * 2 + [(None, 1), (8, 1), (9, None), (10, 5)], "doc_id long, toxic int")
    rows.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    marks.coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op8_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 204 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 200) > 195
    (tmp_path / "e").mkdir()
    rows.limit(0).write.parquet(str(tmp_path / "e/documents.parquet"))
    marks.limit(0).write.parquet(str(tmp_path / "e/labels.parquet"))
    assert queries.op8_toxicity(spark, str(tmp_path / "e")).count() == 0


def spaced_by_hand(text):
    """Runs of four word characters and more, each but the last followed by one separator, from and to word bounds."""
    word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    at = n = 0
    while at < len(text):
        end, k = None, at
        if word(at) and not word(at - 1):
            while word(k):
                if k - at >= 6 and not word(k + 1):
                    end = k
                if k + 1 == len(text) or text[k + 1] not in " .*_-":
                    break
                k += 2
        n, at = (n, at + 1) if end is None else (n + 1, end + 1)
    return n


def test_toxicity_counts_spaced_letters_at_any_length():
    spot = toxicity.FEATURES.index("spaced")
    count = lambda text: toxicity.features(text, toxicity.Lexicon())[spot]
    dice = random.Random(3)
    pieces = ["i d i o t", "f.o.o.l", "a_b_c_d", "x-y", "clean words", "n*a*s*t*y", "é à ü ö", "_ _ _ _", "a b_c d_e", "!", "ab c d e f"]
    for size in (50, 90_000):
        text = " ".join(dice.choice(pieces) + dice.choice(["", ",", " ok"]) for _ in range(size))
        assert count(text) == spaced_by_hand(text) > 0
    assert len(text) > 200_000
    short = "you i.d.i.o.t and f o o l! "
    assert count(short) == count(short + "clean words, " * 20_000) == 2


def test_toxicity_learns_beginnings_of_eight_letters_from_12000_rows():
    assert toxicity.SAMPLE == 12000
    assert toxicity.keys("abcdefghij") == ["=abcdefghij", "^abc", "^abcd", "^abcde", "^abcdef", "^abcdefg", "^abcdefgh"]


def test_isotonic_fit_rises():
    dice = np.random.default_rng(1)
    raw = dice.normal(size=400)
    at, share = toxicity.isotonic(raw, (dice.random(400) < 1 / (1 + np.exp(-raw))).astype(float))
    assert (np.diff(at) > 0).all() and (np.diff(share) >= 0).all()


def test_a_sample_of_labels_is_drawn_from_distinct_texts(spark):
    """Through the query's own function: most labelled rows are copies, and the other texts still reach the learner."""
    texts = [f"text {k}" if k >= 20_000 else f"copy {k % 3}" for k in range(21_000)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, own string").unionByName(spark.createDataFrame([(20_001, "another", "x"), (20_002, None, "x")], "doc_id long, text string, own string"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(21_000)], "doc_id long, toxic int")
    learnt = {k for k in range(21_000) if zlib.crc32(str(k).encode()) % 5}
    every = {(t, k % 2) for k, t in enumerate(texts) if k in learnt} | {(t, k % 2) for k, t in ((20_001, "another"), (20_002, None)) if k in learnt}
    got = [(r.text, r.label) for r in queries.labelled(docs, labels, 10**6).collect()]
    assert set(got) == every and len(got) < len(every) + 20
    some = queries.labelled(docs, labels, 300).collect()
    assert 200 < len({(r.text, r.label) for r in some}) < 400


def test_two_runs_that_begin_with_one_empty_ledger(spark, tmp_path):
    """Both add the same blobs: every document still has one row."""

    class Twice(secrets.Ledger):
        def add(self, fresh):
            super().add(fresh)
            super().add(fresh)

    docs = spark.createDataFrame([(1, "password=abcdef99"), (2, "nothing"), (3, "password=abcdef99")], "doc_id long, text string")
    got = secrets.scan_paths(docs, ledger=Twice(spark, str(tmp_path / "one"))).collect()
    assert sorted((r.path, len(r.spans)) for r in got) == [(1, 1), (2, 0), (3, 1)]
    masked = secrets.redacted(docs, ledger=Twice(spark, str(tmp_path / "two"))).collect()
    assert sorted((r.doc_id, r.text) for r in masked) == [(1, "[SECRET]"), (2, "nothing"), (3, "[SECRET]")]
