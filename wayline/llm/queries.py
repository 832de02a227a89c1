"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import bpe, chat, collisions, divergence, fingerprint, jaccard, language, lines, negatives, packing, secrets, toxicity, warc
from wayline.session import scratch, table, written


ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Texts are long: fewer of them in an Arrow batch keep Python workers small. A session's own choice stays."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, str(rows))
    if spark.conf.get(ARROW_BYTES) == "67108864b":
        spark.conf.set(ARROW_BYTES, str(size))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.with_crc(packing.pack(documents(spark, sf_dir), path))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = warc.read_pages(spark, path)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("held_out", F.coalesce(language.fold_of("doc_id", 3) == 1, F.lit(False)))
    model = language.train(rows.where(~F.col("held_out")).select("text", "lang"))
    return language.predict(rows.select("doc_id", "held_out", "text"), model)


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(documents(spark, sf_dir)).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("assign", "access", "hex")
    rows = secrets.scan_paths(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return rows.select(F.col("path").alias("doc_id"), *map(of, base), F.sha2(joined(own), 256).alias("base_sha256"), joined("spans").alias("spans"))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = toxicity.SAMPLE) -> DataFrame:
    """Texts with their toxic labels, of about `sample` learnable ones: text and label.

    The sample is drawn from the distinct (text, label) pairs, by a hash of the text and with one document for each, so
    that copies neither fill nor empty it; only hashes of texts meet the labels. What is joined back is broadcast if it
    is as small as the sample makes it, which its count shows, and joined by a shuffle otherwise.
    """
    own = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("sample")).alias("own")
    small = lambda df: F.broadcast(df) if df.count() <= 4 * sample else df
    marks = labels.where((language.fold_of("doc_id", 5) != 0) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label")).distinct()
    of = docs.select(F.col("doc_id").cast("long"), own).join(small(written(marks, "labels")), "doc_id")
    texts = written(of.groupBy("own", "label").agg(F.min("doc_id").alias("doc_id")), "marks")
    spot = F.pmod("own", F.lit(1 << 32)).cast("double") / float(1 << 32)
    chosen = written(texts.where(spot < min(1.0, sample / max(texts.count(), 1))), "marks")
    return docs.select(F.col("doc_id").cast("long"), "text", own).join(small(chosen), ["doc_id", "own"]).select("text", "label")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(labelled(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(language.fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(documents(spark, sf_dir), n=4, share=(85, 100))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    of = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return rows.select("doc_id", "n_tokens", of("ids").alias("ids_sha256"), of("decoded").alias("decoded_sha256"))


def op7_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_vectors(table(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: A conversation whose turns say what the template itself does.
_ODD = "SELECT -7L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    found = chat.read_back(chat.whole(rows.union(spark.sql(_ODD))))
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(told).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        digest(F.col("learnt")).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(negatives.integers(moved), F.col("id") % 50 == 0)


QUERIES = {
    "op13_negatives": op13_negatives,
    "op12_divergence": op12_divergence,
    "op11_chat": op11_chat,
    "op7_collisions": op7_collisions,
    "op5_bpe": op5_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_jaccard": op10_jaccard,
    "op8_toxicity": op8_toxicity,
    "op3_language": op3_language,
    "op6_secrets": op6_secrets,
    "op4_fingerprint": op4_fingerprint, "op1_packing": op1_packing, "op2_warc": op2_warc}
#: Base32 of a SHA-1, five hexadecimal digits to four letters.
_BASE32 = "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(sha1(p), CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '')"
_COMPONENTS = "both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)"



def _spans_of(rank: int, rule: secrets.Rule) -> str:
    """Spans of one rule: a match begins after the parts between matches and the matches before it."""
    pattern = ("(?i)" if rule.ignore_case else "") + rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, list_sum(list_transform(parts[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1 : k - 1], lambda x: length(x))), 0) AS start, length(found[k]) AS size
        FROM (SELECT doc_id, found, held, parts, unnest(range(1, len(found) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {rule.group}) AS held, string_split_regex(t, '{pattern}') AS parts FROM d)) WHERE length(held[k]) >= {max(rule.least, 1)}"""


_SPANS = " UNION ALL ".join(_spans_of(k, r) for k, r in enumerate(secrets.RULES))
_SPAN = "kind || ':' || start || ':' || (start + size)"

#: The length of a text once its escapes and control strings are escaped.
_ESCAPED = "length(replace(replace(replace(replace(replace(t, '\\', '\\\\'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '</s>', '<\\/s>'), '<s>', '<\\s>'))"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op11_chat": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        b AS (SELECT *, {_ESCAPED} AS n, {_ESCAPED.replace("(t,", "(r,")} AS m, row_number() OVER w > 1 AND lag(r) OVER w = r AS goes_on FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t))
        SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256, coalesce(CAST(SUM(length(t)) FILTER (r = 'assistant') AS BIGINT), 0) AS loss_chars,
          sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256, CAST(SUM(n + CASE WHEN goes_on THEN 3 ELSE m + 17 END) AS BIGINT) AS formatted_chars FROM b GROUP BY conv_id""",
    "op12_divergence": f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents), g AS (SELECT DISTINCT lang, source FROM d),
        w AS (SELECT i, lang, source, unnest(regexp_extract_all({_LOWER.format("t")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d), c AS (SELECT lang, source, term, COUNT(*) AS n, COUNT(DISTINCT i) AS docs FROM w GROUP BY ALL),
        k AS (SELECT lang, term, SUM(n) AS total FROM c GROUP BY ALL HAVING SUM(docs) >= 10), v AS (SELECT lang, COUNT(*) AS v, SUM(total) AS whole FROM k GROUP BY lang),
        m AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term), s AS (SELECT lang, source, SUM(n) AS own FROM m GROUP BY ALL),
        p AS (SELECT m.*, 1 + 1000000000 * (n + 2)::HUGEINT // (own + 2 * v) AS p, 1 + 1000000000 * (total + 2)::HUGEINT // (whole + 2 * v) AS q FROM m JOIN s ON s.lang = m.lang AND s.source = m.source JOIN v ON v.lang = m.lang),
        x AS (SELECT a.lang, a.source, b.source AS item, SUM((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
        f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= 10""",
    "op13_negatives": """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 50 = 0 AND b.id <> a.id AND len(a.v) = len(b.v)),
        p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS n FROM s WHERE same) WHERE n <= 5),
        r AS (SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3""",
    "op6_secrets": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({_SPANS}), g AS (SELECT doc_id, COUNT(*) FILTER (kind = 'assign') AS n_assign, COUNT(*) FILTER (kind = 'access') AS n_access, COUNT(*) FILTER (kind = 'hex') AS n_hex,
        string_agg({_SPAN}, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg({_SPAN}, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op2_warc": f"""WITH q AS (SELECT page_id, coalesce(html, '') AS p FROM pages), m AS (SELECT *, MAX(page_id) OVER (PARTITION BY p) AS largest FROM q)
        SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> largest THEN largest END AS refers_to, CAST(NULL AS VARCHAR) AS error FROM m""",
    "op7_collisions": f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.95), {_COMPONENTS}
        SELECT vec_id, (SELECT COUNT(*) FROM both_ways WHERE a = vec_id) AS n_links, least(vec_id, coalesce((SELECT MIN(b) FROM reach WHERE reach.a = vec_id), vec_id)) AS component_id, least(vec_id, coalesce((SELECT MIN(b) FROM reach WHERE reach.a = vec_id), vec_id)) = vec_id AS kept FROM embeddings""",
    "op9_line_dedup": f"""WITH RECURSIVE occ AS (SELECT doc_id, unnest(range(0, len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
        num AS (SELECT t, length(t) AS n, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM occ WHERE regexp_matches(t, '[^\\x20\\x09-\\x0D]'))),
        links AS (SELECT x.i AS a, y.i AS b FROM num x JOIN num y ON x.i < y.i AND y.n BETWEEN x.n - 2 AND x.n + 2
          WHERE x.n >= 20 AND y.n >= 20 AND (left(x.t, x.n // 3) = left(y.t, x.n // 3) OR right(x.t, x.n // 3) = right(y.t, x.n // 3) OR contains(y.t, substr(x.t, x.n // 3 + 1, x.n // 3))) AND levenshtein(x.t, y.t) <= 2), {_COMPONENTS},
        class AS (SELECT t, least(i, coalesce(m, i)) AS c FROM num LEFT JOIN (SELECT a, MIN(b) AS m FROM reach GROUP BY a) ON a = i),
        placed AS (SELECT doc_id, line, t, row_number() OVER w AS k, first_value(t) OVER w AS f FROM occ JOIN class USING (t) WINDOW w AS (PARTITION BY c ORDER BY doc_id, line)),
        gone AS (SELECT doc_id, COUNT(*) FILTER (t = f) AS e, COUNT(*) FILTER (t <> f) AS o, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed FROM placed WHERE k > 1 GROUP BY doc_id)
        SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, coalesce(e, 0) AS n_exact, coalesce(o, 0) AS n_near, coalesce(removed, '') AS removed FROM documents d LEFT JOIN gone ON gone.doc_id = d.doc_id""",
    "op10_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id), overlap AS (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM overlap JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)), {_COMPONENTS}
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, MIN(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id""",
}
