"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a table in a folder that outlives
a run, holds for each blob the rule versions that have scanned it and what they found; a scan reads only blobs with rule
versions missing there, once per blob however many paths and versions have it, adds what it found to the ledger, and
findings are joined back to all paths and versions. A rule that gets a new version is run again on every blob, the
others are not. Runs that add the same blob at one time leave equal rows, which count once.

Spans are code points, end exclusive, leftmost and non-overlapping for each rule. Null texts count as empty and
have no spans; repeated rows get a row each; an empty table gives no rows; other columns are ignored by scans and
kept, whatever their names, by redacted().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wayline.session import scratch, unused, written

#: A session's setting that names the folder of the ledger; without it every run begins with an empty one.
FOLDER = "spark.wayline.secrets.ledger"
SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. One of hints (lower case) is in every text that has one; a group may have a least length."""

    kind: str
    version: int
    pattern: str
    hints: tuple[str, ...] = ()
    ignore_case: bool = False
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("passw", "secret", "token", "api"), True, 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), least=20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", ("gh",)),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{20,}", ("xox",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,40}PRIVATE KEY-----", ("private key",)),
)


def found(text: str, rules: tuple[Rule, ...], lower: str | None = None) -> list[tuple[str, int, int]]:
    """All spans in a text, by start and then in the rules' order."""
    lower = text.lower() if lower is None else lower
    spans = []
    for k, rule in enumerate(rules):
        if rule.hints and not any(h in lower for h in rule.hints):
            continue
        pattern = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))
        spans += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [(rules[k].kind, start, end) for start, k, end in sorted(spans)]


class Ledger:
    """What has been scanned: rows (blob, rules, spans) in Parquet files below a folder that all runs share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or spark.conf.get(FOLDER, None) or scratch(spark, "ledger")

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], LEDGER)

    def add(self, fresh: DataFrame) -> None:
        fresh.select("blob", "rules", "spans").write.mode("append").parquet(self.path)


def addressed(versions: DataFrame, path: str, text: str, version: str | None = None) -> DataFrame:
    """path, version (null where there is no such column) and text with the blob that addresses the content."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    which = F.lit(None).cast("string") if version is None else F.col(version).cast("string")
    return versions.select(F.col(path).alias("path"), which.alias("version"), content.alias("text")).withColumn("blob", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: what the rules find in blobs of addressed() versions that the ledger has not scanned by them."""
    names = [r.name for r in rules]
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    todo = F.lit(names).cast("array<string>")
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        blobs = blobs.join(seen, "blob", "left")
        todo = F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))
    by_name = {r.name: r for r in rules}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            out = []
            for text, todo in zip(batch.column("text").to_pylist(), batch.column("todo").to_pylist(), strict=True):
                spans = found(text, tuple(by_name[x] for x in todo))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), batch.column("todo"), pa.array(out, pa.list_(span))], names=["blob", "rules", "spans"])

    return blobs.withColumn("todo", todo).where(F.size("todo") > 0).select("blob", "text", "todo").mapInArrow(scanned, LEDGER)


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob of a ledger with all that the rules, in their present versions, found in it."""
    kinds = F.lit([r.kind for r in rules]).cast("array<string>")
    now = F.lit([r.name for r in rules]).cast("array<string>")
    kept = ledger.where(F.arrays_overlap("rules", now))
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    current = F.filter(ranked, lambda s: F.exists(F.col("rules"), lambda r: F.array_contains(now, r) & F.startswith(r, F.concat(s["kind"], F.lit("@")))))
    every = kept.withColumn("ranked", current).groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ranked")))).alias("ranked"))
    return every.select("blob", F.transform("ranked", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def known(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of the blobs in which something is found, after those of addressed() versions that the ledger lacks
    have been scanned. Another run may have added the same blobs, so rows are gathered by blob."""
    before = ledger.read()
    again = bool(before.take(1))
    ledger.add(scan(versions, before if again else None, rules))
    found = findings(ledger.read().where(F.size("spans") > 0), rules)
    return written(found, "findings") if again else found


def scan_paths(versions: DataFrame, path: str = "doc_id", text: str = "text", version: str | None = None, ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Each row's path and version with the spans in its text; blobs not scanned before are added to the ledger."""
    own = addressed(versions, path, text, version)
    spans = known(own, ledger or Ledger(versions.sparkSession), rules)
    return own.select("path", "version", "blob").join(spans, "blob", "left").select("path", "version", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


@F.udf(StringType(), useArrow=True)
def _masked(text: str, spans: list, mask: str) -> str:
    """The text with each stretch that spans cover replaced by one mask."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", ledger: Ledger | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents, all of their columns and rows, with secrets in their texts replaced."""
    columns = docs.columns
    blob, spans = unused("__blob", columns), unused("__spans", columns)
    keyed = docs.withColumn(blob, F.unhex(F.sha2(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8"), 256)))
    own = addressed(docs.select(F.lit(0).alias("path"), F.col(text).alias("text")), "path", "text")
    hits = known(own, ledger or Ledger(docs.sparkSession), rules).where(F.size("spans") > 0)
    hit = keyed.join(hits.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), blob, "left")
    masked = F.when(F.col(spans).isNull(), F.col(text)).otherwise(_masked(F.coalesce(text, F.lit("")), F.coalesce(spans, F.array().cast(SPANS)), F.lit(mask)))
    return hit.withColumn(text, masked).select(columns)
