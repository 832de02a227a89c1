"""Chat formatting: conversations as training texts with a loss mask, by Spark expressions only.

A conversation's turns are collected as structs and sorted by turn, then role, then text; adjacent turns of one role
are merged by array aggregation into a block

    begin role middle text [joint text ...] end

and the blocks are concatenated. Inside roles and texts, an escape after its first character breaks every control
string of the template, and escapes are doubled, so that control strings occur in the output only where the template
has put them, and every turn can be read back as it was. The loss mask is a list of spans, in code points of the
output, of the texts of the roles to be learnt.

Conversations of more than `segment` turns are cut where turn numbers pass multiples of it, so that no task holds
more than a segment; what a cut goes through (a block of one role) is known from the first and last turn of the
segments, which are joined back. The segments' texts, one after the other, are the same text as without cuts. Distinct
rows of one conversation with one turn number stay together.

Null texts and roles count as empty ones; null conversation ids are one conversation, and null turns come first in
theirs; rows repeated in full are turns of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayline.session import written

SEGMENT = 512
SPAN = "struct<start:int,end:int>"


@dataclass(frozen=True)
class Template:
    """Control strings; each begins with a character that none has further on, and none has the escape."""

    begin: str = "[INST]"
    middle: str = "[/INST]"
    end: str = "</s>"
    joint: str = "<s>"
    escape: str = "\\"

    def __post_init__(self) -> None:
        firsts, rest = {c[:1] for c in self.controls}, "".join(c[1:] for c in self.controls)
        if len(set(self.controls)) < 4 or any(len(c) < 2 for c in self.controls):
            raise ValueError("control strings are different and have two characters at least")
        if firsts & set(rest) or len(self.escape) != 1 or any(self.escape in c for c in self.controls):
            raise ValueError("the first character of a control string occurs once in it, and the escape in none")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.begin, self.middle, self.end, self.joint

    def escaped(self, text: Column) -> Column:
        doubled = F.replace(text, F.lit(self.escape), F.lit(self.escape * 2))
        control = "|".join(map(_quoted, self.controls))
        return F.regexp_replace(doubled, f"(?s)(?=(?:{control}))(.)", "$1" + re.sub(r"([\\$])", r"\\\1", self.escape))

    def unescaped(self, text: Column) -> Column:
        one = _quoted(self.escape)
        return F.regexp_replace(text, f"{one}({one})?", "$1")

    def tokens(self, text: Column, control: str) -> Column:
        """The parts of an output between occurrences of a control string."""
        return F.split(text, _quoted(control), -1)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def _turn(turn: str, role: str, text: str) -> Column:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.struct(F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"))


def _merged(turns: Column) -> Column:
    """The blocks (role, first, n) of sorted turns: neighbours of one role are one block."""
    none = F.array().cast("array<struct<role:string,first:int,n:int>>")
    last = lambda blocks: F.element_at(blocks, -1)
    block = lambda role, first, n: F.array(F.struct(role.alias("role"), first.cast("int").alias("first"), n.cast("int").alias("n")))

    def step(blocks: Column, t: Column) -> Column:
        grown = F.concat(F.slice(blocks, F.lit(1), F.size(blocks) - 1), block(last(blocks)["role"], last(blocks)["first"], last(blocks)["n"] + 1))
        begun = F.concat(blocks, block(t["role"], F.when(F.size(blocks) == 0, 1).otherwise(last(blocks)["first"] + last(blocks)["n"]), F.lit(1)))
        return F.when((F.size(blocks) > 0) & (last(blocks)["role"] == t["role"]), grown).otherwise(begun)

    return F.aggregate(turns, none, step)


def _spans(pieces: Column) -> Column:
    """The spans to learn of pieces (before, text, after, learn), which follow one another."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["before"])
        end = start + F.char_length(p["text"])
        own = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + F.char_length(p["after"])).alias("at"), F.when(p["learn"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(pieces, zero, step)["spans"]


def formatted(rows: DataFrame, template: Template = Template(), learn: tuple[str, ...] = ("assistant",), segment: int = SEGMENT, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, segment, formatted, loss): the texts of conversations, each in one or more segments, with the spans
    (start, end) of each segment's text that are to be learnt."""
    short, many = _dealt(rows, segment, conversation, turn, role, text)
    own = _formatted(short, None, template, learn)
    return own if many is None else own.union(_formatted(many, _seams(many), template, learn))


def whole(rows: DataFrame, template: Template = Template(), learn: tuple[str, ...] = ("assistant",), segment: int = SEGMENT, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, learnt): whole conversations with the pieces under the loss mask. A conversation is one row
    here, so at most as long as a string of Spark; only those that were cut are shuffled again."""
    short, many = _dealt(rows, segment, conversation, turn, role, text)
    own = _with_learnt(_formatted(short, None, template, learn)).drop("segment")
    if many is None:
        return own
    cut = _with_learnt(_formatted(many, _seams(many), template, learn))
    by = cut.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("segment", "formatted", "learnt"))).alias("s"))
    return own.union(by.select("conv_id", F.array_join("s.formatted", ""), F.flatten("s.learnt")))


def _with_learnt(segments: DataFrame) -> DataFrame:
    learnt = F.transform("loss", lambda s: F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))
    return segments.select("conv_id", "segment", "formatted", learnt.alias("learnt"))


def _dealt(rows: DataFrame, segment: int, conversation: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """The turns of conversations with one segment, and those of the others, with the segment of each."""
    own = rows.select(F.col(conversation).alias("conv_id"), _turn(turn, role, text).alias("t"))
    long = written(rows.groupBy(F.col(conversation).alias("long_id")).count().where(F.col("count") > segment).select("long_id"), "long-conversations")
    if not long.take(1):
        return own.withColumn("segment", F.lit(0).cast("long")), None
    is_long = own["conv_id"].eqNullSafe(long["long_id"])
    cut = F.coalesce(F.floor(F.col("t.turn") / segment), F.lit(-1 << 62))
    return own.join(long, is_long, "left_anti").withColumn("segment", F.lit(0).cast("long")), own.join(long, is_long, "left_semi").withColumn("segment", cut)


def _seams(rows: DataFrame) -> DataFrame:
    """For each segment, the role of the turn before it and of the turn after it; only small columns are read."""
    edge = F.struct("t.turn", "t.role")
    ends = rows.groupBy("conv_id", "segment").agg(F.min(edge).alias("first"), F.max(edge).alias("last"))
    along = Window.partitionBy("conv_id").orderBy("segment")
    return ends.select(F.col("conv_id").alias("of"), F.col("segment").alias("at"), F.lag("last.role").over(along).alias("before"), F.lead("first.role").over(along).alias("after"))


def _formatted(rows: DataFrame, seams: DataFrame | None, template: Template, learn: tuple[str, ...]) -> DataFrame:
    turns = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    if seams is None:
        turns = turns.withColumns({"before": F.lit(None).cast("string"), "after": F.lit(None).cast("string")})
    else:
        turns = turns.join(seams, turns["conv_id"].eqNullSafe(seams["of"]) & (turns["segment"] == seams["at"])).drop("of", "at")
    blocks = turns.withColumn("blocks", _merged(F.col("turns")))
    head = lambda b: F.concat(F.lit(template.begin), template.escaped(b["role"]), F.lit(template.middle))

    def pieces(b: Column) -> Column:
        own = F.slice("turns", b["first"], b["n"])
        goes_on = (b["first"] == 1) & F.col("before").eqNullSafe(b["role"])
        stays_open = (b["first"] + b["n"] - 1 == F.size("turns")) & F.col("after").eqNullSafe(b["role"])
        before = lambda k: F.when(k > 0, template.joint).when(goes_on, template.joint).otherwise(head(b))
        after = lambda k: F.when((k < b["n"] - 1) | stays_open, "").otherwise(template.end)
        return F.transform(own, lambda t, k: F.struct(before(k).alias("before"), template.escaped(t["text"]).alias("text"), after(k).alias("after"), b["role"].isin(*learn).alias("learn")))

    parts = blocks.select("conv_id", "segment", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    output = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    return parts.select("conv_id", "segment", output.alias("formatted"), _spans(F.col("pieces")).alias("loss"))


def read_back(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turns, learnt, formatted): the turns (role, text) of whole() conversations, and the text to be learnt,
    both without escapes."""
    parts = lambda block: template.tokens(F.substring_index(block, template.middle, -1), template.joint)
    role = lambda block: template.unescaped(F.substr(F.substring_index(block, template.middle, 1), F.lit(len(template.begin) + 1)))
    blocks = F.filter(template.tokens(F.col("formatted"), template.end), lambda b: b != "")
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(parts(b), lambda t: F.struct(role(b).alias("role"), template.unescaped(t).alias("text")))))
    learnt = F.array_join(F.transform("learnt", template.unescaped), "")
    return conversations.select("conv_id", turns.alias("turns"), learnt.alias("learnt"), "formatted")
