"""Patterns as DataFrame plans: joins in (time, arrival) order, with the matcher's consumption rules.

What a candidate waits for depends on which leaves it has met, and the windows on when. So a plan goes from state to
state, a state being the set of leaves met and of sustained ones begun, fewest first: a table holds all candidates of a
state, whatever the order in which they met its leaves, with seed, last match, the time of each leaf met and a column
per role. In a state, a leaf that binds a new object joins every later match; one that binds none takes the first, and
the first match that only such leaves take uses the candidate up, so that a leaf that binds joins no match after it. All
operators, nested in any way, are rules for a state's waits and windows (`waits`).

Leaves that bind nothing new need no join: matches of the same objects are sorted together once, and the next match of
each leaf is a pointer, a running value from the end (`next_of`); buckets of time keep an object that has very many
matches from being one task's work. Matches that seed or bind bring their pointers with them (n_ columns), which stay
right for leaves that go on waiting; only where there is none are candidates themselves sorted among the matches
(`pointed`). Leaves that every completion needs are pointed to as well, long before they are waited for (e_ columns):
matches from which one is out of reach seed and bind nothing, and a needed match that lies after a candidate's last one is
the next one still. A leaf that binds and completes takes the first match of each binding, which the match itself tells
by the one before it. Children of a sequence that share no role (`chains`) need no states at all: for each of them a table
says, per binding, from which match until which an earlier one leads to which completion, and these tables meet in slots
of the seed's time, so that neither pairs nor triples are shuffled, grouped or written. Shared roles are the keys of the joins that remain. Where a leaf shares
none, its window, or the horizon that bounds how long any candidate lives, cuts both sides into time buckets, which
makes the range join an equi join.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.restarts import beside, bucket_width, onward
from wayline.plans.events import BROADER, CLASSES, Event, Pattern
from wayline.plans.matches import observed_once
from wayline.session import written

MS, NEVER = 1000, 1 << 62
#: Copies of a state's plan that may stand in the plans of the states after it before it is written.
COPIES = 8
#: Slots of time into which the life of a chain's candidate is cut.
SLOTS = 8
_PLAIN = ["s_t", "s_seq", "s_source", "s_leaf"]


class Unsupported(NotImplementedError):
    """The pattern has no plan of joins; evaluate it by keys with operators.matching.match_by_key."""


def compile_event(event: Event, matches: DataFrame, horizon_ms: int | None = None) -> DataFrame:
    """All occurrences of the event: event, matched_at, completed_at, matched_source, predicate, and a column a role.

    An occurrence is told apart by its seed and bindings; the earliest completion counts. With a horizon, candidates
    end that long after their seed. Building the plan runs jobs: the span of the matches is read, and tables of states
    with a leaf that binds are written.
    """
    return _Compiler(event, matches, horizon_ms).run()


def compile_ends(event: Event, matches: DataFrame, horizon_ms: int | None = None) -> DataFrame:
    """All candidates that the event ever had, and how each ended: a column a role, and key, matched_at,
    matched_source, predicate, state (the leaves met), satisfied (their number), status, ended_at and reason.

    A candidate is `completed`, `used` by the match that took it on to another state, `expired` when the time of the
    last match passes its deadline, or still `open`. reason names the node (path of child numbers) whose window was the
    first to pass, and how. The last match is that of the candidate's key, if all leaves carry one role, else that of the
    table. A completed candidate is told apart by its seed and bindings.
    """
    return _Compiler(event, matches, horizon_ms).ends()


class Wait(NamedTuple):
    """A leaf that a state waits for: from when, until when, and the length of the shortest window around it."""

    leaf: int
    opens: Column | None
    until: Column | None
    width: int | None
    sustained: bool

    def ending(self, until: Column | None, width: int | None) -> Wait:
        return self._replace(until=_least(self.until, until), width=_shorter(self.width, width))


class Step(NamedTuple):
    """A child of a chain: its leaves, how long those that are sustained have to be, and the length of its window."""

    leaves: tuple[int, ...]
    sustained: dict[int, int]
    within: int | None


class State(NamedTuple):
    met: frozenset[int]
    begun: frozenset[int]


def _least(*columns: Column | None) -> Column | None:
    some = [c for c in columns if c is not None]
    return None if not some else some[0] if len(some) == 1 else F.least(*some)


def _shorter(*widths: int | None) -> int | None:
    return min((w for w in widths if w is not None), default=None)


def _stamp(us: str) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def _both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


class _Compiler:
    def __init__(self, event: Event, matches: DataFrame, horizon_ms: int | None):
        self.event, self.matches, self.horizon = event, observed_once(matches), horizon_ms
        self.order = list(event.pattern.leaves())
        self.durations: dict[int, int] = {}
        self.width = bucket_width(matches)
        self.copies: dict[State, int] = {}
        #: Leaves without which nothing completes; left out where ends are asked for, as all candidates have one.
        self.needed: set[int] = set()

    def run(self) -> DataFrame:
        if chains := self.chains():
            return reduce(DataFrame.unionByName, [self.chained(*chain) for chain in chains])
        if not all(set(self.roles(k)) == set(self.roles(0)) for k in range(len(self.order))):
            self.needed = self.compulsory(self.event.pattern, 0)
        best = self.completed(self.walk())
        return best.select(F.lit(self.event.name).alias("event"), _stamp("s_t").alias("matched_at"), _stamp("done").alias("completed_at"), F.col("s_source").alias("matched_source"), self.predicate().alias("predicate"), *(F.col(f"r_{r}").alias(r.lower()) for r in self.event.pattern.role_names()))

    def completed(self, done: list[DataFrame]) -> DataFrame:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), done)
        keys = ["s_leaf", "s_t", "s_source", *(f"r_{r}" for r in self.event.pattern.role_names())]
        if self.told_apart:
            return rows.select(*keys, F.col("act").alias("done"))
        return rows.groupBy(*keys).agg(F.min("act").alias("done"))

    def predicate(self) -> Column:
        return F.element_at(F.lit([x.predicate for x in self.order]).cast("array<string>"), F.col("s_leaf") + 1)

    def walk(self, ended: list[DataFrame] | None = None) -> list[DataFrame]:
        """The completed candidates of each state; ended gets those that stopped in a state, or may stop there."""
        open_: dict[State, list[DataFrame]] = {}
        firsts = self.first(self.event.pattern, 0)
        for leaf, sustained in firsts:
            state = State(frozenset(), frozenset({leaf})) if sustained else State(frozenset({leaf}), frozenset())
            open_.setdefault(state, []).append(self.seed(leaf, sustained, state))
            self.copies[state] = self.copies.get(state, 0) + 1
        done = []
        # seeds that take one leaf more, the first match of each binding: no candidate of a binding has another beside it
        seeds = list(open_)
        self.told_apart = bool(self.needed) and len(seeds) == len(firsts) and all(self.completes_at_once(s) for s in seeds) and all(map(self.distinct, sorted(leaf for leaf, _ in firsts)))
        while open_:
            state = min(open_, key=lambda s: (2 * len(s.met) + len(s.begun), sorted(s.met)))
            parts = open_.pop(state)
            # pointers that some ways to this state lack are looked up again
            lacked = {c for p in parts for c in p.columns if c[:2] in ("n_", "e_") and not all(c in q.columns for q in parts)}
            rows = reduce(DataFrame.unionByName, [p.drop(*lacked) for p in parts])
            t, waits, deadline, _ = self.root(state)
            if t is not None:
                done.append(rows.withColumn("act", t).drop(*(c for c in rows.columns if c[:2] in ("h_", "b_", "l_", "n_", "e_"))))
                continue
            marked, moves = self.advanced(state, rows, waits)
            if ended is not None:
                ended.append(self.stopped(state, marked, deadline))
            for after, more in moves:
                open_.setdefault(after, []).append(more)
                self.copies[after] = self.copies.get(after, 0) + self.copies[state]
        return done

    # children that share no role

    def step(self, node: Pattern, at: int) -> Step | None:
        """A leaf, sustained or not, or any of such with the same roles, within a window or not; None for other nodes."""
        within = None
        if node.op == "within" and node.least_ms == 0:
            within, node = node.most_ms * MS, node.children[0]
        options, places = (node.children, self.places(node, at)) if node.op == "any" else ((node,), [at])
        plain = [x.children[0] if x.op == "for" else x for x in options]
        roles = {frozenset(r for _, r in x.roles) for x in plain}
        if any(x.op != "leaf" for x in plain) or len(roles) != 1 or not all(roles):
            return None
        return Step(tuple(places), {k: x.least_ms * MS for k, x in zip(places, options, strict=True) if x.op == "for"}, within)

    def chains(self) -> list[list[Step]]:
        """The orders in which a pattern's children, which bind objects of their own, come; none for other patterns.

        The earliest completion of a child is then all that the next one needs to know, unless that has a window of its own.
        """
        node = self.event.pattern
        steps = [self.step(c, at) for c, at in zip(node.children, self.places(node, 0), strict=True)]
        if node.op != "seq" or len(steps) < 2 or None in steps:
            return []
        roles = [r for x in steps for r in self.roles(x.leaves[0])]
        if len(set(roles)) < len(roles):
            return []
        found = [steps]
        if any(len(first.leaves) > 1 or first.sustained or first.within is not None or any(x.within is not None for x in more) for first, _, *more in found):
            return []
        bounded = self.horizon is not None or all(len(x) == 2 and x[1].within is not None for x in found)
        return found if bounded and all(self.distinct(x[0].leaves[0]) for x in found) else []

    def led(self, step: Step) -> DataFrame:
        """(roles, q_t, q_seq, x_t, x_seq, act): what comes at (q_t, q_seq) or later, but before (x_t, x_seq), has the step's
        first completion of that binding in act."""
        roles, parts = sorted(self.roles(step.leaves[0])), []
        for k in step.leaves:
            own, last = self.leaf(self.order[k]), F.struct("t", "seq")
            if k in step.sustained:
                since = F.greatest(last, F.struct((F.col("t") + step.sustained[k]).alias("t"), F.lit(-NEVER).alias("seq")))
                own = self.next_of(own, since["t"], since["seq"], tuple(roles), [k], "n_").withColumnRenamed(f"n_{k}", "own")
            else:
                own = own.withColumn("own", F.struct(F.col("t").alias("m_t"), F.col("seq").alias("m_seq")))
            parts.append(own.select(*roles, "t", "seq", "own"))
        rows = reduce(DataFrame.unionByName, parts)
        if len({self.order[k].predicate for k in step.leaves}) < len(step.leaves):  # one match may fit two
            rows = rows.groupBy(*roles, "t", "seq").agg(F.min("own").alias("own"))
        rows = beside(rows, roles, "t", self.width, {"q_t": "t", "q_seq": "seq"}, ties=["seq"])
        rows = onward(rows, roles, "t", [F.col("seq")], self.width, {"act": F.col("own")})
        return rows.where(F.col("act").isNotNull()).select(*roles, "q_t", "q_seq", F.col("t").alias("x_t"), F.col("seq").alias("x_seq"), F.col("act.m_t").alias("act_t"), F.col("act.m_seq").alias("act_seq"))

    def chained(self, first: Step, *rest: Step) -> DataFrame:
        """The occurrences of a chain; what they show of the seed and of the last completion is known before they are joined."""
        lives = _shorter(None if self.horizon is None else self.horizon * MS, rest[0].within if len(rest) == 1 else None)
        width = max(1, -(-lives // SLOTS))
        slot = lambda t: F.floor(t / F.lit(width)).cast("long")
        seed = first.leaves[0]
        own = self.leaf(self.order[seed]).withColumnsRenamed({"t": "l_t", "seq": "l_seq"})
        rows = own.select("*", F.col("l_t").alias("s_t"), _stamp("l_t").alias("matched_at"), slot(F.col("l_t")).alias("slot"))
        for k, step in enumerate(rest):
            low = F.col("act_t") - _shorter(lives, step.within)
            low = low if k else F.greatest(low, "q_t")
            led = self.led(step).where(low <= F.col("x_t"))
            led = led.withColumn("__slot", F.explode(F.sequence(slot(low), slot(F.col("x_t")))))
            led = led.withColumn("completed_at", _stamp("act_t")) if k == len(rest) - 1 else led
            before = lambda a, b: (F.col(f"{a}_t") < F.col(f"{b}_t")) | ((F.col(f"{a}_t") == F.col(f"{b}_t")) & (F.col(f"{a}_seq") < F.col(f"{b}_seq")))
            on = [rows["slot"] == led["__slot"], before("l", "x"), F.col("q_t").isNull() | ~before("l", "q"), F.col("act_t") <= F.col("s_t") + _shorter(lives, step.within)]
            on += [rows[h] != led[r] for r in self.roles(step.leaves[0]) for h in rows.columns if h.startswith("r_")]
            kept = [c for c in rows.columns if c not in ("l_t", "l_seq")]
            rows = rows.join(led, _both(on)).select(*kept, *(c for c in led.columns if c not in ("q_t", "q_seq", "x_t", "x_seq", "act_t", "act_seq", "__slot")), F.col("act_t").alias("l_t"), F.col("act_seq").alias("l_seq"))
        return rows.select(F.lit(self.event.name).alias("event"), "matched_at", "completed_at", F.col("source").alias("matched_source"), F.lit(self.order[seed].predicate).alias("predicate"), *(F.col(f"r_{r}").alias(r.lower()) for r in self.event.pattern.role_names()))

    def compulsory(self, node: Pattern, at: int) -> set[int]:
        """The leaves that have to be met for the node to be complete."""
        if node.op == "leaf":
            return {at}
        need = {"any": 1, "k_of_n": node.k}.get(node.op, len(node.children))
        if need < len(node.children):
            return set()
        return {x for child, place in zip(node.children, self.places(node, at), strict=True) for x in self.compulsory(child, place)}

    def completes_at_once(self, state: State) -> bool:
        """Whether the state waits for one leaf, which binds, and is complete with its first match."""
        t, waits, _, _ = self.root(state)
        return t is None and len(waits) == 1 and not state.begun and not waits[0].sustained and not set(self.roles(waits[0].leaf)) <= {r for k in state.met for r in self.roles(k)} and self.root(self.after(state, waits[0]))[0] is not None

    def distinct(self, leaf: int) -> bool:
        """Whether no two matches of a leaf have one time, source and objects."""
        return self.leaf(self.order[leaf]).groupBy("t", "source", *self.roles(leaf)).count().where("count > 1").isEmpty()

    # how candidates end

    def stopped(self, state: State, rows: DataFrame, deadline: Column | None) -> DataFrame:
        """A state's candidates with the time of the match that used them up, their deadline, and why it is one."""
        ends = F.lit(None).cast("long") if deadline is None else deadline
        roles = [F.col(f"r_{r}") if f"r_{r}" in rows.columns else F.lit(None).cast("string").alias(f"r_{r}") for r in self.event.pattern.role_names()]
        used = F.col("star.m_t") if "star" in rows.columns else F.lit(None).cast("long")
        if deadline is None:
            why = None
        else:
            _, why = self.failing(self.event.pattern, 0, "", F.col("s_t"), self.until(), state, deadline + 1)
        return rows.select(
            "s_t", "s_source", "s_leaf", *roles, F.lit(",".join(map(str, sorted(state.met)))).alias("state"), F.lit(len(state.met)).alias("satisfied"),
            used.cast("long").alias("used"), ends.cast("long").alias("deadline"), (F.lit(None).cast("string") if why is None else F.coalesce(why, F.lit(": horizon"))).alias("reason"),
        )

    def until(self) -> Column | None:
        return None if self.horizon is None else F.col("s_t") + self.horizon * MS

    def failing(self, node: Pattern, at: int, path: str, active: Column, until: Column | None, state: State, now: Column) -> tuple[Column | None, Column | None]:
        """When the node was complete, or else why it has failed by `now`: null if it has not."""
        said = lambda why: F.lit(f"{path}: {why}")
        if node.op == "leaf":
            return (F.col(f"h_{at}"), None) if at in state.met else (None, None)
        if node.op == "for":
            if at in state.met:
                return F.col(f"h_{at}"), None
            return None, None if until is None else F.when(now > until, said("window of an ancestor"))
        places = self.places(node, at)
        inner = lambda k, a, u: self.failing(node.children[k], places[k], f"{path}.{k}" if path else str(k), a, u, state, now)
        if node.op == "seq":
            for k in range(len(places)):
                t, why = inner(k, active, until)
                if t is None:
                    return None, why
                active = t
            return active, None
        if node.op == "within":
            opens, closes = active + node.least_ms * MS, active + node.most_ms * MS
            t, why = inner(0, opens, _least(until, closes))
            if t is not None:
                return t, None
            own = F.when(now > closes, said("window"))
            return None, F.when(now >= opens, own if why is None else F.coalesce(why, own))
        parts = [inner(k, active, until) for k in range(len(places))]
        times = [t for t, _ in parts if t is not None]
        need = {"all": len(parts), "any": 1, "k_of_n": node.k}[node.op]
        if len(times) >= need:
            return (times[0] if len(times) == 1 else F.greatest(*times)), None
        broken = [why for _, why in parts if why is not None]
        reasons = []
        if broken and node.op == "all":
            reasons.append(F.coalesce(*broken))
        if broken:
            failed = reduce(lambda a, b: a + b, [why.isNotNull().cast("int") for why in broken])
            reasons.append(F.when(len(parts) - failed < need, said("too few left")))
        if times and node.op != "any":
            reasons.append(F.when(now > _least(until, _least(*times) + node.most_ms * MS), said("window for the rest")))
        return None, F.coalesce(*reasons) if reasons else None

    def ends(self) -> DataFrame:
        ended: list[DataFrame] = []
        done = self.completed(self.walk(ended))
        names = ["s_t", "s_source", "s_leaf", *(f"r_{r}" for r in self.event.pattern.role_names())]
        none = F.lit(None).cast("string")
        if not ended:  # a single leaf completes at once
            ended = [done.limit(0).select(*names, none.alias("state"), F.lit(0).alias("satisfied"), F.lit(None).cast("long").alias("used"), F.lit(None).cast("long").alias("deadline"), none.alias("reason"))]
        rows = reduce(DataFrame.unionByName, ended)
        common = self.event.common_roles()
        used = self.matches.where(F.col("predicate").isin(sorted({x.predicate for x in self.order})))
        if common:
            names_of = {(x.predicate, a) for x in self.order for a, r in x.roles if r == common[0]}
            by = F.coalesce(*(F.when(F.col("predicate") == p, F.col("arguments")[a]) for p, a in sorted(names_of)))
            last = used.groupBy(by.alias("key")).agg(F.max("t").alias("now"))
            rows = rows.withColumn("key", F.col(f"r_{common[0]}")).join(last, "key")
        else:
            rows = rows.withColumns({"key": none, "now": F.lit(used.agg(F.max("t")).first()[0]).cast("long")})
        late = F.coalesce(F.col("deadline") < F.col("now"), F.lit(False))
        status = F.when(F.col("used").isNotNull(), "used").when(late, "expired").otherwise("open")
        of = rows.select(*names, "key", "state", "satisfied", status.alias("status"), F.coalesce("used", F.when(late, F.col("deadline"))).alias("ended"), F.when(F.col("used").isNull() & late, F.col("reason")).alias("reason"))
        key = F.col(f"r_{common[0]}") if common else F.lit(None).cast("string")
        complete = done.select(*names, key.alias("key"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("int").alias("satisfied"), F.lit("completed").alias("status"), F.col("done").alias("ended"), F.lit(None).cast("string").alias("reason"))
        return of.unionByName(complete).select(
            "key", _stamp("s_t").alias("matched_at"), F.col("s_source").alias("matched_source"), self.predicate().alias("predicate"), *(F.col(f"r_{r}").alias(r.lower()) for r in self.event.pattern.role_names()),
            "state", "satisfied", "status", _stamp("ended").alias("ended_at"), "reason",
        )

    # what a state waits for

    def first(self, node: Pattern, at: int, sustained: bool = False) -> list[tuple[int, bool]]:
        """The leaves that can seed a candidate."""
        if node.op == "leaf":
            return [(at, sustained)]
        if node.op == "within" and node.least_ms > 0:
            raise Unsupported("a leading within with a minimum")
        some = list(zip(node.children, self.places(node, at), strict=True))
        if node.op in ("seq", "within", "for"):
            some = some[:1]
        return [x for child, place in some for x in self.first(child, place, node.op == "for")]

    def places(self, node: Pattern, at: int) -> list[int]:
        """The number of each child's first leaf."""
        out = []
        for child in node.children:
            out.append(at)
            at += sum(1 for _ in child.leaves())
        return out

    def root(self, state: State):
        return self.waits(self.event.pattern, 0, F.col("s_t"), self.until(), None if self.horizon is None else self.horizon * MS, state)

    def waits(self, node: Pattern, at: int, active: Column, until: Column | None, width: int | None, state: State) -> tuple[Column | None, list[Wait], Column | None, int | None]:
        """When the node was complete, or else its waits and its deadline: the time after which it has failed."""
        if node.op == "leaf":
            return (F.col(f"h_{at}"), [], None, None) if at in state.met else (None, [Wait(at, None, until, width, False)], None, None)
        if node.op == "for":
            self.durations[at] = node.least_ms * MS
            return (F.col(f"h_{at}"), [], None, None) if at in state.met else (None, [Wait(at, None, until, width, True)], until, width)
        inner = lambda k, a, u, w: self.waits(node.children[k], places[k], a, u, w, state)
        places = self.places(node, at)
        if node.op == "seq":
            for k in range(len(places)):
                t, waits, deadline, wide = inner(k, active, until, width)
                if t is None:
                    return None, waits, deadline, wide
                active = t
            return active, [], None, None
        if node.op == "within":
            opens, closes, most = active + node.least_ms * MS, active + node.most_ms * MS, max(node.most_ms * MS, 1)
            t, waits, deadline, wide = inner(0, opens, _least(until, closes), _shorter(width, most))
            if t is not None:
                return t, [], None, None
            deadline, wide = _least(deadline, closes), _shorter(wide, most)
            waits = [w._replace(opens=opens if w.opens is None else F.greatest(opens, w.opens)) for w in waits]
            return None, [w.ending(deadline, wide) for w in waits], deadline, wide
        parts = [inner(k, active, until, width) for k in range(len(places))]
        times = [t for t, _, _, _ in parts if t is not None]
        need = {"all": len(parts), "any": 1, "k_of_n": node.k}[node.op]
        if len(times) >= need:
            return (times[0] if len(times) == 1 else F.greatest(*times)), [], None, None
        pending = [p for p in parts if p[0] is None]
        waits = [w for _, ws, _, _ in pending for w in ws]
        # the node fails with the child that leaves too few
        spare, ends = len(pending) - (need - len(times)), [d for _, _, d, _ in pending if d is not None]
        deadline, wide = None, None
        if len(ends) > spare:
            deadline = _least(*ends) if spare == 0 else F.sort_array(F.array(*ends))[spare]
            wide = max(w for _, _, d, w in pending if d is not None)
        if times and node.op != "any":
            window = node.most_ms * MS
            deadline, wide = _least(deadline, until, _least(*times) + window), _shorter(wide, width, window)
        return None, [w.ending(deadline, wide) for w in waits], deadline, wide

    # leaves

    def leaf(self, leaf: Pattern) -> DataFrame:
        """(t, seq, source, roles) of the matches that fit a leaf by themselves."""
        fits = F.col("predicate") == leaf.predicate
        for name, value in leaf.literals:
            fits &= _echoes(F.col("arguments")[name], value)
            if name == "minimum_confidence":
                fits &= F.col("confidence") >= value
        for argument, role in leaf.roles:
            kind = self.event.roles[role]
            seen = F.col("classes")[argument]
            fits &= F.col("arguments")[argument].isNotNull() & (F.col("arguments")[argument] != "")
            plain = F.replace(F.trim(F.lower(seen)), F.lit(" "), F.lit("_"))
            fits &= seen.isNull() | seen.isin(kind, *BROADER.get(kind, ())) | ((plain == kind) if kind in CLASSES else F.lit(False))
        columns = [F.col("arguments")[a].alias(f"r_{r}") for a, r in leaf.roles]
        own = self.matches.where(fits).select("t", "seq", "source", *columns)
        for k, (_, one) in enumerate(leaf.roles):
            for _, other in leaf.roles[:k]:
                own = own.where(F.col(f"r_{one}") != F.col(f"r_{other}"))
        return own

    def roles(self, leaf: int) -> list[str]:
        return [f"r_{r}" for _, r in self.order[leaf].roles]

    def seed(self, leaf: int, sustained: bool, state: State) -> DataFrame:
        own = self.reaching(leaf, state, self.targets(leaf, state, self.roles(leaf)))
        if self.horizon is not None:
            own = self.within_reach(own, F.col("t") + self.horizon * MS)
        seed = {"s_t": F.col("t"), "s_seq": F.col("seq"), "s_source": F.col("source"), "s_leaf": F.lit(leaf), "l_t": F.col("t"), "l_seq": F.col("seq"), (f"b_{leaf}" if sustained else f"h_{leaf}"): F.col("t")}
        return own.withColumns(seed).select(*seed, *self.roles(leaf), *(c for c in own.columns if c[:2] in ("n_", "e_")))

    # pointers

    def reaching(self, leaf: int, after: State, targets: list[int], shared: list[str] | None = None) -> DataFrame:
        """leading() of the matches after which every needed leaf with no other objects comes again, with e_<leaf>: its next
        match. after is the state that the match leads to; leaves of only the roles `shared` have theirs already."""
        fits = lambda k: set(self.roles(k)) <= set(self.roles(leaf)) and not (shared is not None and set(self.roles(k)) <= set(shared))
        coming = [k for k in sorted(self.needed - after.met - after.begun - {leaf}) if fits(k)]
        own = self.leading(leaf, sorted({*targets, *coming}))
        own = own.withColumns({f"e_{k}": F.col(f"n_{k}") for k in coming}).drop(*(f"n_{k}" for k in coming if k not in targets))
        return own.where(_both([F.col(f"e_{k}").isNotNull() for k in coming])) if coming else own

    def within_reach(self, rows: DataFrame, until: Column) -> DataFrame:
        coming = [F.col(f"{c}.m_t") <= until for c in rows.columns if c.startswith("e_")]
        return rows.where(_both(coming)) if coming else rows

    def targets(self, leaf: int, after: State, has: list[str]) -> list[int]:
        """The leaves that a state waits for next and that a match of `leaf`, which leads to it, can point to."""
        t, waits, _, _ = self.root(after)
        fits = lambda w: set(self.roles(w.leaf)) <= set(self.roles(leaf)) <= set(has)
        return [] if t is not None else [w.leaf for w in waits if w.opens is None and w.leaf not in after.begun and fits(w)]

    def leading(self, leaf: int, targets: list[int]) -> DataFrame:
        """The matches of a leaf with n_<target>: (m_t, m_seq) of the next match of each target with the same objects."""
        own = self.leaf(self.order[leaf])
        groups: dict[tuple[str, ...], list[int]] = {}
        for k in targets:
            groups.setdefault(tuple(sorted(self.roles(k))), []).append(k)
        for roles, some in groups.items():
            own = self.next_of(own, F.col("t"), F.col("seq"), roles, some, "n_")
        return own

    def next_of(self, rows: DataFrame, t: Column, seq: Column, roles: tuple[str, ...], leaves: list[int], prefix: str) -> DataFrame:
        """rows with (m_t, m_seq) of the first match after (t, seq) of each leaf, all of which carry just these roles."""
        key = [f"k_{r}" for r in roles]
        held = F.struct(*rows.columns)
        own = rows.select(*(F.col(r).alias(k) for r, k in zip(roles, key, strict=True)), t.alias("t"), seq.alias("seq"), F.lit(None).cast("int").alias("leaf"), held.alias("row"))
        empty = F.lit(None).cast(own.schema["row"].dataType)
        parts = [self.leaf(self.order[k]).select(*(F.col(r).alias(x) for r, x in zip(roles, key, strict=True)), "t", "seq", F.lit(k).alias("leaf"), empty.alias("row")) for k in leaves]
        match = F.struct(F.col("t").alias("m_t"), F.col("seq").alias("m_seq"))
        # a row comes after a match of its own time and number, and so does not see it
        found = onward(reduce(DataFrame.unionByName, parts, own), key, "t", [F.col("seq"), F.col("row").isNotNull()], self.width, {f"{prefix}{k}": F.when(F.col("leaf") == k, match) for k in leaves})
        return found.where(F.col("row").isNotNull()).select("row.*", *(f"{prefix}{k}" for k in leaves))

    # from state to state

    def joined(self, candidates: DataFrame, waits: list[Wait], state: State, targets: tuple[int, ...] = (), following: State | None = None) -> DataFrame:
        """Candidates with each later match that fits one of the waits, which share the roles that the candidates have.

        Columns leaf, m_t, m_seq, m_ before each role that the leaves carry, and p_<target>: the match's pointers. With the
        state that follows, from which ends are not asked for, matches that lead nowhere are left out, columns e_ are added,
        and of a leaf that completes only the first match of each binding is joined.
        """
        has = [c for c in candidates.columns if c.startswith("r_")]
        roles = self.roles(waits[0].leaf)
        shared, new = [r for r in roles if r in has], [r for r in roles if r not in has]
        led = [F.col(f"n_{k}").alias(f"p_{k}") for k in targets]
        known = lambda own: [c for c in own.columns if c.startswith("e_")]
        ends = following is not None and not waits[0].sustained and waits[0].leaf not in state.begun and self.root(following)[0] is not None
        if following is None:
            parts = [self.leading(w.leaf, list(targets)) for w in waits]
        else:
            parts = [self.reaching(w.leaf, following, list(targets), has) for w in waits]
            if self.horizon is not None:  # the seed is no later than the match
                parts = [self.within_reach(p, F.col("t") + self.horizon * MS) for p in parts]
        if ends:
            parts = [beside(p, roles, "t", self.width, {"q_t": "t", "q_seq": "seq"}, ties=["seq"]) for p in parts]
            led += [F.col("q_t"), F.col("q_seq")]
        more = known(parts[0])
        parts = [p.select(F.lit(w.leaf).alias("leaf"), F.col("t").alias("m_t"), F.col("seq").alias("m_seq"), *(F.col(r).alias(f"m_{r}") for r in roles), *led, *(F.col(c).alias(f"m_{c}") for c in more)) for p, w in zip(parts, waits, strict=True)]
        m, c = reduce(DataFrame.unionByName, parts), candidates
        on = [c[r] == m[f"m_{r}"] for r in shared]
        if not shared:
            if any(w.until is None or w.width is None for w in waits):
                raise Unsupported(f"{self.order[waits[0].leaf].predicate} shares no role with what precedes it and has no bounded window: a horizon would bound it")
            width = max(w.width for w in waits)
            bucket = lambda t: F.floor(t / F.lit(width)).cast("long")
            last = F.greatest(F.col("l_t"), *(w.until for w in waits))
            c = c.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("l_t")), bucket(last))))
            m = m.withColumn("__its", bucket(F.col("m_t")))
            on = [c["__bucket"] == m["__its"]]
        on.append((F.col("m_t") > F.col("l_t")) | ((F.col("m_t") == F.col("l_t")) & (F.col("m_seq") > F.col("l_seq"))))
        fits = []
        for w in waits:
            own = [F.col("leaf") == w.leaf]
            own += [F.col("m_t") >= w.opens] if w.opens is not None else []
            own += [F.col("m_t") <= w.until] if w.until is not None else []
            own += [F.col("m_t") >= F.col(f"b_{w.leaf}") + self.durations[w.leaf]] if w.leaf in state.begun else []
            fits.append(_both(own))
        on.append(reduce(lambda a, b: a | b, fits))
        on += [m[f"m_{r}"] != c[h] for r in new for h in has]
        if ends:  # the match before it, of the same binding, did not fit
            before = (F.col("q_t") < F.col("l_t")) | ((F.col("q_t") == F.col("l_t")) & (F.col("q_seq") <= F.col("l_seq")))
            on.append(F.col("q_t").isNull() | before | (F.lit(False) if waits[0].opens is None else F.col("q_t") < waits[0].opens))
        if self.horizon is not None:
            on += [F.col(f"m_{e}.m_t") <= F.col("s_t") + self.horizon * MS for e in more]
        return c.join(m, _both(on)).select(*(x for x in candidates.columns if x not in more), "leaf", "m_t", "m_seq", *(F.col(f"m_{r}").alias(f"m_{r}") for r in new), *(f"p_{k}" for k in targets), *(F.col(f"m_{e}").alias(e) for e in more))

    def after(self, state: State, wait: Wait) -> State:
        if wait.sustained and wait.leaf not in state.begun:
            return State(state.met, state.begun | {wait.leaf})
        return State(state.met | {wait.leaf}, state.begun - {wait.leaf})

    def moved(self, rows: DataFrame, columns: list[str], state: State, wait: Wait, pointing: list[int], targets: tuple[int, ...] = ()) -> tuple[State, DataFrame]:
        """The candidates of the next state: the match is their last one, and the leaf's time is known.

        Pointers to the leaves `pointing` are still right, those of the match are added.
        """
        after, k = self.after(state, wait), wait.leaf
        name = f"h_{k}" if k in after.met else f"b_{k}"
        gone = {"l_t", "l_seq", f"b_{k}", f"e_{k}", *(c for c in columns if c.startswith("n_") and int(c[2:]) not in pointing)}
        fresh = [c for c in rows.columns if c.startswith("e_") and c not in columns]
        new = [r for r in self.roles(k) if r not in columns]
        return after, rows.select(*(c for c in columns if c not in gone), F.col("m_t").alias("l_t"), F.col("m_seq").alias("l_seq"), F.col("m_t").alias(name), *(F.col(f"m_{r}").alias(r) for r in new), *(F.col(f"p_{x}").alias(f"n_{x}") for x in targets), *fresh)

    def advanced(self, state: State, rows: DataFrame, waits: list[Wait]) -> tuple[DataFrame, list[tuple[State, DataFrame]]]:
        """The state's candidates with `star`, the match that uses each up, and those of the states after it."""
        columns = rows.columns
        plain = [w for w in waits if all(r in columns for r in self.roles(w.leaf))]
        binding = [w for w in waits if w not in plain]
        named = lambda w: self.order[w.leaf].predicate
        holding = [w for w in binding] + [w for w in plain if w.leaf in state.begun]
        if any(named(p) == named(h) for p in plain for h in holding if p is not h):
            return self.weighed(state, rows, plain, binding)
        out, marked = [], rows
        if plain:
            marked = self.pointed(rows, plain, state)
            vain = [F.col(f"f_{w.leaf}").isNotNull() for w in plain if w.leaf in self.needed]
            marked = marked.where(_both(vain)) if vain else marked
            marked = marked.withColumn("star", F.least(*(f"f_{w.leaf}" for w in plain)) if len(plain) > 1 else F.col(f"f_{plain[0].leaf}"))
        branches = len(plain) + len(binding)
        if binding and branches > 1 or branches * self.copies[state] > COPIES:
            marked = written(marked, "state")
            self.copies[state] = 1
        # a pointer of a leaf that goes on waiting lies at or after the match; it is spent if that match fits its leaf too
        lasting = lambda w: [x.leaf for x in plain if x.leaf != w.leaf and named(x) != named(w) and f"n_{x.leaf}" in columns]
        for w in plain:
            taken = marked.where(F.col(f"f_{w.leaf}") == F.col("star")).withColumns({"m_t": F.col("star.m_t"), "m_seq": F.col("star.m_seq")})
            out.append(self.moved(taken, columns, state, w, lasting(w)))
        for w in binding:
            kept = lasting(w)
            after = self.after(state, w)
            targets = tuple(k for k in self.targets(w.leaf, after, [*columns, *self.roles(w.leaf)]) if k not in kept)
            if plain:  # the candidate is used up by then
                w = w.ending(F.col("star.m_t"), None)
            found = self.joined(marked, [w], state, targets, after if self.needed else None)
            if plain:
                found = found.where(F.col("star").isNull() | (F.struct("m_t", "m_seq") < F.col("star")))
            if w.sustained and self.root(State(state.met | {w.leaf}, state.begun))[0] is not None:
                # nothing follows it: for each binding, evidence that began later is complete no earlier
                keep = [c for c in found.columns if c not in ("leaf", "m_t", "m_seq") and (c in columns or c[:2] in ("m_", "p_", "e_"))]
                found = found.groupBy(*keep).agg(F.min(F.struct("m_t", "m_seq")).alias("m")).select(*keep, "m.m_t", "m.m_seq")
            out.append(self.moved(found, columns, state, w, kept, targets))
        return marked, out

    def pointed(self, rows: DataFrame, waits: list[Wait], state: State) -> DataFrame:
        """rows with f_<leaf> for each wait: (m_t, m_seq) of the first match that fits it, null if none does in time."""
        out, groups = rows, {}
        for w in waits:
            after = [x for x in (w.opens, F.col(f"b_{w.leaf}") + self.durations[w.leaf] if w.leaf in state.begun else None) if x is not None]
            if not self.roles(w.leaf) and w.until is None and f"n_{w.leaf}" not in rows.columns:
                raise Unsupported(f"{self.order[w.leaf].predicate} shares no role with what precedes it and has no bounded window: a horizon would bound it")
            if not after and f"n_{w.leaf}" in rows.columns:
                out = out.withColumn(f"f_{w.leaf}", F.col(f"n_{w.leaf}"))
            else:
                groups.setdefault((tuple(sorted(self.roles(w.leaf))), w.leaf if after else None), []).append((w.leaf, after))
        last = F.struct(F.col("l_t").alias("t"), F.col("l_seq").alias("seq"))
        for (roles, _), own in groups.items():
            opens = [F.struct(x.cast("long").alias("t"), F.lit(-NEVER).alias("seq")) for x in own[0][1]]
            since = F.greatest(last, *opens) if opens else last
            leaves, early = [k for k, _ in own], [F.col(f"e_{k}") for k, _ in own if f"e_{k}" in rows.columns]
            if len(early) < len(leaves):
                out = self.next_of(out, since["t"], since["seq"], roles, leaves, "f_")
                continue
            # the first match after an earlier one, if it comes later than `since`, is the first after that
            self.copies[state] *= 2
            right = F.coalesce(_both([F.struct(e["m_t"].alias("t"), e["m_seq"].alias("seq")) > since for e in early]), F.lit(False))
            out = out.where(right).withColumns({f"f_{k}": F.col(f"e_{k}") for k in leaves}).unionByName(self.next_of(out.where(~right), since["t"], since["seq"], roles, leaves, "f_"))
        return out.withColumns({f"f_{w.leaf}": F.when(F.col(f"f_{w.leaf}.m_t") <= w.until, F.col(f"f_{w.leaf}")) for w in waits if w.until is not None})

    def weighed(self, state: State, rows: DataFrame, plain: list[Wait], binding: list[Wait]) -> tuple[DataFrame, list[tuple[State, DataFrame]]]:
        """The same where one match can fit leaves of both sorts: it uses a candidate up only if it fits none that binds,
        and none that is being sustained."""
        rows = rows.drop(*(c for c in rows.columns if c[:2] in ("n_", "e_")))
        columns = rows.columns
        rows = written(rows.withColumn("cid", F.monotonically_increasing_id()), "state")
        parts = [self.joined(rows, [w], state).withColumn("keeps", F.lit(w in binding)) for w in (*plain, *binding)]
        for w in plain:
            if w.leaf in state.begun:
                early = self.joined(rows, [w], State(state.met, frozenset()))
                parts.append(early.where(F.col("m_t") < F.col(f"b_{w.leaf}") + self.durations[w.leaf]).withColumns({"leaf": F.lit(-1), "keeps": F.lit(True)}))
        found = [p.select("cid", "leaf", "m_t", "m_seq", "keeps", *(c for c in p.columns if c.startswith("m_r_"))) for p in parts]
        fits = written(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), "fits")
        uses = fits.groupBy("cid", "m_t", "m_seq").agg(F.max("keeps").alias("keeps")).where("NOT keeps")
        star = uses.groupBy("cid").agg(F.min(F.struct("m_t", "m_seq")).alias("star"))
        live = fits.join(star, "cid", "left").where(F.col("star").isNull() | (F.struct("m_t", "m_seq") <= F.col("star"))).drop("star", "keeps")
        live = written(live, "fits")
        return rows.join(star, "cid", "left"), [self.moved(rows.join(live.where(F.col("leaf") == w.leaf), "cid"), columns, state, w, []) for w in (*plain, *binding)]


def _echoes(said: Column, value: object) -> Column:
    """Whether an echoed literal, if there is one, equals the pattern's: numbers as numbers, truth values as such."""
    if isinstance(value, bool):
        same = F.lower(said) == str(value).lower()
    elif isinstance(value, int | float):
        same = F.coalesce(said.try_cast("double") == float(value), F.lit(False))
    else:
        same = said == str(value)
    return said.isNull() | same
