"""The exact matcher: candidates of one event, advanced match by match in (time, arrival) order.

It is the small per-key helper of the grouped batch plan and of the streaming operator, and what compiled plans are
tested against. A candidate is its seed, its bindings and the times of its leaves; everything else, such as which
leaves wait and until when, is a function of these and of the time.
"""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from wayline.plans.events import Event, Pattern, class_matches

MS = 1000
PENDING, DONE, FAILED = "pending", "done", "failed"


class Match(NamedTuple):
    t: int
    seq: int
    predicate: str
    source: str | None
    confidence: float
    arguments: dict[str, str]
    classes: dict[str, str]


class Waiting(NamedTuple):
    leaf: int
    until: int | None
    sustained: bool


@dataclass(frozen=True)
class Candidate:
    seed_t: int
    seed_leaf: int
    seed_source: str | None
    bindings: tuple[tuple[str, str], ...] = ()
    #: leaf -> when it was satisfied
    hits: tuple[tuple[int, int], ...] = ()
    #: sustained leaf -> when its evidence began
    since: tuple[tuple[int, int], ...] = ()


class Completion(NamedTuple):
    matched_at: int
    completed_at: int
    matched_source: str | None
    bindings: dict[str, str]
    predicate: str


def echoes(said: str | None, value: object) -> bool:
    """Whether an echoed literal equals the pattern's: numbers as numbers, truth values as such."""
    if said is None:
        return True
    if isinstance(value, bool):
        return said.lower() == str(value).lower()
    if isinstance(value, int | float):
        try:
            return float(said) == float(value)
        except ValueError:
            return False
    return said == str(value)


@dataclass
class Matcher:
    event: Event
    #: Matches come in order, so a repeat can only be of the present time.
    in_order: bool = False
    late: int = 0
    expired: int = 0
    candidates: list[Candidate] = field(default_factory=list)
    seen: set = field(default_factory=set)
    #: (path of the node, why) -> candidates that it was the first to end
    failures: Counter = field(default_factory=Counter)

    def __post_init__(self) -> None:
        self.leaves = list(self.event.pattern.leaves())
        self._numbered: dict[int, tuple[int, ...]] = {}
        self._paths: dict[int, str] = {}
        self._number(self.event.pattern, 0, "")
        self.first = self._seeds(self.event.pattern)
        self.clock: int | None = None

    def _number(self, node: Pattern, at: int, path: str) -> int:
        """Each node's own leaves, as a range of numbers; by identity, as equal leaves may occur twice."""
        start = at
        self._paths[id(node)] = path
        if node.op == "leaf":
            at += 1
        kids = []
        for k, child in enumerate(node.children):
            kids.append(at)
            at = self._number(child, at, f"{path}.{k}" if path else str(k))
        self._numbered[id(node)] = (start, *kids)
        return at

    def _seeds(self, node: Pattern, sustained: bool = False) -> list[tuple[int, bool]]:
        if node.op == "leaf":
            return [(self._numbered[id(node)][0], sustained)]
        some = node.children[:1] if node.op in ("seq", "within", "for") else node.children
        # a node object may stand at two places only if the definition was built so; parse_pattern never does
        return [x for child in some for x in self._seeds(child, node.op == "for")]

    # what a candidate waits for

    def state(self, c: Candidate, now: int) -> tuple[str, int | None, list[Waiting]]:
        return self._state(self.event.pattern, 0, c.seed_t, now, None, dict(c.hits), dict(c.since))

    def _state(self, node, at, active, now, until, hits, since):
        """Status, time, and what is waited for; in place of that, where a node has failed, the first path and reason."""
        start = self._numbered[id(node)]
        failed = lambda why: (FAILED, None, [(self._paths[id(node)], why)])
        if node.op == "leaf":
            return (DONE, hits[start[0]], []) if start[0] in hits else (PENDING, None, [Waiting(start[0], until, False)])
        if node.op == "for":
            leaf = start[1]
            if leaf in hits:
                return DONE, hits[leaf], []
            return failed("window of an ancestor") if until is not None and now > until else (PENDING, None, [Waiting(leaf, until, True)])
        sub = lambda k, a, u: self._state(node.children[k], start[1 + k], a, now, u, hits, since)
        if node.op == "seq":
            for k in range(len(node.children)):
                status, t, waits = sub(k, active, until)
                if status != DONE:
                    return status, None, waits
                active = t
            return DONE, active, []
        if node.op == "within":
            opens, closes = active + node.least_ms * MS, active + node.most_ms * MS
            until = closes if until is None else min(until, closes)
            if now < opens:
                return PENDING, None, []
            status, t, waits = sub(0, opens, until)
            if status == DONE and opens <= t <= closes:
                return DONE, t, []
            if status == FAILED:
                return FAILED, None, waits
            return failed("window") if now > closes else (PENDING, None, waits)
        parts = [sub(k, active, until) for k in range(len(node.children))]
        times = sorted(t for status, t, _ in parts if status == DONE)
        waits = [w for status, _, ws in parts if status == PENDING for w in ws]
        need = {"all": len(parts), "any": 1, "k_of_n": node.k}[node.op]
        broken = next((ws for status, _, ws in parts if status == FAILED), None)
        if node.op == "all" and broken is not None:
            return FAILED, None, broken
        if len(times) >= need:
            return DONE, times[need - 1], []
        if len(times) + sum(status == PENDING for status, _, _ in parts) < need:
            return failed("too few left")
        if times and node.op != "any":
            closes = times[0] + node.most_ms * MS
            until = closes if until is None else min(until, closes)
            if now > until:
                return failed("window for the rest")
            waits = [w._replace(until=until if w.until is None else min(w.until, until)) for w in waits]
        return PENDING, None, waits

    # what a match does to it

    def bound(self, leaf: Pattern, m: Match, bindings: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...] | None:
        """The bindings after the match, None if it does not fit."""
        if leaf.predicate != m.predicate:
            return None
        own = dict(bindings)
        for argument, role in leaf.roles:
            who = m.arguments.get(argument)
            if not who or argument in m.classes and not class_matches(self.event.roles[role], m.classes[argument]):
                return None
            if role in own:
                if own[role] != who:
                    return None
            elif who in own.values():
                return None
            else:
                own[role] = who
        for argument, value in leaf.literals:
            if argument in m.arguments and not echoes(m.arguments[argument], value):
                return None
            if argument == "minimum_confidence" and m.confidence < value:
                return None
        return tuple(sorted(own.items()))

    def _hit(self, c: Candidate, leaf: int, sustained: bool, t: int, bindings) -> Candidate:
        if sustained:
            began = dict(c.since).get(leaf)
            if began is None:
                return replace(c, bindings=bindings, since=tuple(sorted((*c.since, (leaf, t)))))
            if t - began < self._duration(leaf):
                return replace(c, bindings=bindings)
        return replace(c, bindings=bindings, hits=tuple(sorted((*c.hits, (leaf, t)))))

    def _duration(self, leaf: int) -> int:
        def find(node: Pattern) -> int | None:
            if node.op == "for" and self._numbered[id(node)][1] == leaf:
                return node.least_ms * MS
            return next((x for c in node.children if (x := find(c)) is not None), None)

        return find(self.event.pattern)

    def feed(self, m: Match) -> list[Completion]:
        """Advance and seed candidates by one match; the occurrences that it completes."""
        key = ("m", m.predicate, m.t, m.source, tuple(sorted(m.arguments.items())))
        if key in self.seen:
            return []
        self.seen.add(key)
        self.late += self.clock is not None and m.t < self.clock
        if self.in_order and self.clock is not None and m.t > self.clock and len(self.seen) > 2 * len(self.candidates) + 1000:
            self.forget_before(m.t)
            self.seen.add(key)
        self.clock = m.t if self.clock is None else max(self.clock, m.t)
        kept, grown = [], []
        for c in self.candidates:
            status, _, why = self.state(c, self.clock)
            if status == FAILED:
                self._failed(why)
                continue
            branches = []
            if m.t >= c.seed_t:
                _, _, waits = self.state(c, m.t)
                for w in waits:
                    fits = self.bound(self.leaves[w.leaf], m, c.bindings) if w.until is None or m.t <= w.until else None
                    if fits is not None:
                        branches.append(self._hit(c, w.leaf, w.sustained, m.t, fits))
            # a match that binds a new object leaves the candidate open for others; any other match uses it up
            if not branches or any(len(b.bindings) > len(c.bindings) for b in branches):
                kept.append(c)
            grown += branches
        for leaf, sustained in self.first:
            fits = self.bound(self.leaves[leaf], m, ())
            seed = ("s", leaf, m.t, m.source, fits)
            if fits is not None and seed not in self.seen:
                self.seen.add(seed)
                grown.append(self._hit(Candidate(m.t, leaf, m.source), leaf, sustained, m.t, fits))
        out = []
        for c in grown:
            status, t, why = self.state(c, m.t)
            if status == DONE:
                occurrence = ("c", c.seed_leaf, c.seed_t, c.seed_source, c.bindings)
                if occurrence not in self.seen:
                    self.seen.add(occurrence)
                    out.append(Completion(c.seed_t, t, c.seed_source, dict(c.bindings), self.leaves[c.seed_leaf].predicate))
            elif status == FAILED:
                self._failed(why)
            else:
                kept.append(c)
        self.candidates = kept
        return out

    def _failed(self, why: list[tuple[str, str]]) -> None:
        self.expired += 1
        self.failures[why[0]] += 1

    def forget_before(self, t: int) -> None:
        """Drop candidates that have failed by then, and what only matches older than t could repeat.

        Occurrences stay known as long as a candidate of their seed is open.
        """
        kept = []
        for c in self.candidates:
            status, _, why = self.state(c, t)
            if status == FAILED:
                self._failed(why)
            else:
                kept.append(c)
        self.candidates = kept
        seeds = {(c.seed_leaf, c.seed_t) for c in kept}
        self.seen = {k for k in self.seen if k[2] >= t or k[0] == "c" and (k[1], k[2]) in seeds}

    def idle(self) -> bool:
        """Whether nothing but the clock would be lost with the state."""
        return not self.candidates and not self.seen

    def dump(self) -> bytes:
        return pickle.dumps((self.late, self.expired, self.candidates, self.seen, self.clock, self.failures))

    def load(self, state: bytes) -> Matcher:
        self.late, self.expired, self.candidates, self.seen, self.clock, self.failures = pickle.loads(state)
        return self
