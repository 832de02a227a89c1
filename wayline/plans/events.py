"""Event definitions: typed roles and a pattern over predicates, checked as they are read."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

# The predicates' arguments with their types; a question mark makes one optional, 0..1 bounds it.
SIGNATURES = {
    "present": "object: visual_object, minimum_confidence?: number 0..1",
    "enters": "object: visual_object",
    "exits": "object: visual_object",
    "moving": "object: visual_object",
    "near": "object_a: visual_object, object_b: visual_object, max_distance_m?: number 0.., max_normalized_gap?: number 0..",
    "follows": "leader: visual_object, follower: visual_object, max_gap_m?: number 0..",
    "boards": "person: visual_object, vehicle: visual_object",
    "disembarks": "person: visual_object, vehicle: visual_object",
    "transfer": "item: visual_object, giver: visual_object, receiver: visual_object",
    "conversation": "participant_a: visual_object, participant_b: visual_object, max_distance_m?: number 0.., required_terms?: string",
    "audio_event": "class: audio_class, minimum_confidence?: number 0..1",
}
# What detectors call the members of a broader class, the audio classes, and which classes a predicate takes.
BROADER = {"vehicle": ("car", "motorcycle", "bus", "truck"), "package": ("backpack", "handbag", "suitcase")}
AUDIO_CLASSES = ("alarm", "gunshot")
_VEHICLES = ("vehicle", *BROADER["vehicle"])
TAKES = {
    ("boards", "person"): ("person",),
    ("boards", "vehicle"): _VEHICLES,
    ("disembarks", "person"): ("person",),
    ("disembarks", "vehicle"): _VEHICLES,
    ("transfer", "item"): ("package", *BROADER["package"]),
    ("transfer", "giver"): ("person", *_VEHICLES),
    ("transfer", "receiver"): ("person", *_VEHICLES),
    ("conversation", "participant_a"): ("person",),
    ("conversation", "participant_b"): ("person",),
}
# The class names of the usual 80-class detector vocabulary.
CLASSES = frozenset(
    "person,bicycle,car,motorcycle,airplane,bus,train,truck,boat,traffic light,fire hydrant,stop sign,parking meter,bench,bird,cat,dog,horse,sheep,cow,elephant,"
    "bear,zebra,giraffe,backpack,umbrella,handbag,tie,suitcase,frisbee,skis,snowboard,sports ball,kite,baseball bat,baseball glove,skateboard,surfboard,"
    "tennis racket,bottle,wine glass,cup,fork,knife,spoon,bowl,banana,apple,sandwich,orange,broccoli,carrot,hot dog,pizza,donut,cake,chair,couch,potted plant,"
    "bed,dining table,toilet,tv,laptop,mouse,remote,keyboard,cell phone,microwave,oven,toaster,sink,refrigerator,book,clock,vase,scissors,teddy bear,hair drier,toothbrush".replace(" ", "_").split(",")
) | BROADER.keys()

#: How long all and k_of_n wait for the rest once one child is complete.
JOIN_WINDOW_MS = 5 * 60 * 1000

_NAME, _ROLE = re.compile(r"[a-z][a-z0-9_]*"), re.compile(r"[A-Z][A-Z0-9_]*")
_DURATION = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ms|s|m|h)")
_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


class EventError(ValueError):
    """All that is wrong with a definition, one line each."""


@dataclass(frozen=True)
class Pattern:
    """A node: `leaf` with a predicate and its arguments, or an operator over children."""

    op: str
    children: tuple[Pattern, ...] = ()
    predicate: str = ""
    #: argument -> role
    roles: tuple[tuple[str, str], ...] = ()
    #: argument -> literal
    literals: tuple[tuple[str, Any], ...] = ()
    k: int = 0
    least_ms: int = 0
    most_ms: int = 0

    def leaves(self) -> Iterator[Pattern]:
        if self.op == "leaf":
            yield self
        for child in self.children:
            yield from child.leaves()

    def role_names(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(r for leaf in self.leaves() for _, r in leaf.roles))


@dataclass(frozen=True)
class Event:
    name: str
    roles: Mapping[str, str]
    pattern: Pattern
    description: str = ""
    version: int = 1
    predicates: Mapping[str, str] = field(default_factory=lambda: SIGNATURES)

    def common_roles(self) -> tuple[str, ...]:
        """Roles that every leaf carries: matches of different objects there never meet."""
        leaves = list(self.pattern.leaves())
        return tuple(r for r in self.pattern.role_names() if all(r in dict(x.roles).values() for x in leaves))


def longest_ms(pattern: Pattern) -> int | None:
    """How long after its seed a candidate can still become complete, at most; None if there is no bound."""

    def after(node: Pattern) -> int | None:
        """From a node's activation."""
        if node.op == "within":
            return node.least_ms + node.most_ms
        parts = [after(c) for c in node.children]
        if node.op in ("leaf", "for") or None in parts:
            return None
        return sum(parts) if node.op == "seq" else max(parts)

    def seeded(node: Pattern) -> int | None:
        if node.op == "leaf":
            return 0
        if node.op == "within":
            return node.most_ms
        if node.op == "seq":
            parts = [seeded(node.children[0]), *map(after, node.children[1:])]
            return None if None in parts else sum(parts)
        if node.op == "for":
            return None
        parts = [seeded(c) for c in node.children]
        if node.op == "any" or None in parts:
            return None if None in parts else max(parts)
        # the first child that is complete opens the window for the rest
        return max(parts) + node.most_ms

    return seeded(pattern)


def duration_ms(value: Any) -> int:
    found = _DURATION.fullmatch(value) if isinstance(value, str) else None
    if not found:
        raise EventError(f"{value!r} is no duration: a number with ms, s, m or h, in quotes")
    ms = Decimal(found[1]) * _UNITS[found[2]]
    if ms != int(ms):
        raise EventError(f"{value!r} is not a whole number of milliseconds")
    return int(ms)


def class_matches(expected: str, observed: str) -> bool:
    return expected == observed or observed in BROADER.get(expected, ()) or (expected in CLASSES and observed.strip().lower().replace(" ", "_") == expected)


def load_event(path: str) -> Event:
    import yaml

    with open(path, encoding="utf-8") as f:
        document = yaml.safe_load(f)
    return parse_event(document.get("event") if isinstance(document, Mapping) and isinstance(document.get("event"), Mapping) else document)


def parse_event(document: Any, predicates: Mapping[str, str] = SIGNATURES, classes: frozenset[str] | None = CLASSES) -> Event:
    """An event from a parsed YAML document. classes: the vocabulary that roles may use, None for any."""
    if not isinstance(document, Mapping):
        raise EventError("an event is a mapping")
    wrong = [f"unknown field {k!r}" for k in document if k not in ("version", "event", "description", "roles", "pattern")]
    if document.get("version", 1) != 1 or isinstance(document.get("version", 1), bool):
        wrong.append("version must be 1")
    name, roles = document.get("event"), document.get("roles") or {}
    if not isinstance(name, str) or not _NAME.fullmatch(name):
        wrong.append(f"event name {name!r} is not a lower-case identifier")
    if not isinstance(document.get("description", ""), str):
        wrong.append("description must be text")
    types: dict[str, str] = {}
    if not isinstance(roles, Mapping):
        wrong.append("roles is a mapping")
        roles = {}
    for role, spec in roles.items():
        kind = spec.get("class") if isinstance(spec, Mapping) and set(spec) == {"class"} else None
        if not isinstance(role, str) or not _ROLE.fullmatch(role):
            wrong.append(f"role {role!r} is not an upper-case identifier")
        elif not isinstance(kind, str) or not _NAME.fullmatch(kind):
            wrong.append(f"role {role} needs exactly a class, a lower-case identifier")
        else:
            types[role] = kind
            if classes is not None and kind not in classes:
                wrong.append(f"role {role}: no detector knows the class {kind!r}")
    pattern = None
    try:
        pattern = parse_pattern(document.get("pattern"), types, predicates, classes is not None)
    except EventError as e:
        wrong.append(str(e))
    if wrong:
        raise EventError("\n".join(wrong))
    return Event(name, types, pattern, document.get("description", ""), 1, predicates)


def parse_pattern(node: Any, roles: Mapping[str, str], predicates: Mapping[str, str] = SIGNATURES, closed: bool = True) -> Pattern:
    if not isinstance(node, Mapping) or len(node) != 1:
        raise EventError(f"a pattern is a mapping with one key, not {node!r}")
    (op, body), = node.items()
    inner = lambda x: parse_pattern(x, roles, predicates, closed)
    if op in ("seq", "all", "any"):
        return Pattern(op, _children(op, body, inner), most_ms=JOIN_WINDOW_MS if op == "all" else 0)
    if op == "k_of_n":
        _fields(op, body, {"k", "patterns"}, {"k", "patterns"})
        children, k = _children(op, body["patterns"], inner), body["k"]
        if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= len(children):
            raise EventError(f"k_of_n: k must be from 1 to {len(children)}, not {k!r}")
        return Pattern(op, children, k=k, most_ms=JOIN_WINDOW_MS)
    if op == "within":
        _fields(op, body, {"min", "max", "pattern"}, {"max", "pattern"})
        least, most = duration_ms(body["min"]) if "min" in body else 0, duration_ms(body["max"])
        if least > most:
            raise EventError("within: min is more than max")
        return Pattern(op, (inner(body["pattern"]),), least_ms=least, most_ms=most)
    if op == "for":
        _fields(op, body, {"duration", "pattern"}, {"duration", "pattern"})
        child = inner(body["pattern"])
        if child.op != "leaf":
            raise EventError("for: only a predicate can be sustained")
        return Pattern(op, (child,), least_ms=duration_ms(body["duration"]))
    if op not in predicates:
        raise EventError(f"unknown predicate or operator {op!r}")
    return _leaf(op, body, roles, predicates[op], closed)


def _fields(op: str, body: Any, known: set[str], needed: set[str]) -> None:
    if not isinstance(body, Mapping) or set(body) - known or needed - set(body):
        raise EventError(f"{op} takes the fields {', '.join(sorted(known))} and needs {', '.join(sorted(needed))}")


def _children(op: str, body: Any, inner) -> tuple[Pattern, ...]:
    if not isinstance(body, list) or len(body) < 2:
        raise EventError(f"{op} takes a list of two patterns or more")
    return tuple(map(inner, body))


def signature(text: str) -> dict[str, tuple[str, bool, str]]:
    """argument -> (type, needed, bounds)."""
    out = {}
    for part in text.split(", "):
        name, _, kind = part.partition(": ")
        base, _, bounds = kind.partition(" ")
        out[name.rstrip("?")] = base, not name.endswith("?"), bounds
    return out


def _leaf(name: str, body: Any, roles: Mapping[str, str], text: str, closed: bool) -> Pattern:
    if not isinstance(body, Mapping):
        raise EventError(f"{name} takes a mapping of arguments")
    specs, wrong = signature(text), []
    wrong += [f"{name}: unknown argument {a!r}" for a in body if a not in specs]
    wrong += [f"{name}: argument {a!r} is missing" for a, (_, needed, _) in specs.items() if needed and a not in body]
    bound, literals = [], []
    for argument, value in body.items():
        kind, _, bounds = specs.get(argument, ("", False, ""))
        if kind == "visual_object":
            if value not in roles:
                wrong.append(f"{name}.{argument}: {value!r} is not a declared role")
            elif closed and roles[value] not in TAKES.get((name, argument), (roles[value],)):
                wrong.append(f"{name}.{argument} does not take the class {roles[value]!r} of {value}")
            bound.append((argument, value))
        elif kind == "audio_class":
            if not isinstance(value, str) or closed and value not in AUDIO_CLASSES:
                wrong.append(f"{name}.{argument}: no classifier knows {value!r}")
            literals.append((argument, value))
        elif kind:
            fits = {"string": isinstance(value, str), "boolean": isinstance(value, bool), "integer": isinstance(value, int) and not isinstance(value, bool), "number": isinstance(value, int | float) and not isinstance(value, bool)}
            low, _, high = bounds.partition("..")
            if not fits[kind]:
                wrong.append(f"{name}.{argument}: {value!r} is not of type {kind}")
            elif low and value < float(low) or high and value > float(high):
                wrong.append(f"{name}.{argument}: {value!r} is outside {bounds}")
            literals.append((argument, value))
    repeated = [r for _, r in bound]
    if len(set(repeated)) < len(repeated):
        wrong.append(f"{name}: a role stands for two arguments")
    if wrong:
        raise EventError("\n".join(wrong))
    return Pattern("leaf", (), name, tuple(bound), tuple(literals))
