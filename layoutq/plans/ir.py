"""What a model is made of. A predicate is a factory of Columns; applied to field names it is a rule; nodes hold rules and fields."""

from __future__ import annotations

import dataclasses
import uuid as _uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many candidates a rule is guessed to leave, for the order of joins.
LOW, MEDIUM, HIGH, ALL = 0.1, 0.3, 0.5, 1.0
LEAST_SCORE = 0.1
TYPES = ("Page", "Word", "Text", "Cluster", "Date", "DollarAmount", "TableCell", "TableRow", "Table", "Number", "Integer", "Time", "PersonName", "Address", "NamedEntity")


class Entity:
    """The entity assigned to a field, or any struct column of that shape."""

    def __init__(self, column: Column):
        self.column = column

    def __getattr__(self, name: str) -> Column:
        return self.column[name]

    @property
    def words(self) -> Column:
        """Text for text predicates: numbers that are 0 read as nothing."""
        c = self.column
        return F.when(c["type"].isin("Number", "Integer", "Time") & (c["value"] == 0), "").otherwise(F.coalesce(c["text"], F.lit("")))

    def box(self) -> dict[str, Column]:
        return {k: self.column[k] for k in ("x0", "x1", "y0", "y1")}


class Context:
    """Columns of the document beside its entities: median line height, box, pages and single words."""

    def __init__(self):
        self.mlh, self.x0, self.x1, self.y0, self.y1 = (F.col(f"ctx_{k}") for k in ("mlh", "x0", "x1", "y0", "y1"))
        self.pages, self.singles = F.col("ctx_pages"), F.col("ctx_words")


def new_uuid() -> str:
    return str(_uuid.uuid4())


@dataclass(frozen=True)
class Predicate:
    """``score(ctx, *entities)`` is a Column in [0, 1]; ``needed(ctx, *entities)`` are Columns that must hold where it is positive."""

    name: str
    degree: int | None
    score: Callable[..., Column] = field(compare=False, repr=False)
    needed: Callable[..., list[Column]] | None = field(default=None, compare=False, repr=False)
    leniency: float = MEDIUM
    params: dict = field(default_factory=dict, compare=False)
    uses: frozenset = frozenset()  # of "pages", "words"
    uuid: str = field(default_factory=new_uuid, compare=False)

    def __call__(self, *fields: str) -> Atom:
        if self.degree is not None and len(fields) != self.degree:
            raise ValueError(f"{self.name} takes {self.degree} fields, not {len(fields)}")
        if len(set(fields)) != len(fields):
            raise ValueError(f"{self.name} got a field twice: {fields}")
        return Atom(tuple(fields), self)

    def necessary(self, ctx: Context, *entities: Entity) -> list[Column]:
        return self.needed(ctx, *entities) if self.needed else []


class Rule:
    fields: tuple[str, ...]

    def atoms(self) -> list[Atom]:
        raise NotImplementedError


@dataclass(frozen=True)
class Atom(Rule):
    fields: tuple[str, ...]
    predicate: Predicate
    name: str | None = None
    uuid: str = field(default_factory=new_uuid, compare=False)

    def atoms(self) -> list[Atom]:
        return [self]


@dataclass(frozen=True)
class Connective(Rule):
    """kind "and": the product of its rules; "or": their maximum."""

    kind: str
    rules: tuple[Rule, ...]
    name: str | None = None
    uuid: str = field(default_factory=new_uuid, compare=False)

    def __post_init__(self):
        if not self.rules:
            raise ValueError("a connective needs rules")

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(f for r in self.rules for f in r.fields))

    def atoms(self) -> list[Atom]:
        return [a for r in self.rules for a in r.atoms()]


def all_rules_hold(*rules: Rule) -> Connective:
    return Connective("and", rules)


def any_rule_holds(*rules: Rule) -> Connective:
    return Connective("or", rules)


def pairwise(predicate: Predicate, fields: tuple[str, ...], kind: str = "and", ordered: bool = False) -> Rule:
    """The predicate on every pair of fields, in order."""
    if len(fields) < 2:
        raise ValueError(f"{predicate.name} takes two fields or more")
    pairs = [predicate(a, b) for i, a in enumerate(fields) for b in fields[i + 1 :]]
    return pairs[0] if len(pairs) == 1 else Connective(kind, tuple(pairs))


def flattened(rules) -> list[Rule]:
    """Conjunctions taken apart; disjunctions stay whole."""
    out: list[Rule] = []
    for r in rules:
        out += flattened(r.rules) if isinstance(r, Connective) and r.kind == "and" else [r]
    return out


@dataclass(frozen=True)
class Node:
    rules: tuple[Rule, ...] = ()
    name: str | None = None
    uuid: str = field(default_factory=new_uuid, compare=False)

    def fields(self) -> tuple[str, ...]:
        return ()

    def all_fields(self) -> tuple[str, ...]:
        return self.fields()

    def mass(self) -> int:
        return len(self.fields())

    def children_(self) -> tuple[Node, ...]:
        return ()

    def with_name(self, name: str) -> Node:
        return dataclasses.replace(self, name=name)

    def with_uuid(self, uuid: str) -> Node:
        return dataclasses.replace(self, uuid=uuid)

    def with_rules(self, *rules: Rule) -> Node:
        return dataclasses.replace(self, rules=tuple(rules))

    def with_extra_rules(self, *rules: Rule) -> Node:
        return dataclasses.replace(self, rules=self.rules + tuple(rules))


@dataclass(frozen=True)
class Empty(Node):
    pass


@dataclass(frozen=True)
class Pattern(Node):
    """All fields or none; fields that start with an underscore are hidden from parents."""

    types: dict[str, str] = field(default_factory=dict, hash=False)

    def fields(self) -> tuple[str, ...]:
        return tuple(f for f in self.types if not f.startswith("_"))

    def all_fields(self) -> tuple[str, ...]:
        return tuple(self.types)


@dataclass(frozen=True)
class Combine(Node):
    """Each child may stay empty, unless all_or_nothing; fields of different children share no word, unless allowed to."""

    children: tuple[Node, ...] = ()
    all_or_nothing: bool = False
    may_overlap: tuple[frozenset, ...] = ()

    def fields(self) -> tuple[str, ...]:
        return tuple(f for c in self.children for f in c.fields())

    def mass(self) -> int:
        return sum(c.mass() for c in self.children)

    def children_(self) -> tuple[Node, ...]:
        return self.children


@dataclass(frozen=True)
class Merge(Combine):
    """What model files call a combination."""


@dataclass(frozen=True)
class PickBest(Node):
    children: tuple[Node, ...] = ()

    def fields(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(f for c in self.children for f in c.fields()))

    def mass(self) -> int:
        return max((c.mass() for c in self.children), default=0)

    def children_(self) -> tuple[Node, ...]:
        return self.children


def extract(*rules: Rule, fields: tuple[str, ...] | None = None, field_types: dict[str, str] | None = None) -> Pattern:
    """A pattern over the fields of its rules; a field that is_date or is_dollar_amount is applied to has that type, others are Text."""
    names = tuple(dict.fromkeys([*(fields or ()), *(f for r in rules for f in r.fields), *(field_types or {})]))
    if not names:
        raise ValueError("a pattern needs fields")
    types = {f: "Text" for f in names}
    for r in flattened(rules):
        if isinstance(r, Atom) and r.predicate.name in ("is_date", "is_dollar_amount"):
            types[r.fields[0]] = {"is_date": "Date", "is_dollar_amount": "DollarAmount"}[r.predicate.name]
    return Pattern(tuple(rules), types=types | (field_types or {}))


def combine(*children: Node, rules: tuple[Rule, ...] = (), all_or_nothing: bool = False, allowed_to_overlap: tuple = ()) -> Node:
    if not children:
        return Empty()
    node = Combine(tuple(rules), children=children, all_or_nothing=all_or_nothing, may_overlap=tuple(frozenset(p) for p in allowed_to_overlap))
    validate(node)
    return node


def pick_best(*children: Node, rules: tuple[Rule, ...] = ()) -> Node:
    return PickBest(tuple(rules), children=children)


class ModelError(ValueError):
    pass


def validate(node: Node) -> None:
    """Raises ModelError for unknown or repeated fields, bad types and malformed ids."""
    try:
        _uuid.UUID(node.uuid)
    except ValueError:
        raise ModelError(f"not a UUID: {node.uuid}") from None
    if isinstance(node, Combine):
        seen: set[str] = set()
        for c in node.children:
            if both := seen & set(c.fields()):
                raise ModelError(f"children share fields: {sorted(both)}")
            seen |= set(c.fields())
    if isinstance(node, Pattern):
        for f, t in node.types.items():
            if t not in TYPES:
                raise ModelError(f"{f} has the unknown type {t}")
    known = set(node.all_fields())
    for r in node.rules:
        if more := set(r.fields) - known:
            raise ModelError(f"a rule is about unknown fields: {sorted(more)}")
    for c in node.children_():
        validate(c)


def distributed(node: Node, rules: tuple[Rule, ...] = ()) -> Node:
    """The same node with every rule at the lowest node that has all its fields. Alternatives keep none: a rule goes to each child that can decide it."""
    rules = tuple(rules) + node.rules
    if isinstance(node, (Combine, PickBest)):
        parts = tuple(flattened(rules)) if isinstance(node, PickBest) else rules
        own, children = list(parts), []
        for c in node.children:
            fits = tuple(r for r in parts if set(r.fields) <= set(c.fields()))
            own = [r for r in own if r not in fits]
            children.append(distributed(c, fits))
        return dataclasses.replace(node, rules=() if isinstance(node, PickBest) else tuple(own), children=tuple(children))
    return dataclasses.replace(node, rules=rules)
