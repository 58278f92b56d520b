"""Nodes of parsed queries and updates."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..terms import Term


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Quoted:
    """A statement used as a term: ``<< s p o >>``."""

    s: object
    p: object
    o: object


# --- expressions


@dataclass
class Call:
    """An operator, built-in function (upper case) or function IRI."""

    name: str
    args: list
    distinct: bool = False
    separator: str | None = None


@dataclass
class Exists:
    group: Group
    negated: bool = False


# --- paths


@dataclass(frozen=True)
class Path:
    """op: ``/`` ``|`` ``^`` ``rep`` (low, high or None) ``!`` (a negated set of (term, inverse))."""

    op: str
    parts: tuple
    low: int = 1
    high: int | None = 1


# --- patterns


@dataclass
class Triple:
    s: object
    p: object
    o: object
    hints: dict[str, str] = field(default_factory=dict)


@dataclass
class Filter:
    expr: object


@dataclass
class Bind:
    expr: object
    var: Var


@dataclass
class Values:
    names: list[Var]
    rows: list[list[Term | None]]


@dataclass
class Group:
    parts: list = field(default_factory=list)
    hints: dict[str, str] = field(default_factory=dict)


@dataclass
class Optional:
    group: Group


@dataclass
class Minus:
    group: Group


@dataclass
class Union:
    groups: list[Group]


@dataclass
class GraphPattern:
    graph: object
    group: Group


@dataclass
class Service:
    name: object
    group: Group
    silent: bool = False


@dataclass
class Include:
    name: str


@dataclass
class SubSelect:
    query: Query


# --- queries and updates


@dataclass
class Query:
    form: str
    where: Group
    select: list[tuple[Var, object]] | None = None
    distinct: bool = False
    reduced: bool = False
    template: list[Triple] = field(default_factory=list)
    describe: list = field(default_factory=list)
    default_graphs: list[Term] = field(default_factory=list)
    named_graphs: list[Term] = field(default_factory=list)
    group_by: list[tuple[object, Var | None]] = field(default_factory=list)
    having: list = field(default_factory=list)
    order_by: list[tuple[object, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    values: Values | None = None
    named: dict[str, Query] = field(default_factory=dict)
    hints: dict[str, str] = field(default_factory=dict)


@dataclass
class Quad:
    s: object
    p: object
    o: object
    g: object = None


@dataclass
class Update:
    """op: insert-data, delete-data, modify, load, clear, drop, create, add, move, copy, entailments."""

    op: str
    delete: list[Quad] = field(default_factory=list)
    insert: list[Quad] = field(default_factory=list)
    where: Group | None = None
    source: object = None
    target: object = None
    silent: bool = False
    using: list[Term] = field(default_factory=list)
    using_named: list[Term] = field(default_factory=list)
    with_graph: Term | None = None
    into: str | None = None
    query: Query | None = None
