"""Query trees shared by the parsers, the printer, the compiler and the planner."""

from __future__ import annotations

from dataclasses import dataclass, field


class QueryError(ValueError):
    """A query that cannot be run; ``code`` says why in one word."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Setting:
    """Which nodes: by id, by type (with name, index or properties), or all."""

    ids: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    index: tuple[int, ...] = ()
    props: tuple[tuple[str, str], ...] = ()
    not_types: tuple[str, ...] = ()


@dataclass(frozen=True)
class EdgeType:
    type: str
    reverse: bool = False
    names: tuple[str, ...] = ()
    index: tuple[int, ...] = ()


@dataclass(frozen=True)
class Follow:
    """``t`` one hop, ``?`` at most one, ``*`` any number."""

    kind: str
    edges: tuple[EdgeType, ...]


@dataclass(frozen=True)
class Linear:
    follows: tuple[Follow, ...]


@dataclass(frozen=True)
class NodeCheck:
    setting: Setting


@dataclass(frozen=True)
class Repeated:
    follow: tuple[Follow, ...]
    repeat: tuple[Follow, ...]


Traverse = Linear | NodeCheck | Repeated


@dataclass(frozen=True)
class Graph:
    root: Setting
    traverses: tuple[Traverse, ...] = ()
    file: str | None = None


@dataclass(frozen=True)
class Trace:
    source: str
    traverses: tuple[Traverse, ...]
    name: str
    left: bool = False


@dataclass(frozen=True)
class Column:
    name: str


@dataclass(frozen=True)
class Member:
    column: str
    member: str
    alias: str | None = None


@dataclass(frozen=True)
class Call:
    """CAT, PATHCAT, COUNT or COLLECT."""

    function: str
    args: tuple
    alias: str | None = None

    @property
    def aggregate(self) -> bool:
        return self.function in ("COUNT", "COLLECT")


@dataclass(frozen=True)
class Relational:
    items: tuple
    graph: Graph
    root: str
    traces: tuple[Trace, ...] = ()
    having: tuple[tuple[str, bool], ...] = ()
    having_or: tuple[tuple[str, bool], ...] = ()
    intersect: tuple[tuple[str, ...], ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    offset: int | None = None
    limit: int | None = None
    scroll: tuple[tuple[str, tuple[str, ...]], ...] = ()
    ordering: tuple[str, ...] = ()


@dataclass(frozen=True)
class Clause:
    """A logic clause: a node predicate of one variable or an edge predicate of two."""

    predicate: str
    variables: tuple[str, ...]
    names: tuple[str, ...] = ()
    index: int | None = None
    props: tuple[tuple[str, str], ...] = ()
    optional: bool = False


@dataclass(frozen=True)
class Logic:
    clauses: tuple[Clause, ...]
    aliases: tuple[tuple[str, str], ...] = ()
    root: str | None = None
    select: tuple = field(default=())
