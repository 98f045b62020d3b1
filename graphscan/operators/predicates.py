"""Conditions of the query languages as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.tree import EdgeType, QueryError, Setting

_ELSEWHERE = re.compile(r'(?<!\\)[~&@<>"]')


def text_match(value: Column, patterns: Sequence[str]) -> Column:
    """``/x/`` is a whole-string regular expression, ``*`` (and then ``?``) a wildcard, all else exact."""
    exact, others = [], []
    for raw in patterns:
        p = raw.strip()
        if len(p) > 1 and p.startswith("/") and p.endswith("/"):
            if _ELSEWHERE.search(p[1:-1]):
                raise QueryError("invalid.pattern", f"{p}: operators of another dialect")
            others.append(value.rlike(f"^(?:{p[1:-1]})$"))
        elif "*" in p:
            others.append(value.rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w\s])", r"\\\1", c) for c in p) + "$"))
        else:
            exact.append(p)
    if exact:
        others.append(value.isin(*exact))
    out = others[0]
    for o in others[1:]:
        out = out | o
    return out


def _has(key: str, values: Sequence[str]) -> Column:
    return F.exists("props", lambda p: (p["key"] == key) & p["value"].isin(*values))


def node_condition(s: Setting, single_names: bool = False) -> Column:
    """What a setting asks of node columns (types included).

    With ``single_names`` a node is found by its name alone, a plain column that scans can filter by.
    """
    out = F.lit(True)
    if s.ids:
        out = out & F.col("id").isin(*s.ids)
    if s.types:
        out = out & F.col("type").isin(*s.types)
    if s.not_types:
        out = out & ~F.col("type").isin(*s.not_types)
    if s.names:
        out = out & (text_match(F.col("name"), s.names) if single_names else F.exists("search_name", lambda x: text_match(x, s.names)))
    if s.index:
        out = out & F.col("index").isin(*s.index)
    by_key: dict[str, list[str]] = {}
    for k, v in s.props:
        by_key.setdefault(k, []).append(v)
    for k, vs in by_key.items():
        out = out & _has(k, vs)
    return out


def edge_condition(e: EdgeType) -> Column:
    out = F.lit(True)
    if e.names:
        out = out & text_match(F.col("name"), e.names)
    if e.index:
        out = out & F.col("index").isin(*e.index)
    return out


def edge_props(pairs: Sequence[tuple[str, str]]) -> Column:
    """Edges with any of the (key, value) pairs among their ``props``; no text of the languages asks for it."""
    wanted = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in pairs])
    return F.arrays_overlap("props", wanted)
