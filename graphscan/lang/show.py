"""Trees back to texts that parse to the same trees."""

from __future__ import annotations

from .tree import Call, Column, EdgeType, Follow, Graph, Linear, Logic, Member, NodeCheck, Relational, Setting


def _list(values, quote: bool = True) -> str:
    shown = [f'"{v}"' if quote else str(v) for v in values]
    return shown[0] if len(shown) == 1 else "[" + ",".join(shown) + "]"


def setting(s: Setting) -> str:
    if s.ids:
        return "{id:" + _list(s.ids) + "}"
    if not s.types and not s.not_types:
        return "{all}"
    parts = ["type:" + _list(s.types) if s.types else "not_type:" + _list(s.not_types)]
    if s.names:
        parts.append("name:" + _list(s.names))
    if s.index:
        parts.append("index:" + _list(s.index, False))
    if s.props:
        parts.append("props:{" + ",".join(f'"{k}":"{v}"' for k, v in s.props) + "}")
    return "{" + ",".join(parts) + "}"


def edge(e: EdgeType) -> str:
    kind = f'"{e.type}"' + ".reverse" * e.reverse
    more = (",name:" + _list(e.names) if e.names else "") + (",index:" + _list(e.index, False) if e.index else "")
    return "{type:" + kind + more + "}" if more else kind


def follows(fs: tuple[Follow, ...]) -> str:
    return ",".join(f"{f.kind}[{','.join(map(edge, f.edges))}]" for f in fs)


def traverses(steps) -> str:
    out = ""
    for step in steps:
        if isinstance(step, Linear):
            out += f".linear_traverse[{follows(step.follows)}]"
        elif isinstance(step, NodeCheck):
            out += ".node_check" + setting(step.setting)
        else:
            out += ".repeated_traverse{follow:[" + follows(step.follow) + "],repeat:[" + follows(step.repeat) + "]}"
    return out


def graph(g: Graph) -> str:
    return (f'%targeting(file="{g.file}") ' if g.file else "") + "root" + setting(g.root) + traverses(g.traverses)


def item(i) -> str:
    if isinstance(i, Column):
        return i.name
    shown = f"{i.column}.{i.member}" if isinstance(i, Member) else f"{i.function}({', '.join(map(item, i.args))})"
    return shown + (f" AS {i.alias}" if i.alias else "")


def relational(q: Relational) -> str:
    null = lambda n: f"{n[0]} {'IS_NOT_NULL' if n[1] else 'IS_NULL'}"
    parts = []
    if q.scroll:
        parts.append("%scroll(" + ",".join(f"{k}:[" + ",".join(f'"{v}"' for v in vs) + "]" for k, vs in q.scroll) + ")")
    if q.ordering:
        parts.append(f"%ordering({','.join(q.ordering)})")
    parts += ["SELECT " + ", ".join(map(item, q.items)), f"FROM {graph(q.graph)} AS {q.root}"]
    parts += [f"TRACE {'left_join' if t.left else 'join'}[{t.source}]{traverses(t.traverses)} AS {t.name}" for t in q.traces]
    parts += [f"HAVING {null(n)}" for n in q.having] + [f"HAVING_OR {null(n)}" for n in q.having_or]
    parts += ["INTERSECT " + ", ".join(names) for names in q.intersect]
    if q.order_by:
        parts.append("ORDER BY " + ", ".join(k + " DESC" * d for k, d in q.order_by))
    if q.offset is not None:
        parts.append(f"OFFSET {q.offset}")
    if q.limit is not None:
        parts.append(f"LIMIT {q.limit}")
    return "\n".join(parts)


def logic(q: Logic) -> str:
    out = []
    for c in q.clauses:
        shown = f"{c.predicate}({', '.join('?' if v.startswith('ANON') else v for v in c.variables)})"
        if c.index is not None:
            shown += f"[index={c.index}]"
        elif len(c.names) == 1:
            shown += f'[name="{c.names[0]}"]'
        elif c.names:
            shown += "[names={" + ",".join(f'"{n}"' for n in c.names) + "}]"
        if c.props:
            shown += "{" + ",".join(f'{k}="{v}"' for k, v in c.props) + "}"
        out.append(shown + "?" * c.optional + ".")
    out += [f"%alias({a}={b})." for a, b in q.aliases]
    if q.root:
        out.append(f"%root({q.root}).")
    if q.select:
        out.append(f"%SELECT({', '.join(map(item, q.select))}).")
    return "\n".join(out)
