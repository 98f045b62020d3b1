"""Predicates of the logic language: node types, and edges with costs and paths."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..lang.tree import EdgeType, Follow, QueryError


@dataclass(frozen=True)
class NodePredicate:
    types: tuple[str, ...] = ()
    negated: bool = False
    quoted: bool = False


@dataclass(frozen=True)
class EdgePredicate:
    """``condition`` is the number of the follow whose edge takes a name or index.

    ``measured``: each node of ``from_types`` has about ``forward`` edges however many there are, so the way
    back costs what the numbers of nodes at both ends give, and not ``backward``.
    """

    forward: int
    backward: int
    path: tuple[Follow, ...]
    condition: int | None = None
    from_types: tuple[str, ...] = ()
    to_types: tuple[str, ...] = ()
    must_specify: bool = False
    repeated: bool = False
    fixed_index: int | None = None
    measured: bool = False

    def follows(self, names=(), index=None) -> tuple[Follow, ...]:
        index = index if index is not None else self.fixed_index
        if self.condition is None or not names and index is None:
            return self.path
        out = list(self.path)
        f = out[self.condition]
        out[self.condition] = Follow(f.kind, tuple(replace(e, names=tuple(names), index=() if index is None else (index,)) for e in f.edges))
        return tuple(out)


@dataclass(frozen=True)
class Registry:
    nodes: dict[str, NodePredicate]
    edges: dict[str, EdgePredicate]

    def node(self, name: str) -> NodePredicate:
        if name in self.nodes:
            return self.nodes[name]
        raise QueryError("invalid.predicate", f"no node predicate {name}")

    def edge(self, name: str) -> EdgePredicate:
        if name in self.edges:
            return self.edges[name]
        raise QueryError("invalid.predicate", f"no edge predicate {name}")


def _path(text: str, kinds: dict[str, str], follow: tuple[str, ...]) -> tuple[tuple[Follow, ...], int | None]:
    """``t:method-function t:function-argument!``: kind, edge and (!) the one with the condition."""
    out, condition = [], None
    for n, word in enumerate(text.split()):
        kind, name = word.split(":")
        if name.endswith("!"):
            name, condition = name[:-1], n
        edges = follow if name == "follows" else (name,)
        # an edge table's "match side" says which end the written direction starts from
        out.append(Follow(kind, tuple(EdgeType(e, kinds.get(e) == "to") for e in edges)))
    return tuple(out), condition


_JS_NODES = """class class|class-property class-property|class-method method|instance instance|require require|function function|function-arg function-arg|return return|yield yield|await await
throw throw|binary-expression binary-exp|unary-expression unary-exp|if if|literal literal|this this|super super|jsx-element jsx-element|identifier identifier-ref|array array|object object
object-property object-prop|jsx-attribute jsx-attribute|call call|member member|template-literal template-literal|template-expression template-expression"""
_RUBY_NODES = "cbase cbase|const const|cnull cnull|send send|snull snull|keyword keyword-literal|string str|number number|array array|hash hash|hash_pair pair"
_GENERIC_NODES = "table row cell schema schema-column snapshot snapshot-row snapshot-cell snapshot-cell-data annotation git-commit git-head code-index"

# name, forward cost, backward cost, from types, to types, path, flags
_JS_EDGES = """jsx_tag 1 1 jsx-element - t:jsx-tag
jsx_attribute 5 1 jsx-element jsx-attribute t:jsx-attribute!
jsx_attribute_value 1 1 jsx-attribute - t:jsx-attribute-value
jsx_child 10 1 jsx-element - t:jsx-child
class_extends 1 1 class - t:super-class
instance_of 1 1 instance - t:class
instance_arg 5 1 instance - t:argument!
class_constructor 1 1 class method t:constructor!
class_method 10 1 class method t:method!
class_decorator 2 1 class - t:class-decorator
class_property 10 1 class class-property t:class-property!
class_property_value 1 1 class-property - t:class-property-value
method_arg 5 1 method function-arg t:method-function,t:function-argument!
method_decorator 2 1 method - t:method-decorator
method_contains 1000 1 method - t:method-function,t:function-contains must
function_arg 5 1 function function-arg t:function-argument!
function_contains 1000 1 function - t:function-contains must
return 1 1 return - t:return
yield 1 1 yield - t:yield
await 1 1 await - t:await
throw 1 1 throw - t:throw
member 1 1 - member *:follows,t:member!
call 1 1 - call *:follows,t:call
call_arg 5 1 call - t:argument!
if_condition 1 1 if - t:if-block,t:if-test
if_body 1000 1 if - t:if-block,t:if-contains must
binary_left 1 1 binary-exp - t:basic-exp! index=0
binary_right 1 1 binary-exp - t:basic-exp! index=1
unary_expression 1 1 unary-exp - t:basic-exp
array_member 10 1 array - t:array-member!
object_property 10 1 object object-prop t:object-prop!
object_property_value 1 1 object-prop - t:object-value!
template_component 5 1 template-literal - t:template-literal!
template_contains 100 1 template-expression - t:template-contains
contains 1000 1 method|function - ?:method-function,t:function-contains must
call_link 1 10 call method|function t:call-link
all_called 100000 1 method|function method|function ?:method-function,t:function-contains,t:call-link repeated"""
_RUBY_EDGES = """const 10 1 - const t:const!
send 10 1 - send t:send-object!
send_arg 10 1 send - t:send-arg!
array_element 10 1 array - t:array-element!
hash_element 10 1 hash - t:hash-element!
pair_value 10 1 pair - t:pair-value!"""

_JS_TO = ("declare", "assignment", "reference", "argument", "call", "member", "function-return", "basic-exp")
_RUBY_TO = ("const", "send-object", "assignment", "reference")


def _edges(text: str, language: str, to_side: tuple[str, ...], follow: tuple[str, ...]) -> dict[str, EdgePredicate]:
    out = {}
    for line in text.splitlines():
        name, forward, backward, a, b, path, *flags = line.split()
        steps, condition = _path(path.replace(",", " "), dict.fromkeys(to_side, "to"), follow)
        types = [() if x == "-" else tuple(x.split("|")) for x in (a, b)]
        fixed = next((int(f[6:]) for f in flags if f.startswith("index=")), None)
        out[f"{language}::{name}"] = EdgePredicate(int(forward), int(backward), steps, condition, *types, "must" in flags, "repeated" in flags, fixed)
    return out


def code_registry() -> Registry:
    """Predicates over code graphs of JavaScript and Ruby, and over generic graphs."""
    nodes = {f"javascript::{n}": NodePredicate((t,)) for n, t in (x.split() for x in _JS_NODES.replace("\n", "|").split("|"))}
    nodes |= {f"ruby::{n}": NodePredicate((t,)) for n, t in (x.split() for x in _RUBY_NODES.split("|"))}
    nodes |= {f"generic::{n}": NodePredicate((n,)) for n in _GENERIC_NODES.split()}
    nodes |= {"javascript::literal-string": NodePredicate(("literal",), quoted=True), "javascript::not-identifier-ref": NodePredicate(("identifier-ref",), negated=True), "javascript::any": NodePredicate(), "dep": NodePredicate(), "search": NodePredicate()}
    edges = _edges(_JS_EDGES, "javascript", _JS_TO, ("declare", "assignment", "reference")) | _edges(_RUBY_EDGES, "ruby", _RUBY_TO, ("assignment", "reference"))
    return Registry(nodes, edges)


def tabular_registry() -> Registry:
    """Predicates over the driver's tables, for the queries registered there."""
    nodes = {f"tables::{n}": NodePredicate((n,)) for n in ("region", "nation", "customer", "supplier", "part", "order", "event", "turn", "document")}
    t = lambda name: (Follow("t", (EdgeType(name),)),)
    edges = {
        "tables::in_region": EdgePredicate(1, 5, t("in_region"), None, ("nation",), ("region",), measured=True), "tables::cust_nation": EdgePredicate(1, 60, t("cust_nation"), 0, ("customer",), ("nation",), measured=True),
        "tables::supp_nation": EdgePredicate(1, 4, t("supp_nation"), None, ("supplier",), ("nation",), measured=True), "tables::placed": EdgePredicate(10, 1, t("placed"), 0, ("customer",), ("order",), measured=True),
        "tables::contains": EdgePredicate(4, 30, t("contains"), 0, ("order",), ("part",), measured=True), "tables::shipped_by": EdgePredicate(4, 600, t("shipped_by"), 0, ("order",), ("supplier",), measured=True),
        "tables::next_turn": EdgePredicate(1, 1, t("next_turn"), None, ("turn",), ("turn",)), "tables::later_turn": EdgePredicate(8, 8, t("next_turn"), None, ("turn",), ("turn",), repeated=True),
    }
    return Registry(nodes, edges)
