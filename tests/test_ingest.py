"""Code graphs from syntax trees, and logic queries over them."""

import json

import pytest
from graphscan.engine import Engine
from graphscan.ingest import index, javascript

TEXT = """import { Controller, Post as Send } from '@web/common'
@Controller('app')
class Greeter {
  constructor(private other: Other) {}
  @Send('/hello')
  async greet(name) {
    if (name) { this.other.call(name); }
    return true;
  }
}
function outer() { const inner = () => { throw new Greeter(); }; return inner; }
"""


def at(piece, ast, nth=0):
    """The tree with the place of a piece of the text."""
    start = -1
    for _ in range(nth + 1):
        start = TEXT.index(piece, start + 1)
    line = TEXT.count("\n", 0, start) + 1
    return ast | {"range": [start, start + len(piece)], "loc": {"start": {"line": line}, "end": {"line": line + piece.count("\n")}}}


def name(text, nth=0):
    return at(text, {"type": "Identifier", "name": text}, nth)


def call(piece, callee, *args):
    return at(piece, {"type": "CallExpression", "callee": callee, "arguments": list(args)})


def literal(raw, value):
    return at(raw, {"type": "Literal", "value": value, "raw": raw})


def tree():
    method = TEXT[TEXT.index("async greet") : TEXT.index("\n}\nfunction")]
    imports = at(TEXT.split("\n")[0], {"type": "ImportDeclaration", "source": literal("'@web/common'", "@web/common"), "specifiers": [
        at("Controller", {"type": "ImportSpecifier", "imported": name("Controller"), "local": name("Controller")}),
        at("Post as Send", {"type": "ImportSpecifier", "imported": name("Post"), "local": name("Send")}),
    ]})
    member = at("this.other", {"type": "MemberExpression", "object": at("this", {"type": "ThisExpression"}), "property": name("other", 1)})
    inner_call = call("this.other.call(name)", at("this.other.call", {"type": "MemberExpression", "object": member, "property": name("call")}), name("name", 2))
    greet = {"type": "FunctionExpression", "params": [name("name")], "body": {"type": "BlockStatement", "body": [
        at("if (name) { this.other.call(name); }", {"type": "IfStatement", "test": name("name", 1), "consequent": at("{ this.other.call(name); }", {"type": "BlockStatement", "body": [{"type": "ExpressionStatement", "expression": inner_call}]})}),
        at("return true;", {"type": "ReturnStatement", "argument": literal("true", True)}),
    ]}}
    build = {"type": "FunctionExpression", "params": [at("private other: Other", {"type": "TSParameterProperty", "parameter": name("other")})], "body": {"type": "BlockStatement", "body": []}}
    whole = TEXT[TEXT.index("class Greeter") : TEXT.index("\nfunction")]
    cls = at(whole, {"type": "ClassDeclaration", "id": name("Greeter"), "decorators": [{"type": "Decorator", "expression": call("Controller('app')", name("Controller", 1), literal("'app'", "app"))}], "body": {"type": "ClassBody", "body": [
        at("constructor(private other: Other) {}", {"type": "MethodDefinition", "kind": "constructor", "key": name("constructor"), "value": build}),
        at(method, {"type": "MethodDefinition", "kind": "method", "key": name("greet"), "value": at(method, greet), "decorators": [{"type": "Decorator", "expression": call("Send('/hello')", name("Send", 1), literal("'/hello'", "/hello"))}]}),
    ]}})
    arrow = at("() => { throw new Greeter(); }", {"type": "ArrowFunctionExpression", "params": [], "body": {"type": "BlockStatement", "body": [at("throw new Greeter();", {"type": "ThrowStatement", "argument": at("new Greeter()", {"type": "NewExpression", "callee": name("Greeter", 1), "arguments": []})})]}})
    outer = at(TEXT[TEXT.index("function outer") :].strip(), {"type": "FunctionDeclaration", "id": name("outer"), "params": [], "body": {"type": "BlockStatement", "body": [
        at("const inner", {"type": "VariableDeclaration", "declarations": [{"type": "VariableDeclarator", "id": name("inner"), "init": arrow}]}),
        at("return inner;", {"type": "ReturnStatement", "argument": name("inner", 1)}),
    ]}})
    return {"type": "Program", "body": [imports, cls, outer]}


@pytest.fixture(scope="module")
def code(spark):
    rows = [("k", "repo", "a.ts", TEXT, json.dumps(tree())), ("k", "repo", "broken.ts", "x", "{"), ("k", "repo", "odd.ts", "x", '{"type": "Program", "body": [{"type": "BinaryExpression"}]}'), ("k", "repo", "none.js", "x", None), ("k", "repo", "readme.md", "x", None)]
    files = spark.createDataFrame(rows, "key string, repo string, path string, text string, ast string")
    rows = index.extracted(files).cache()
    return rows, Engine(index.code_graph(rows, files))


def test_a_decorated_class_is_found(code):
    query = """javascript::require(E)[name="@web/common"]. javascript::class_decorator(A, B). javascript::call(D, B). javascript::member(E, D)[name="Controller"]. javascript::call_arg(B, C)[index=1].
    javascript::class_method(A, F). javascript::method_decorator(F, G). javascript::call(H, G). javascript::member(E, H)[name="Post"]. %root(H). %SELECT(A.name AS a, B.extracted AS b, C.name AS c, F.name AS f, G.extracted AS g)."""
    got = code[1].logic(query).collect()
    assert [tuple(r) for r in got] == [("Greeter", "Controller('app')", "app", "greet", "Send('/hello')")]


def test_containment_crosses_functions(code):
    rows = lambda q: sorted(map(tuple, code[1].logic(q).collect()))
    assert rows('javascript::function(F)[name="outer"]. javascript::throw(T). javascript::function_contains(F, T). %SELECT(F.name AS f, T.extracted AS t).') == [("outer", "throw new Greeter();")]
    assert rows("javascript::method_contains(M, R). javascript::return(R, V). %SELECT(M.name AS m, V.name AS v).") == [("greet", "true")]
    assert rows("javascript::if(I). javascript::if_body(I, C). javascript::call(M, C). %SELECT(C.extracted AS c, M.name AS m).") == [("this.other.call(name)", "call")]
    assert rows("javascript::method_arg(M, A). %SELECT(M.name AS m, A.name AS a).") == [("constructor", "other"), ("greet", "name")]


def test_files_that_cannot_be_read_are_reported(code):
    assert sorted((r.path, r.error.split(":")[0]) for r in index.errors(code[0]).collect()) == [("broken.ts", "JSONDecodeError"), ("none.js", "ValueError"), ("odd.ts", "KeyError")]
    assert {r.path for r in index.nodes(code[0]).select("path").distinct().collect()} == {"a.ts"}
    assert index.lookups(code[0]).count() == 3 and index.symbols(code[0]).where("end_index > start_index").count() >= 6


def test_a_parser_makes_the_trees(spark):
    files = spark.createDataFrame([("k", "r", "a.js", "x"), ("k", "r", "b.js", "fail")], "key string, repo string, path string, text string")

    def parse(path, text):
        if text == "fail":
            raise ValueError
        return json.dumps({"type": "Program", "body": [{"type": "ExpressionStatement", "expression": {"type": "Identifier", "name": text}}]})

    rows = index.extracted(index.parsed(files, parse))
    assert [(r.id, r.name) for r in index.nodes(rows).collect()] == [("k/a.js#0", "x")] and [r.path for r in index.errors(rows).collect()] == ["b.js"]


def test_patterns_and_statements():
    ident = lambda n: {"type": "Identifier", "name": n}
    declare = lambda left, right: {"type": "VariableDeclaration", "declarations": [{"type": "VariableDeclarator", "id": left, "init": right}]}
    prop = lambda k, v: {"type": "Property", "key": ident(k), "value": v}
    body = [
        declare({"type": "ObjectPattern", "properties": [prop("a", {"type": "AssignmentPattern", "left": ident("b"), "right": {"type": "Literal", "value": 1}}), {"type": "RestElement", "argument": ident("rest")}]}, {"type": "ObjectExpression", "properties": [prop("a", {"type": "ArrayExpression", "elements": [None, ident("z")]})]}),
        {"type": "ForOfStatement", "left": declare({"type": "ArrayPattern", "elements": [ident("x"), None]}, None), "right": ident("b"), "body": {"type": "BlockStatement", "body": [{"type": "ContinueStatement"}]}},
        {"type": "TryStatement", "block": {"type": "BlockStatement", "body": []}, "handler": {"param": ident("e"), "body": {"type": "BlockStatement", "body": [{"type": "ThrowStatement", "argument": ident("e")}]}}, "finalizer": {"type": "BlockStatement", "body": []}},
        {"type": "SwitchStatement", "discriminant": ident("b"), "cases": [{"test": {"type": "Literal", "value": None, "raw": "null"}, "consequent": [{"type": "BreakStatement"}]}, {"test": None, "consequent": []}]},
        {"type": "ExportDefaultDeclaration", "declaration": {"type": "JSXElement", "openingElement": {"name": {"type": "JSXIdentifier", "name": "b"}, "attributes": [{"type": "JSXAttribute", "name": {"name": "k"}, "value": {"type": "Literal", "value": "v"}}]}, "children": [{"type": "JSXText", "value": "t"}]}},
        {"type": "TSInterfaceDeclaration", "id": ident("T")}, {"type": "WhoKnows", "part": {"type": "TemplateLiteral", "quasis": [{"type": "TemplateElement", "value": {"cooked": "q"}}], "expressions": [ident("b")]}},
    ]
    graph = javascript.extract("p.ts", {"type": "Program", "body": body})
    kinds = {n[1] for n in graph.nodes}
    assert {"identifier", "member", "object", "object-prop", "array", "for", "for-var", "continue", "try", "catch", "finally", "throw", "switch", "switch-block", "break", "export", "export-key", "jsx-element", "jsx-attribute", "template-literal", "template-expression"} <= kinds
    name_of = {n[0]: (n[1], n[2]) for n in graph.nodes}
    edges = {(e[0], name_of[e[1]], name_of[e[2]]) for e in graph.edges}
    assert ("declare", ("identifier", "b"), ("member", "a")) in edges and ("assignment", ("identifier", "b"), ("literal", "1")) in edges and ("declare", ("identifier", "rest"), ("object", None)) in edges
    assert ("reference", ("identifier-ref", "e"), ("identifier", "e")) in edges and ("catch-contains", ("catch", None), ("throw", None)) in edges and ("jsx-tag", ("jsx-element", "b"), ("identifier-ref", "b")) in edges
    assert not any(e[0] == "reference" and name_of[e[1]][1] == "z" for e in graph.edges)


def test_files_made_from_small_rows_are_spread(spark, monkeypatch):
    from graphscan import suite
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(suite, "FILES", 100, raising=False)
    tasks = suite._code(spark, sf).where("what = 'node'").groupBy(F.spark_partition_id().alias("task")).count().count()
    assert tasks == spark.read.parquet(f"{sf}/events.parquet").count() // 100 + 1
