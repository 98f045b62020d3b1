"""Code graphs of JavaScript and TypeScript syntax trees (ESTree in JSON).

Every edge row points from what uses to what is used, or from a whole to its
part.  A name declared in a scope is an ``identifier``; a use of it is an
``identifier-ref`` with a ``reference`` edge.  Functions and the blocks of
control statements have an edge to everything inside them, nested functions
included.  Node kinds that are not known have their parts visited.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Graph:
    """Rows of one file, and the scopes while it is walked."""

    def __init__(self, path: str):
        self.path, self.nodes, self.edges, self.lookups = path, [], [], []
        self.scopes: list[dict[str, str]] = [{}]
        self.containers: list[tuple[str, str]] = []
        self.functions: list[str] = []
        self.labels: list[tuple[str, str]] = []

    def node(self, kind: str, ast: dict, name: str | None = None, index: int | None = None, symbol: bool = False) -> str:
        start, end = ast.get("range") or (ast.get("start", -1), ast.get("end", -1))
        loc = ast.get("loc") or {}
        line = lambda side: (loc.get(side) or {}).get("line", -1)
        self.nodes.append((f"{self.path}#{len(self.nodes)}", kind, name, index, start, end, line("start"), line("end"), symbol))
        made = self.nodes[-1][0]
        for edge, outer in self.containers:
            self.edge(edge, outer, made)
        return made

    def edge(self, kind: str, a: str | None, b: str | None, name: str | None = None, index: int | None = None) -> None:
        if a and b:
            self.edges.append((kind, a, b, name, index))

    def declare(self, name: str, ast: dict, value: str | None, symbol: bool = True) -> str:
        known = self.scopes[-1].get(name)
        made = known if known and any(n[0] == known and n[4] == (ast.get("range") or [ast.get("start", -1)])[0] for n in self.nodes[-1:]) else self.node("identifier", ast, name, symbol=symbol)
        self.scopes[-1][name] = made
        self.edge("declare", made, value)
        return made

    def resolve(self, name: str) -> str | None:
        return next((s[name] for s in reversed(self.scopes) if name in s), None)


Rule = Callable[[Graph, dict], "str | None"]
RULES: dict[str, Rule] = {}


def rule(*kinds: str) -> Callable[[Rule], Rule]:
    def add(f: Rule) -> Rule:
        RULES.update(dict.fromkeys(kinds, f))
        return f

    return add


def visit(g: Graph, ast) -> str | None:
    """The node that stands for a piece of the tree, if one does."""
    if isinstance(ast, list):
        for part in ast:
            visit(g, part)
        return None
    if not isinstance(ast, dict) or "type" not in ast:
        return None
    handle = RULES.get(ast["type"])
    if handle:
        return handle(g, ast)
    if ast["type"].startswith("TS"):
        return None  # types leave no trace in the graph
    for key, part in ast.items():
        if key not in ("loc", "range", "tokens", "comments", "parent"):
            visit(g, part)
    return None


def inside(g: Graph, parts, *containers: tuple[str, str], scope: bool = True) -> None:
    """Visits parts as contained in some nodes, in a scope of their own."""
    g.containers.extend(containers)
    if scope:
        g.scopes.append({})
    hoist(g, parts if isinstance(parts, list) else [parts])
    visit(g, parts)
    if scope:
        g.scopes.pop()
    del g.containers[len(g.containers) - len(containers) :]


def hoist(g: Graph, body: Iterable) -> None:
    """Functions and classes are known before their place."""
    for part in body:
        part = part.get("declaration") or part if isinstance(part, dict) and str(part.get("type", "")).startswith("Export") else part
        if isinstance(part, dict) and part.get("type") in ("FunctionDeclaration", "ClassDeclaration") and part.get("id"):
            g.scopes[-1][part["id"]["name"]] = g.node("identifier", part["id"], part["id"]["name"], symbol=True)


@rule("Program")
def _program(g, ast):
    hoist(g, ast.get("body", []))
    visit(g, ast.get("body", []))


@rule("BlockStatement")
def _block(g, ast):
    inside(g, ast.get("body", []))


# ------------------------------------------------------------- expressions


@rule("Identifier")
def _identifier(g, ast):
    made = g.node("identifier-ref", ast, ast["name"])
    g.edge("reference", made, g.resolve(ast["name"]))
    return made


@rule("Literal")
def _literal(g, ast):
    value = ast.get("value")
    return g.node("literal", ast, ast.get("raw") if value is None or isinstance(value, (dict, list)) else str(value).lower() if isinstance(value, bool) else str(value))


@rule("ThisExpression")
def _this(g, ast):
    return g.node("this", ast)


@rule("Super")
def _super(g, ast):
    return g.node("super", ast)


@rule("MemberExpression")
def _member(g, ast):
    held = visit(g, ast["object"])
    named = not ast.get("computed")
    key = None if named else visit(g, ast["property"])
    name = ast["property"].get("name") if named else str(ast["property"]["value"]) if ast["property"].get("type") == "Literal" else None
    made = g.node("member", ast, name)
    g.edge("member", made, held, name)
    g.edge("member-key", made, key)
    return made


@rule("CallExpression")
def _call(g, ast):
    callee, args = ast["callee"], ast.get("arguments", [])
    if callee.get("type") == "Identifier" and callee["name"] == "require" and not g.resolve("require") and len(args) == 1 and isinstance(args[0].get("value"), str):
        return g.node("require", ast, args[0]["value"])
    target = visit(g, callee)
    made = g.node("call", ast)
    g.edge("call", made, target)
    named = callee.get("property") or callee
    g.lookups.append((made, (named.get("range") or [named.get("start", -1)])[0]))
    _arguments(g, made, args)
    return made


def _arguments(g, call, args):
    for i, a in enumerate(args):
        g.edge("argument", visit(g, a), call, None, i)


@rule("NewExpression")
def _new(g, ast):
    target = visit(g, ast["callee"])
    made = g.node("instance", ast)
    g.edge("class", made, target)
    _arguments(g, made, ast.get("arguments", []))
    return made


@rule("UnaryExpression", "UpdateExpression")
def _unary(g, ast):
    part = visit(g, ast["argument"])
    made = g.node("unary-exp", ast, ast.get("operator"))
    g.edge("basic-exp", part, made, None, 0)
    return made


@rule("BinaryExpression", "LogicalExpression")
def _binary(g, ast):
    parts = [visit(g, ast["left"]), visit(g, ast["right"])]
    made = g.node("binary-exp", ast, ast.get("operator"))
    for i, p in enumerate(parts):
        g.edge("basic-exp", p, made, None, i)
    return made


@rule("ConditionalExpression")
def _conditional(g, ast):
    parts = [(k, visit(g, ast[k])) for k in ("test", "consequent", "alternate")]
    made = g.node("conditional", ast)
    for k, p in parts:
        g.edge(f"conditional-{k}", made, p)
    return made


def _wrapped(kind: str, part: str) -> Rule:
    def handle(g, ast):
        inner = visit(g, ast.get(part))
        made = g.node(kind, ast)
        g.edge(kind, made, inner)
        return made

    return handle


RULES |= {"AwaitExpression": _wrapped("await", "argument"), "YieldExpression": _wrapped("yield", "argument"), "ThrowStatement": _wrapped("throw", "argument"), "SpreadElement": _wrapped("spread", "argument")}


def _through(part: str) -> Rule:
    return lambda g, ast: visit(g, ast.get(part))


for _kind, _part in {
    "TSAsExpression": "expression", "TSNonNullExpression": "expression", "TSTypeAssertion": "expression", "ChainExpression": "expression", "ParenthesizedExpression": "expression", "ExpressionStatement": "expression",
    "Decorator": "expression", "JSXExpressionContainer": "expression", "JSXSpreadChild": "expression",
}.items():
    RULES[_kind] = _through(_part)


@rule("SequenceExpression")
def _sequence(g, ast):
    parts = [visit(g, p) for p in ast["expressions"]]
    made = g.node("sequence", ast)
    for i, p in enumerate(parts):
        g.edge("sequence", made, p, None, i)
    return made


@rule("ArrayExpression")
def _array(g, ast):
    parts = [visit(g, p) for p in ast["elements"]]
    made = g.node("array", ast)
    for i, p in enumerate(parts):
        g.edge("array-member", made, p, None, i)
    return made


@rule("ObjectExpression")
def _object(g, ast):
    made = g.node("object", ast)
    for p in ast["properties"]:
        if p["type"] == "SpreadElement":
            g.edge("object-spread", made, visit(g, p))
            continue
        name = _key_name(p)
        prop = g.node("object-prop", p, name)
        g.edge("object-prop", made, prop, name)
        if p.get("computed"):
            g.edge("object-key", prop, visit(g, p["key"]))
        g.edge("object-value", prop, visit(g, p["value"]))
    return made


def _key_name(p):
    key = p.get("key") or {}
    return key.get("name") if not p.get("computed") and "name" in key else str(key["value"]) if "value" in key else None


@rule("TemplateLiteral")
def _template(g, ast):
    made = g.node("template-literal", ast)
    parts = sorted([*ast.get("quasis", []), *ast.get("expressions", [])], key=lambda p: (p.get("range") or [p.get("start", 0)])[0])
    for i, p in enumerate(parts):
        if p["type"] == "TemplateElement":
            part = g.node("literal", p, (p.get("value") or {}).get("cooked"))
        else:
            part = g.node("template-expression", p)
            g.edge("template-contains", part, visit(g, p))
        g.edge("template-literal", made, part, None, i)
    return made


@rule("TaggedTemplateExpression")
def _tagged(g, ast):
    target, text = visit(g, ast["tag"]), visit(g, ast["quasi"])
    made = g.node("call", ast)
    g.edge("call", made, target)
    g.edge("argument", text, made, None, 0)
    return made


@rule("AssignmentExpression")
def _assignment(g, ast):
    value, left = visit(g, ast["right"]), ast["left"]
    if ast.get("operator", "=") != "=":
        made = g.node("binary-exp", ast, ast["operator"])
        g.edge("basic-exp", visit(g, left), made, None, 0)
        g.edge("basic-exp", value, made, None, 1)
        value = made
    if left["type"] == "Identifier":
        known = g.resolve(left["name"])
        g.edge("assignment", known or g.declare(left["name"], left, None), value)
    elif left["type"] == "MemberExpression":
        target = visit(g, left)
        g.edge("assignment", target, value)
        holder = left["object"]
        if holder.get("name") == "exports" or holder.get("name") == "module" and left["property"].get("name") == "exports":
            made = g.node("export", ast)
            g.edge("export", made, value)
    else:
        bind(g, left, value)
    return value


# ---------------------------------------------------------------- patterns


def bind(g: Graph, pattern: dict | None, value: str | None) -> None:
    """Declares the names of a pattern; a part of a value is a member of it."""
    if not pattern:
        return
    kind = pattern["type"]
    if kind == "Identifier":
        g.declare(pattern["name"], pattern, value)
    elif kind == "ObjectPattern":
        for p in pattern["properties"]:
            if p["type"] in ("RestElement", "ExperimentalRestProperty"):
                bind(g, p["argument"], value)
                continue
            name = _key_name(p)
            part = g.node("member", p, name)
            g.edge("member", part, value, name)
            if p.get("computed"):
                g.edge("member-key", part, visit(g, p["key"]))
            bind(g, p["value"], part)
    elif kind == "ArrayPattern":
        for i, p in enumerate(pattern["elements"]):
            if p and p["type"] == "RestElement":
                bind(g, p["argument"], value)
            elif p:
                part = g.node("member", p, str(i))
                g.edge("member", part, value, str(i), i)
                bind(g, p, part)
    elif kind == "AssignmentPattern":
        other = visit(g, pattern["right"])
        bind(g, pattern["left"], value)
        if pattern["left"]["type"] == "Identifier":
            g.edge("assignment", g.resolve(pattern["left"]["name"]), other)
    elif kind == "RestElement":
        bind(g, pattern["argument"], value)
    elif kind == "TSParameterProperty":
        bind(g, pattern["parameter"], value)


@rule("VariableDeclaration")
def _variables(g, ast):
    for d in ast["declarations"]:
        value = visit(g, d.get("init"))
        bind(g, d["id"], value)


# --------------------------------------------------- functions and classes


def function(g: Graph, ast: dict, name: str | None = None) -> str:
    made = g.node("function", ast, name or (ast.get("id") or {}).get("name"), symbol=True)
    g.containers.append(("function-contains", made))
    g.functions.append(made)
    g.scopes.append({})
    for i, p in enumerate(ast.get("params", [])):
        inner = p.get("parameter", p)
        inner = inner.get("left", inner)
        arg = g.node("function-arg", p, inner.get("name"), i)
        g.edge("function-argument", made, arg, inner.get("name"), i)
        bind(g, p, arg)
    body = ast.get("body")
    if body and body["type"] == "BlockStatement":
        hoist(g, body["body"])
        visit(g, body["body"])
    elif body:
        g.edge("function-return", visit(g, body), made)
    g.scopes.pop()
    g.functions.pop()
    g.containers.pop()
    return made


@rule("FunctionExpression", "ArrowFunctionExpression", "TSEmptyBodyFunctionExpression")
def _function(g, ast):
    return function(g, ast)


@rule("FunctionDeclaration")
def _function_declaration(g, ast):
    made = function(g, ast)
    if ast.get("id"):
        g.edge("declare", g.resolve(ast["id"]["name"]) or g.declare(ast["id"]["name"], ast["id"], None), made)
    return made


@rule("ReturnStatement")
def _return(g, ast):
    value = visit(g, ast.get("argument"))
    made = g.node("return", ast)
    g.edge("return", made, value)
    if g.functions:
        g.edge("function-return", made, g.functions[-1])
    return made


@rule("ClassDeclaration", "ClassExpression")
def _class(g, ast):
    name = (ast.get("id") or {}).get("name")
    decorators = [visit(g, d) for d in ast.get("decorators") or []]
    parent = visit(g, ast.get("superClass"))
    made = g.node("class", ast, name, symbol=True)
    g.edge("super-class", made, parent)
    for i, d in enumerate(decorators):
        g.edge("class-decorator", made, d, None, i)
    if name:
        known = g.resolve(name) if ast["type"] == "ClassDeclaration" else None
        g.edge("declare", known or g.declare(name, ast["id"], None), made)
    for part in (ast.get("body") or {}).get("body", []):
        own = [visit(g, d) for d in part.get("decorators") or []]
        key = _key_name(part)
        if part["type"] in ("MethodDefinition", "TSAbstractMethodDefinition"):
            one = g.node("method", part, key, symbol=True)
            g.edge("method-function", one, function(g, part["value"], key))
            for i, d in enumerate(own):
                g.edge("method-decorator", one, d, None, i)
            if part.get("computed"):
                g.edge("method-key", one, visit(g, part["key"]))
            g.edge("constructor" if part.get("kind") == "constructor" else "method", made, one, key)
        elif part["type"] in ("PropertyDefinition", "ClassProperty", "TSAbstractPropertyDefinition"):
            one = g.node("class-property", part, key, symbol=True)
            g.edge("class-property-value", one, visit(g, part.get("value")))
            if part.get("computed"):
                g.edge("class-property-key", one, visit(g, part["key"]))
            g.edge("class-property", made, one, key)
        else:
            visit(g, part.get("body"))
    return made


# -------------------------------------------------------------- statements


@rule("IfStatement")
def _if(g, ast):
    made = g.node("if", ast)
    rest = ast
    while rest:
        if rest["type"] == "IfStatement":
            block = g.node("if-block", rest["consequent"])
            g.edge("if-block", made, block)
            g.edge("if-test", block, visit(g, rest["test"]))
            inside(g, rest["consequent"], ("if-contains", block))
            rest = rest.get("alternate")
        else:
            block = g.node("if-block", rest)
            g.edge("if-block", made, block)
            inside(g, rest, ("if-contains", block))
            rest = None
    return made


@rule("WhileStatement", "DoWhileStatement")
def _while(g, ast):
    made = g.node("while", ast)
    g.edge("while-test", made, visit(g, ast["test"]))
    inside(g, ast["body"], ("while-contains", made))
    return made


@rule("ForStatement", "ForInStatement", "ForOfStatement")
def _for(g, ast):
    made = g.node("for", ast)
    g.scopes.append({})
    if ast["type"] == "ForStatement":
        g.edge("for-init", made, visit(g, ast.get("init")))
        g.edge("for-test", made, visit(g, ast.get("test")))
        g.edge("for-update", made, visit(g, ast.get("update")))
    else:
        over, left = visit(g, ast["right"]), ast["left"]
        var = g.node("for-var", left)
        g.edge("for-var", made, var)
        g.edge("member", var, over)
        bind(g, left["declarations"][0]["id"] if left["type"] == "VariableDeclaration" else left, var)
    inside(g, ast["body"], ("for-contains", made))
    g.scopes.pop()
    return made


@rule("SwitchStatement")
def _switch(g, ast):
    made = g.node("switch", ast)
    g.edge("switch-discriminant", made, visit(g, ast["discriminant"]))
    for i, case in enumerate(ast["cases"]):
        block = g.node("switch-block", case)
        g.edge("switch-block", made, block, None, i)
        g.edge("switch-test", block, visit(g, case.get("test")))
        inside(g, case["consequent"], ("switch-contains", block))
    return made


@rule("TryStatement")
def _try(g, ast):
    made = g.node("try", ast)
    inside(g, ast["block"], ("try-contains", made))
    if ast.get("handler"):
        handler = g.node("catch", ast["handler"])
        g.edge("catch", made, handler)
        g.scopes.append({})
        if ast["handler"].get("param"):
            arg = g.node("function-arg", ast["handler"]["param"], ast["handler"]["param"].get("name"), 0)
            g.edge("function-argument", handler, arg, None, 0)
            bind(g, ast["handler"]["param"], arg)
        inside(g, ast["handler"]["body"], ("catch-contains", handler))
        g.scopes.pop()
    if ast.get("finalizer"):
        last = g.node("finally", ast["finalizer"])
        g.edge("finally", made, last)
        inside(g, ast["finalizer"], ("finally-contains", last))
    return made


@rule("LabeledStatement")
def _label(g, ast):
    made = g.node("label", ast, ast["label"]["name"])
    g.labels.append((ast["label"]["name"], made))
    inside(g, ast["body"], ("label-contains", made))
    g.labels.pop()
    return made


@rule("BreakStatement", "ContinueStatement")
def _break(g, ast):
    made = g.node("break" if ast["type"] == "BreakStatement" else "continue", ast)
    if ast.get("label"):
        g.edge("break-label", made, next((n for name, n in reversed(g.labels) if name == ast["label"]["name"]), None))
    return made


@rule("WithStatement")
def _with(g, ast):
    made = g.node("with", ast)
    g.edge("with", made, visit(g, ast["object"]))
    inside(g, ast["body"], ("with-contains", made))
    return made


# ------------------------------------------------------------------ modules


@rule("ImportDeclaration")
def _import(g, ast):
    made = g.node("require", ast, ast["source"]["value"])
    for s in ast.get("specifiers", []):
        if s["type"] == "ImportNamespaceSpecifier":
            g.declare(s["local"]["name"], s["local"], made)
            continue
        imported = s.get("imported") or {}
        name = "default" if s["type"] == "ImportDefaultSpecifier" else imported.get("name") or imported.get("value")
        part = g.node("member", s, name)
        g.edge("member", part, made, name)
        g.declare(s["local"]["name"], s["local"], part)
    return made


def _exported(g, ast, value, name):
    made = g.node("export", ast)
    g.edge("export", made, value)
    if name:
        g.edge("export-key", made, g.node("export-key", ast, name), name)
    return made


@rule("ExportNamedDeclaration")
def _export(g, ast):
    source = g.node("require", ast["source"], ast["source"]["value"]) if ast.get("source") else None
    inner = ast.get("declaration")
    if inner:
        value = visit(g, inner)
        if inner["type"] == "VariableDeclaration":
            for d in inner["declarations"]:
                if d["id"]["type"] == "Identifier":
                    _exported(g, ast, g.resolve(d["id"]["name"]), d["id"]["name"])
        else:
            _exported(g, ast, value, (inner.get("id") or {}).get("name"))
    for s in ast.get("specifiers", []):
        if source:
            value = g.node("member", s, s["local"].get("name"))
            g.edge("member", value, source, s["local"].get("name"))
        else:
            value = visit(g, s["local"])
        _exported(g, s, value, s["exported"].get("name"))


@rule("ExportDefaultDeclaration")
def _export_default(g, ast):
    _exported(g, ast, visit(g, ast["declaration"]), "default")


@rule("ExportAllDeclaration")
def _export_all(g, ast):
    _exported(g, ast, g.node("require", ast["source"], ast["source"]["value"]), (ast.get("exported") or {}).get("name"))


# --------------------------------------------------------------------- JSX


@rule("JSXIdentifier")
def _jsx_name(g, ast):
    return _identifier(g, ast)


@rule("JSXMemberExpression")
def _jsx_member(g, ast):
    return _member(g, ast | {"computed": False})


@rule("JSXText")
def _jsx_text(g, ast):
    return g.node("literal", ast, ast.get("value"))


@rule("JSXElement", "JSXFragment")
def _jsx(g, ast):
    opening = ast.get("openingElement") or {}
    tag = visit(g, opening.get("name"))
    made = g.node("jsx-element", ast, (opening.get("name") or {}).get("name"))
    g.edge("jsx-tag", made, tag)
    for a in opening.get("attributes", []):
        if a["type"] == "JSXSpreadAttribute":
            g.edge("jsx-attribute", made, visit(g, a["argument"]))
            continue
        name = a["name"].get("name") if isinstance(a["name"].get("name"), str) else None
        one = g.node("jsx-attribute", a, name)
        g.edge("jsx-attribute", made, one, name)
        g.edge("jsx-attribute-value", one, visit(g, a.get("value")))
    for i, c in enumerate(ast.get("children", [])):
        g.edge("jsx-child", made, visit(g, c), None, i)
    return made


def extract(path: str, ast: dict) -> Graph:
    graph = Graph(path)
    visit(graph, ast)
    return graph
