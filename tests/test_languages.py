"""Parsers, printers and the compiler, without Spark."""

import itertools

from graphscan import suite
from graphscan.functions.scalars import letters, letters_number
from graphscan.lang import parse, show
from graphscan.lang.tree import EdgeType, Follow, Linear
from graphscan.plans import compiler
from graphscan.plans.automaton import Automaton
from graphscan.plans.registry import code_registry, tabular_registry
from hypothesis import given
from hypothesis import strategies as st


def test_texts_round_trip():
    for kind, text, _ in suite._TEXTS.values():
        if kind == "r":
            tree = parse.parse_relational(text)
            assert parse.parse_relational(show.relational(tree)) == tree
        else:
            tree = parse.parse_logic(text)
            assert parse.parse_logic(show.logic(tree)) == tree


def counts(of):
    return lambda s: of.get(s.types[0], 1) if s.types else compiler.COUNT_OF_ALL


def test_root_by_cost():
    logic = parse.parse_logic("javascript::class(CLASS). javascript::class_method(CLASS, METHOD). javascript::throw(THROW). javascript::contains(METHOD, THROW).")
    bound = compiler.variables(logic, code_registry())
    assert bound["METHOD"].types == ("method",)
    found = {p.root: p.cost for p in compiler.plans(list(logic.clauses), bound, code_registry(), counts({"throw": 10_000, "method": 500, "class": 50}))}
    assert found == {"CLASS": 500_000, "METHOD": 500_000, "THROW": 10_000}
    query = compiler.compile_logic(logic, code_registry(), counts({"throw": 10_000, "method": 500, "class": 50}))[0]
    assert query.root == "THROW" and [t.name for t in query.traces] == ["METHOD", "CLASS"]
    first = query.traces[0].traverses[0].follows
    assert [(f.kind, f.edges[0].type, f.edges[0].reverse) for f in first] == [("t", "function-contains", True), ("?", "method-function", True)]


def test_plans_pair_no_branches_that_meet_in_few_nodes():
    text = "tables::placed(C, O). tables::cust_nation(C, N). tables::shipped_by(O, S). tables::supp_nation(S, N). %SELECT(O.id AS o, N.name AS n)."
    logic = parse.parse_logic(text)
    for copies in (1, 60, 360):
        of = {"nation": 25, "customer": 15_000 * copies, "supplier": 1_000 * copies, "order": 150_000 * copies}
        query = compiler.compile_logic(logic, tabular_registry(), counts(of))[0]
        back = [f.edges[0].type for t in query.traces for f in t.traverses[0].follows if f.edges[0].reverse]
        assert not {"cust_nation", "supp_nation"} & set(back)
    p = tabular_registry().edge("tables::cust_nation")
    assert compiler._backward(p, counts({"nation": 25, "customer": 15_000})) == 600 and compiler._backward(p, counts({"nation": 0, "customer": 0})) == 1


def test_components_and_conflicts():
    logic = parse.parse_logic("tables::nation(N). tables::part(P). tables::in_region(N, R).")
    assert [[c.predicate for c in part] for part in compiler.components(logic)] == [["tables::part"], ["tables::nation", "tables::in_region"]] or len(compiler.components(logic)) == 2
    try:
        compiler.variables(parse.parse_logic("tables::part(N). tables::in_region(N, R)."), tabular_registry())
    except ValueError as e:
        assert e.code == "invalid.types"
    else:
        raise AssertionError


@given(st.integers(0, 10**6))
def test_letters(n):
    assert letters_number(letters(n)) == n


kinds = st.lists(st.tuples(st.sampled_from("t?*"), st.sampled_from(["x", "y"])), min_size=1, max_size=4)


@given(kinds)
def test_automaton_accepts_what_the_expression_means(parts):
    machine = Automaton(Linear(tuple(Follow(k, (EdgeType(e),)) for k, e in parts)))

    def meant(word, at=0):
        if at == len(parts):
            return not word
        kind, e = parts[at]
        hop = bool(word) and word[0] == e
        return (kind != "t" and meant(word, at + 1)) or (hop and (meant(word[1:], at + 1) or (kind == "*" and meant(word[1:], at))))

    for n in range(5):
        for word in itertools.product("xy", repeat=n):
            states = {0}
            for c in word:
                states = {t for s in states for e, t in machine.moves[s] if e.type == c}
            assert bool(states & machine.accepts) == meant(word), (parts, word)
