"""Walks, joins and filters on small graphs with answers worked out by hand."""

import pytest
from graphscan.engine import Engine
from graphscan.lang.tree import QueryError
from graphscan.sources.graph import GraphSource

NODE = "id string, type string, name string, index int, search_name array<string>, props array<struct<key:string,value:string>>, key string, path string"
EDGE = "type string, from string, to string, name string, index int, key string"


def graph(spark, nodes, edges):
    n = [(i, t, nm, None, [nm] if nm else [], [{"key": k, "value": v} for k, v in p.items()], "k", "f") for i, t, nm, p in nodes]
    e = [(t, a, b, nm, None, "k") for t, a, b, nm in edges]
    return Engine(GraphSource.of(spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)))


def plain(ids, kind="call"):
    return [(i, kind, None, {}) for i in ids]


@pytest.fixture(scope="module")
def follows(spark):
    nodes = plain(["0", "1", "2", "3"], "class") + plain([str(i) for i in range(4, 12)])
    edges = [("cp", "0", "4"), ("cd", "4", "5"), ("m", "5", "6"), ("cd", "1", "7"), ("m", "2", "8"), ("cd", "3", "9"), ("m", "9", "10"), ("m", "10", "11")]
    return graph(spark, nodes, [(*e, None) for e in edges])


@pytest.fixture(scope="module")
def follows2(spark):
    nodes = plain(["0", "1", "2", "3"], "class") + plain([str(i) for i in range(4, 11)])
    edges = [("cp", "0", "4"), ("cd", "4", "5"), ("cd", "5", "6"), ("cd", "1", "7"), ("m", "2", "8"), ("cd", "3", "9"), ("cp", "9", "10")]
    return graph(spark, nodes, [(*e, None) for e in edges])


def ends(engine, steps):
    return sorted((r.root, r.terminus) for r in engine.graph('root{type:"class"}' + steps).collect())


def test_filters(spark):
    e = graph(spark, [("n1", "require", "@x/common", {"visibility": "private"}), ("n2", "require", "jarvis", {}), ("n3", "density", "jamila", {})], [("x", "n1", "n2", None)])
    found = lambda setting: sorted(r.a for r in e.relational(f"SELECT A.id AS a FROM root{setting} AS A").collect())
    assert found('{type:["require","density"]}') == ["n1", "n2", "n3"]
    assert found('{id:["n1","n2"]}') == ["n1", "n2"]
    assert found('{type:"require",name:["*common","jarvis","jamila"]}') == ["n1", "n2"]
    assert found('{type:"require",name:"/j.*s/"}') == ["n2"]
    assert found('{type:"require",props:{"visibility":"private"}}') == ["n1"]
    assert found("{all}") == ["n1", "n2", "n3"]
    with pytest.raises(QueryError):
        found('{type:"require",name:"/a~b/"}')


def test_regular_paths(follows, follows2):
    assert ends(follows, '.linear_traverse[?["cp"],*["cd"],t["m"]]') == [("0", "6"), ("2", "8"), ("3", "10")]
    all_ = [("0", "0"), ("0", "4"), ("0", "5"), ("0", "6"), ("1", "1"), ("1", "7"), ("2", "2"), ("3", "3"), ("3", "9")]
    assert ends(follows2, '.linear_traverse[?["cp"],*["cd"]]') == all_
    assert ends(follows2, '.linear_traverse[?["cp"],*["cd"]].node_check{type:"call"}') == [p for p in all_ if p[0] != p[1]]
    assert ends(follows2, '.repeated_traverse{follow:[?["cp"]],repeat:[t["cd"]]}') == [("0", "5"), ("0", "6"), ("1", "7"), ("3", "9")]
    assert ends(follows2, '.linear_traverse[t["cd"],?["cp"]]') == [("1", "7"), ("3", "10"), ("3", "9")]


def test_optional_tail_accepts_the_short_path(spark):
    e = graph(spark, plain(["a"], "class") + plain(["b"]), [("x", "a", "b", None)])
    assert ends(e, '.linear_traverse[t["x"],?["y"],?["z"]]') == [("a", "b")]


def test_one_path_accepted_twice_counts_once(spark):
    e = graph(spark, plain(["a"], "class") + plain(["b", "c"]), [("x", "a", "b", None), ("x", "b", "c", None)])
    assert ends(e, '.linear_traverse[?["x"],?["x"]]') == [("a", "a"), ("a", "b"), ("a", "c")]


def test_cycle_ends(spark):
    e = graph(spark, plain(["0", "1", "2", "3"], "class"), [("cd", a, b, None) for a, b in (("0", "1"), ("1", "2"), ("2", "3"), ("3", "0"))])
    got = sorted(r.terminus for r in e.graph('root{id:"0"}.linear_traverse[*["cd"]]').collect())
    assert got == ["0", "1", "2", "3"]


def test_labels_and_reverse(spark):
    e = graph(spark, plain(["n1", "n3"], "class") + plain(["n4", "n5"]), [("method", "n1", "n4", "test"), ("method", "n1", "n5", "other"), ("deco", "n3", "n5", None)])
    assert ends(e, '.linear_traverse[t[{type:"method",name:"test"}]]') == [("n1", "n4")]
    back = e.graph('root{type:"call"}.linear_traverse[t["deco".reverse]]').collect()
    assert [(r.root, r.terminus) for r in back] == [("n5", "n3")]


def test_left_join_and_aggregates(follows2):
    text = 'SELECT A.id AS a, B.id AS b FROM root{type:"class"} AS A TRACE left_join[A].linear_traverse[t["cd"]] AS B'
    assert sorted(map(tuple, follows2.relational(text).collect()), key=str) == [("0", None), ("1", "7"), ("2", None), ("3", "9")]
    assert [r.a for r in follows2.relational(text + " HAVING B IS_NULL ORDER BY a").collect()] == ["0", "2"]
    count = follows2.relational('SELECT COUNT(A) AS n, COLLECT(B.id) AS l FROM root{type:"class"} AS A TRACE left_join[A].linear_traverse[t["cd"]] AS B').first()
    assert count.n == 4 and sorted(count.l, key=str) == ["7", "9", None, None]
    assert follows2.relational('SELECT COUNT(A) AS n FROM root{type:"none"} AS A').first().n == 0


def test_errors(follows):
    for text, code in (
        ('SELECT B FROM root{all} AS A', "invalid.select"), ('SELECT A FROM root{all} AS A ORDER BY b', "invalid.orderby"),
        ('SELECT A FROM root{all} AS A TRACE join[C].linear_traverse[t["x"]] AS B', "from.dne"), ('SELECT A FROM root{all} AS A TRACE join[A].linear_traverse[t["x"]] AS A', "key.repeat"),
        ("SELECT A FROM", "invalid.syntax"),
    ):
        with pytest.raises(QueryError) as error:
            follows.relational(text)
        assert error.value.code == code
