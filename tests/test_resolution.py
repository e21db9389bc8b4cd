"""Resolving passes on small graphs with known answers, and their queries against DuckDB."""

import random
import re

import duckdb
import pytest

from tests.joins import most_rows
from tests.test_graph import graph
from weftgraph.model import CodeGraph
from weftgraph.operators import links, resolution
from weftgraph.plans import queries as graph_queries
from weftgraph.plans import registry
from weftgraph.plans import resolution as plans  # noqa: F401  registers its queries


def test_extends_calls(spark):
    nodes = [("Base", "class"), ("Mid", "class"), ("Leaf", "class"), ("Base::run", "method", None, None, True), ("Mid::run", "method", None, None, True), ("Leaf::run", "method"), ("Base::plain", "method"), ("Leaf::plain", "method")]
    edges = [("Mid", "Base", "EXTENDS"), ("Leaf", "Mid", "EXTENDS"), ("Base", "Leaf", "EXTENDS"), ("X::go", "Base::run", "CALLS"), ("X::go", "Base::plain", "CALLS"), ("X::go", "Gone::run", "CALLS")]
    got = {(r.from_id, r.to_id, r.call_type) for r in resolution.extends_calls(graph(spark, nodes, edges)).collect()}
    assert got == {("X::go", "Leaf::run", "EXTENDS_RESOLVED")}


def test_auto_imports(spark):
    nodes = [("js:a.vue::setup", "method", "a.vue"), ("js:composables/useCart.ts::useCart", "method", "composables/useCart.ts"), ("js:utils/x.ts::twice", "method", "utils/x.ts"), ("js:layer/utils/x.ts::twice", "method", "layer/utils/x.ts"), ("js:pages/p.ts::other", "method", "pages/p.ts")]
    edges = [("js:a.vue::setup", f"js:a.vue::{n}", "CALLS") for n in ("useCart", "twice", "other", "setup")]
    got = [(r.old_id, r.to_id, r.confidence) for r in resolution.auto_imports(graph(spark, nodes, edges)).collect()]
    assert got == [("js:a.vue::useCart", "js:composables/useCart.ts::useCart", 0.8)]


def test_canonical_endpoints(spark):
    nodes = spark.createDataFrame([("http:GET:/a/{id}", "http_endpoint", ["x"]), ("http:GET:/a//${row.id}/", "http_endpoint", ["y", "x"]), ("http:GET:/", "http_endpoint", None), ("js:a.vue", "module", None)], "id string, type string, keywords array<string>")
    edges = spark.createDataFrame([("js:a.vue", "http:GET:/a/{id}", "HTTP_REQUEST", None), ("js:a.vue", "http:GET:/a//${row.id}/", "HTTP_REQUEST", None), ("js:a.vue", "http:GET:/a/{id}", "HTTP_REQUEST", "v")], "from_id string, to_id string, type string, via string")
    g = resolution.canonical_endpoints(CodeGraph.of(nodes, edges))
    assert {(r.id, r.type, tuple(r.keywords or ())) for r in g.nodes.collect()} == {("http:GET:/a/{param}", "http_endpoint", ("x", "y")), ("http:GET:/", "http_endpoint", ()), ("js:a.vue", "module", ())}
    assert sorted(r.id for r in g.edges.collect()) == ["js:a.vue->http:GET:/a/{param}:HTTP_REQUEST:", "js:a.vue->http:GET:/a/{param}:HTTP_REQUEST:v"]
    empty = resolution.canonical_endpoints(CodeGraph.of(nodes.limit(0), edges.limit(0)))
    assert empty.nodes.collect() == [] and empty.edges.collect() == []


def test_prefer_concrete(spark):
    g = graph(spark, [("I", "interface"), ("J", "interface"), ("C", "class")], [])
    calls = spark.createDataFrame([("m", "I::run"), ("m", "C::run"), ("m", "J::stop"), ("m", "I::stop"), ("n", "I::run")], "from_id string, to_id string")
    assert {tuple(r) for r in resolution.prefer_concrete(g, calls).collect()} == {("m", "C::run"), ("m", "I::stop"), ("n", "I::run")}


def test_rendered_children(spark):
    nodes = [("js:a.vue", "module", "a.vue"), ("js:a.vue::render", "method", "a.vue"), ("js:b.vue", "module", "b.vue")]
    edges = [("js:a.vue", "js:x.vue", "RENDERS_COMPONENT"), ("js:a.vue::render", "js:x.vue", "RENDERS_COMPONENT"), ("js:b.vue", "js:x.vue", "RENDERS_COMPONENT"), ("js:b.vue", "tag", "RENDERS_COMPONENT")]
    assert {tuple(r) for r in resolution.rendered_children(graph(spark, nodes, edges)).collect()} == {("js:a.vue", "js:x.vue", 2), ("js:b.vue", "js:x.vue", 2)}


@pytest.mark.parametrize("name", ["l8_extends_calls", "l1_canonical_endpoints", "g17_prefer_concrete"])
def test_queries_against_duckdb(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = registry.queries()[name](spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got


def test_new_calls_are_told_apart_by_their_ends(spark):
    nodes = [(f"C{i}::m", f"C{i}", "method", "m") for i in range(4)]
    edges = [(f"C{i}", f"C{i - 1}", "EXTENDS") for i in range(1, 4)] + [("A::x", "C0::m", "CALLS"), ("A::x", "C1::m", "CALLS")]
    g = CodeGraph.of(spark.createDataFrame(nodes, "id string, parent string, type string, name string"), spark.createDataFrame(edges, "from_id string, to_id string, type string"))
    found = links.override_calls(g)
    assert sorted((r.id, r.from_id, r.to_id, r.type, r.call_type) for r in found.collect()) == [(f"A::x->C{i}::m", "A::x", f"C{i}::m", "CALLS", "OVERRIDE_RESOLVED") for i in (1, 2, 3)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.match(r"Aggregate \[from_id#\d+, to_id#\d+\]", plan)


def test_counts_of_override_calls_without_pairs(spark):
    """As many as there are pairs: under single parents, several, loops, methods of two classes, repeated calls and rows."""
    rng = random.Random(7)
    up = [(f"C{i}", f"C{i // 2}") for i in range(1, 40)] + [(f"D{i}", f"D{i - 1}") for i in range(1, 12)] + [("D5", "C3"), ("L1", "L2"), ("L2", "L1"), ("L3", "L1"), ("L4", "L3"), ("D11", "D11")]
    classes = sorted({c for e in up for c in e})
    nodes = [(f"{c}::{m}", c, m, "method") for c in classes for m in ("a", "b") if rng.random() < 0.8] * 2 + [("C30::a", "D3", "a", "method"), ("C9::x", "C9", "a", "method"), (None, "C4", "a", "method")]
    calls = [(f"f{rng.randrange(9)}" if rng.random() < 0.9 else None, f"{rng.choice(classes)}::{rng.choice('abc')}", "CALLS") for _ in range(300)]
    edges = spark.createDataFrame([(*e, "EXTENDS") for e in up * 2] + calls * 2, "from_id string, to_id string, type string")
    g = CodeGraph.of(spark.createDataFrame(nodes, "id string, parent string, name string, type string"), edges)
    want = links.override_calls(g).groupBy("to_id").count().collect()
    assert sorted(map(repr, map(tuple, links.override_counts(g).collect()))) == sorted(repr(tuple(r)) for r in want) and len(want) > 60


def test_override_query_makes_no_pairs(spark, monkeypatch):
    """The calls of a chain's top are counted once, not once for each class below it."""
    chain = spark.range(1, 60).selectExpr("concat('K', id) AS from_id", "concat('K', id - 1) AS to_id", "'EXTENDS' AS type")
    top = spark.range(500).selectExpr("concat('f', id) AS from_id", "'K0::m' AS to_id", "'CALLS' AS type")
    deep = CodeGraph.of(spark.range(60).selectExpr("concat('K', id, '::m') AS id", "concat('K', id) AS parent", "'m' AS name", "'method' AS type"), chain.unionByName(top))
    monkeypatch.setattr(graph_queries, "fx1", lambda spark, sf_dir: deep)
    found = registry.queries()["l9_override_calls"](spark, "")
    assert {tuple(r) for r in found.collect()} == {(f"K{i}::m", 500) for i in range(1, 60)} and most_rows(found) < 2000
