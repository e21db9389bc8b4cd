"""Small graphs with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tests.joins import most_rows
from weftgraph.functions import predicates, text
from weftgraph.model import CodeGraph
from weftgraph.operators import analyzers, inheritance, links, lookups, navigation, search, traversal
from weftgraph.sources import graphs


def graph(spark, nodes, edges):
    """nodes: (id, type[, file, visibility, is_abstract]); edges: (from, to, type[, call_type])."""
    n = [(x[0], x[0].rsplit("::", 1)[0] if "::" in x[0] else None, x[1], x[0].rsplit("::", 1)[-1], *[x[k] if len(x) > k else None for k in (2, 3, 4)]) for x in nodes]
    e = [(f"{i}", x[0], x[1], x[2], x[3] if len(x) > 3 else None, i) for i, x in enumerate(edges)]
    return CodeGraph.of(spark.createDataFrame(n, "id string, parent string, type string, name string, file string, visibility string, is_abstract boolean"), spark.createDataFrame(e, "id string, from_id string, to_id string, type string, call_type string, ord long"))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


FLOW = ["Controller::act", "Service::run", "Generator::make", "Query::handle", "Query::load", "Leaf::get"]


@pytest.fixture(scope="module")
def flow(spark):
    calls = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (1, 5)]
    edges = [(FLOW[a], FLOW[b], "CALLS") for a, b in calls] + [(FLOW[0], "Missing::x", "CALLS"), (FLOW[0], "Leaf::get", "CALLS", "OVERRIDE_RESOLVED")]
    return graph(spark, [(x, "method", f"src/{x.split(':')[0]}.php") for x in FLOW], edges)


def test_call_chain_depths(spark, flow):
    chain = lambda **k: {(r.id, r.depth) for r in traversal.call_chain(flow, ids(spark, FLOW[0]), **k).collect()}
    assert chain(depth=1) == {(FLOW[1], 1)}
    assert chain(depth=3) == {(FLOW[1], 1), (FLOW[2], 2), (FLOW[5], 2), (FLOW[3], 3)}
    assert chain(depth=9) == {(FLOW[1], 1), (FLOW[2], 2), (FLOW[5], 2), (FLOW[3], 3), (FLOW[4], 4)}
    assert len(chain(depth=3, limit=2)) == 2


def test_calls_skip_resolved_and_missing(spark, flow):
    assert [r.to_id for r in lookups.outgoing_calls(flow, ids(spark, FLOW[0])).collect()] == [FLOW[1]]
    assert sorted(r.to_id for r in lookups.outgoing_calls(flow, ids(spark, FLOW[0]), include_resolved=True).collect()) == [FLOW[5], FLOW[1]]
    assert [r.from_id for r in lookups.incoming_calls(flow, ids(spark, FLOW[1])).collect()] == [FLOW[0]]


def test_entry_points_count_for_impact_and_traffic(spark):
    g = graph(spark, [("C::m", "method"), ("api:GET:/a", "api_endpoint"), ("api:GET:/b", "api_endpoint"), ("view", "blade_view")], [("api:GET:/a", "C::m", "ROUTES_TO"), ("api:GET:/b", "C::m", "ROUTES_TO"), ("view", "C::m", "BLADE_USES_ACTION")])
    rows = analyzers.change_impact(g, ids(spark, "C::m"), 1).collect()
    assert {(r.id, r.score, r.distance) for r in rows} == {("api:GET:/a", 5.0, 1), ("api:GET:/b", 5.0, 1), ("view", 4.0, 1)}
    top = analyzers.hotspots(g).where("list = 'method'").collect()
    assert [(r.id, r.incoming, r.score) for r in top] == [("C::m", 3, 3)]
    s = analyzers.impact_summary(analyzers.change_impact(g, ids(spark, "C::m"), 1)).first()
    assert (s.score, s.risk, s.direct_callers) == (14.0, "MEDIUM", 3)


def test_impact_counts_each_edge_once(spark):
    g = graph(spark, [(x, "method") for x in "abcd"], [("b", "a", "CALLS"), ("c", "a", "CALLS"), ("d", "b", "CALLS"), ("d", "c", "CALLS"), ("a", "d", "CALLS"), ("b", "c", "CALLS"), ("a", "a", "CALLS")])
    got = {r.id: (r.score, r.distance) for r in analyzers.change_impact(g, ids(spark, "a"), 2).where("direction = 'caller'").collect()}
    assert got == {"b": (8.0, 1), "c": (5.0, 1), "d": (6.0, 2)}


def test_dead_code(spark):
    nodes = [("P", "class"), ("K", "class"), ("P::run", "method", "src/P.php", "public", True), ("K::run", "method", "src/K.php", "public"), ("K::idle", "method", "src/K.php", "public"), ("K::used", "method", "src/K.php", "public"), ("K::__construct", "method", "src/K.php", "public"), ("K::own", "method", "src/K.php", "private"), ("I::go", "method", "src/I.php", "public"), ("I", "interface"), ("T::x", "method", "src/tests/T.php", "public"), ("UserController::index", "method", "src/U.php", "public"), ("BaseThing::x", "method", "src/B.php", "public"), ("JobRequest::rules", "method", "src/R.php", "public")]
    g = graph(spark, nodes, [("K", "P", "EXTENDS"), ("x", "K::used", "CALLS", "OVERRIDE_RESOLVED")])
    got = {r.id: (r.skipped, r.dead, r.incoming, r.effective) for r in analyzers.dead_code(g).collect()}
    assert got == {
        "P::run": ("abstract_implementation", False, 0, 0), "K::run": ("abstract_implementation", False, 0, 0), "K::idle": (None, True, 0, 0), "K::used": (None, False, 1, 2),
        "K::__construct": ("constructor", False, 0, 0), "I::go": ("interface_method", False, 0, 0), "T::x": ("test_file", False, 0, 0), "UserController::index": ("controller_action", False, 0, 0),
        "BaseThing::x": ("base_class", False, 0, 0), "JobRequest::rules": ("framework_method", False, 0, 0),
    }


def _brute_cycles(edges, longest):
    nodes, have, out = sorted({x for e in edges for x in e}), set(edges), set()
    for n in range(2, longest + 1):
        for p in itertools.permutations(nodes, n):
            if p[0] == min(p) and all((a, b) in have for a, b in zip(p, p[1:] + p[:1])):
                out.add(p)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cycles_match_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a in "abcdef" for b in "abcdef" if rng.random() < 0.4]
    g = graph(spark, [(x, "method") for x in "abcdef"], [(a, b, "CALLS") for a, b in edges for _ in range(2)])
    assert {tuple(r.path) for r in traversal.cycles(g).collect()} == _brute_cycles(edges, 6)


def test_no_cycles(spark):
    assert traversal.cycles(graph(spark, [("a", "method")], [("a", "a", "CALLS")])).collect() == []


def test_closure_and_levels(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 5), (3, 9)], "src long, dst long")
    got = {(r.src, r.dst): r.dist for r in traversal.closure(edges).collect()}
    near = {}
    for s in range(21):
        todo, seen = [s], {s: 0}
        for x in todo:
            for a, b in [(i, i + 1) for i in range(20)] + [(20, 5), (3, 9)]:
                if a == x and b not in seen:
                    seen[b] = seen[x] + 1
                    todo.append(b)
        near |= {(s, d): n for d, n in seen.items() if d != s}
    assert got == near
    seeds = spark.createDataFrame([("x", 0), ("y", 19)], "batch string, node long")
    levels = {(r.batch, r.node): r.lvl for r in traversal.bfs_levels(edges, seeds, 3).collect()}
    assert levels == {("x", 0): 0, ("x", 1): 1, ("x", 2): 2, ("x", 3): 3, ("y", 19): 0, ("y", 20): 1, ("y", 5): 2, ("y", 6): 3}


def test_inheritance_and_actions(spark):
    g = graph(spark, [("A", "class"), ("B", "class"), ("C", "class"), ("A::go", "method"), ("T::fly", "method")], [("B", "A", "EXTENDS"), ("C", "B", "EXTENDS"), ("A", "C", "EXTENDS"), ("B", "T", "USES_TRAIT")])
    wanted = spark.createDataFrame([("C", "go"), ("A", "go"), ("C", "no")], "class string, method string")
    got = {r["class"]: (r.target, r.dist) for r in inheritance.resolve_through_inheritance(g, wanted).collect()}
    assert got == {"C": ("A::go", 2), "A": ("A::go", 0)}
    defined = {r.id: r.defined for r in inheritance.route_action_defined(g, ids(spark, "C::go", "C::fly", "C::no", "closure")).collect()}
    assert defined == {"C::go": True, "C::fly": True, "C::no": False, "closure": True}


def test_resolved_calls(spark):
    g = graph(spark, [("I", "interface"), ("X", "class"), ("Y", "class"), ("X::m", "method"), ("Y::m", "method")], [("X", "I", "IMPLEMENTS"), ("Y", "X", "EXTENDS"), ("c", "I::m", "CALLS"), ("c", "X::m", "CALLS"), ("d", "X::m", "CALLS", "STATIC")])
    assert {(r.from_id, r.to_id, r.call_type) for r in links.interface_calls(g).collect()} == {("c", "X::m", "INTERFACE_RESOLVED")}
    assert {(r.from_id, r.to_id, r.call_type) for r in links.override_calls(g).collect()} == {("c", "Y::m", "OVERRIDE_RESOLVED")}


def test_implementations_ignore_test_doubles(spark):
    g = graph(spark, [("A::m", "method", "src/A.php"), ("F::m", "method", "tests/F.php"), ("B::n", "method", "src/B.php"), ("C::n", "method", "src/C.php")], [("A", "I", "IMPLEMENTS"), ("F", "I", "IMPLEMENTS"), ("B", "J", "IMPLEMENTS"), ("C", "J", "IMPLEMENTS")])
    assert {(r.interface, r.target, r.candidates) for r in lookups.implementations(g).collect()} == {("I", "A::m", 1), ("J", "B::n", 2)}


def test_link_endpoints(spark):
    clients = ids(spark, "http:GET:/api/v3/users/{id}", "http:GET:/posts", "http:POST:/posts", "http:GET:/twice?x=1")
    routes = spark.createDataFrame([("api:GET:users/{user}", None), ("api:GET:/api/posts", "api"), ("api:GET:/TWICE/", None), ("api:GET:twice", None)], "id string, mount string")
    got = {(r.from_id, r.to_id): r.confidence for r in links.link_endpoints(clients, routes).collect()}
    assert got == {("http:GET:/api/v3/users/{id}", "api:GET:users/{user}"): 0.7, ("http:GET:/posts", "api:GET:/api/posts"): 0.8, ("http:GET:/twice?x=1", "api:GET:/TWICE/"): 0.5, ("http:GET:/twice?x=1", "api:GET:twice"): 0.5}


def test_resources_and_views(spark):
    rows = links.expand_resources(spark.createDataFrame([("posts.comments", "resource"), ("tags", "apiResource")], "base string, kind string")).collect()
    assert len(rows) == 14 and ("PATCH", "/posts/{param}/comments/{param}", "update") in {(r.verb, r.path, r.action) for r in rows}
    view = "@extends('layout') @includeIf('a.b') <x-alert.box /> {{ route('home') }} {{ action('C@m') }} {{ $user->name() }}"
    got = {(r.type, r.ref) for r in links.scan_views(spark.createDataFrame([("v.blade.php", view)], "file string, text string")).collect()}
    assert got == {("BLADE_EXTENDS", "layout"), ("BLADE_INCLUDES", "a.b"), ("BLADE_INCLUDES", "alert.box"), ("BLADE_USES_ROUTE", "home"), ("BLADE_USES_ACTION", "C@m"), ("BLADE_METHOD_CALL", "name")}


def test_http_navigation(spark):
    g = graph(spark, [("http:GET:/api/v2/a", "http_endpoint"), ("api:GET:/api/v2/a", "api_endpoint"), ("api:GET:/api/v1/a", "api_endpoint")], [("page", "http:GET:/api/v2/a", "HTTP_REQUEST"), ("http:GET:/api/v2/a", "api:GET:/api/v2/a", "RESOLVES_TO"), ("http:GET:/api/v2/a", "api:GET:/api/v1/a", "RESOLVES_TO"), ("api:GET:/api/v2/a", "New::a", "ROUTES_TO"), ("api:GET:/api/v1/a", "Old::a", "ROUTES_TO")])
    assert {(r.client, r.handler) for r in navigation.http_downstream(g).collect()} == {("page", "New::a")}
    assert {(r.handler, r.client) for r in navigation.http_upstream(g).collect()} >= {("New::a", "page"), ("Old::a", "page")}


def test_related_tests(spark):
    g = graph(spark, [("App\\Order::pay", "method", "src/Order.php"), ("T1::a", "method", "tests/AnyTest.php"), ("T2::b", "method", "tests/OrderTest.php"), ("S::c", "method", "src/S.php")], [("T1::a", "App\\Order::pay", "CALLS"), ("S::c", "App\\Order::pay", "CALLS")])
    got = [(r.file, r.how) for r in navigation.related_tests(g, ids(spark, "App\\Order::pay")).orderBy("how").collect()]
    assert got == [("tests/AnyTest.php", 0), ("tests/OrderTest.php", 1)]


def test_freshness_and_confidence(spark):
    meta = spark.createDataFrame([("scanned_at", "2024-01-01T00:00:00Z"), ("git_commit", "abc")], "key string, value string")
    now = F.to_timestamp(F.lit("2024-01-16 01:00:00"))
    r = navigation.freshness(meta, now, "abd").first()
    assert (r.age_days, r.drifted, r.stale) == (15, True, True)
    assert not navigation.freshness(meta, F.to_timestamp(F.lit("2024-01-02 00:00:00")), "abc").first().stale
    rows = spark.createDataFrame([(1, 950, False, 1, True, 1, 3, False, 0, 0), (2, 600, False, 2, True, 1, 3, False, 0, 0), (3, 100, True, 2, True, 1, 0, False, 20, 3)], "k int, score int, ambiguous boolean, handlers int, action_defined boolean, entries int, files int, drifted boolean, age_days int, gaps int")
    assert [r.level for r in navigation.confidence(rows).orderBy("k").collect()] == ["high", "medium", "low"]


def test_search_and_features(spark, flow):
    assert search.query_variants("useOrderList") == [("useOrderList", "raw"), ("use-order-list", "kebab"), ("use_order_list", "snake"), ("use order list", "spaced"), ("use", "token"), ("Order", "token"), ("List", "token")]
    assert search.find(flow, "query::load").first().id == "Query::load"
    files = [r.file for r in navigation.locate(flow, "Service").collect()]
    assert files[0] == "src/Service.php" and "src/Query.php" in files


@pytest.mark.parametrize("file, role", [("src/a.php", "source"), ("tests/a.php", "test"), ("src/ATest.php", "test"), ("src/a.spec.ts", "test"), ("db/migrations/x.php", "migration"), ("x/2024_01_02_030405_y.php", "migration"), ("a/Fixtures/b.json", "fixture"), (None, "source"), ("", "source"), ("a\\tests\\b.php", "test")])
def test_file_roles(spark, file, role):
    assert spark.createDataFrame([(file,)], "file string").select(predicates.file_role(F.col("file"))).first()[0] == role


@pytest.mark.parametrize("path, normal, bare", [("/api/v3/users/{id}/", "api/v3/users/{param}", "users/{param}"), ("//a//b", "a/b", "a/b"), ("", "/", "/"), ("/", "/", "/"), ("apiary/x", "apiary/x", "apiary/x")])
def test_route_paths(spark, path, normal, bare):
    r = spark.createDataFrame([(path,)], "p string").select(text.normalize_route_path(F.col("p")), text.strip_api_prefix(F.col("p"))).first()
    assert tuple(r) == (normal, bare)


def test_divergent_terms(spark):
    a, b = text.divergent_terms(F.col("a"), F.col("b"))
    r = spark.createDataFrame([("src/orders/OrderList.vue", "SRC/orders/UserList.vue"), ("same.vue", "same.vue")], "a string, b string").select(F.array_sort(a), F.array_sort(b)).collect()
    assert list(r[0]) == [["list", "order"], ["list", "user"]] and list(r[1]) == [["same"], ["same"]]


def test_layers(spark):
    rows = spark.createDataFrame([("App\\Http\\X::m",), ("App\\Domain\\Http\\X",), ("App\\Services\\X",), ("App\\MyService",)], "id string").select(predicates.layer_strict(F.col("id")), predicates.layer_loose(F.col("id"))).collect()
    assert [tuple(r) for r in rows] == [("Http", "Http"), ("Domain", "Http"), ("Services", "Service"), (None, "Service")]


def test_graph_tables(spark, flow, tmp_path):
    graphs.write_parquet(flow, str(tmp_path / "g"))
    again = graphs.read_parquet(spark, str(tmp_path / "g"))
    assert sorted(r.id for r in again.nodes.collect()) == sorted(FLOW) and again.edges.count() == flow.edges.count()
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "a", "type": "class", "name": "a"}], "edges": [{"from": "a", "to": "b", "type": "CALLS", "callType": "STATIC"}]}')
    g = graphs.read_json(spark, str(tmp_path / "g.json"))
    assert g.nodes.first().id == "a" and tuple(g.edges.select("id", "from_id", "call_type").first()) == ("a-b-CALLS", "a", "STATIC")
    meta = spark.createDataFrame([("scanned_at", "2024-01-01 00:00:00"), ("git_commit", "abc")], "key string, value string")
    odd = CodeGraph.of(flow.nodes.withColumn("keywords", F.array(F.lit("k"), F.lit("ü"))).unionByName(spark.createDataFrame([("n", None)], "id string, type string"), allowMissingColumns=True), flow.edges.withColumn("confidence", F.lit(0.5)), meta)
    for write, read in ((graphs.write_parquet, graphs.read_parquet), (graphs.write_json, graphs.read_json)):
        write(odd, str(tmp_path / write.__name__))
        back = read(spark, str(tmp_path / write.__name__))
        for part in ("nodes", "edges", "meta"):
            old = getattr(odd, part)
            assert sorted(map(str, getattr(back, part).select(*old.columns).collect())) == sorted(map(str, old.collect())), (write, part)
        assert navigation.freshness(back.meta, head="abd").first().drifted
    both = graphs.merge(g, graph(spark, [("a", "method"), ("z", "class")], []))
    assert {(r.id, r.type) for r in both.nodes.collect()} == {("a", "class"), ("z", "class")}


def test_upserts(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, ord long, file string")
    assert {(r.id, r.file) for r in graphs.keep_last(df, ["id"]).collect()} == {("a", "y"), ("b", "z")}
    assert {(r.id, r.file) for r in graphs.keep_first_file(df).collect()} == {("a", "x"), ("b", "z")}


def test_source_files(spark, tmp_path):
    for name in ("a.php", "sub/b.php", "vendor/c.php", ".git/d.php", "tests/e.php", "f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"<?php // {name}")
    got = lambda **k: sorted(r.file for r in graphs.source_files(spark, str(tmp_path), ["php"], **k).collect())
    assert got() == ["a.php", "sub/b.php", "tests/e.php"] and got(exclude_tests=True) == ["a.php", "sub/b.php"]


def test_field_edges(spark):
    edges = spark.createDataFrame(
        [("m", "request_field:a", "READS_FIELD", None), ("m", "request_field:b", "READS_FIELD", None), ("request_field:a", "v", "ASSIGNS", None), ("v", "K::m", "FLOWS_TO", "x"), ("w", "K::m", "FLOWS_TO", None), ("v", "K::m::$p", "ARGUMENT_TO", "x")],
        "from_id string, to_id string, type string, via string",
    )
    assert {(r.from_id, r.to_id) for r in lookups.field_intake(edges).collect()} == {("request_field:a", "v"), ("m", "request_field:b")}
    assert {(r.from_id, r.type) for r in lookups.field_flow(edges).where("type LIKE '%TO'").collect()} == {("w", "FLOWS_TO"), ("v", "ARGUMENT_TO")}


def test_arguments_and_views(spark):
    g = CodeGraph.of(
        spark.createDataFrame([("K::Run", "method", "Run", "public"), ("ref:run", "blade_method_ref", "run", None)], "id string, type string, name string, visibility string"),
        spark.createDataFrame([("v", "K::Run", "FLOWS_TO", 1), ("K::Run", "K::Run::$b", "HAS_PARAMETER", 1), ("K::Run", "K::Run::$a", "HAS_PARAMETER", 0), ("view", "ref:run", "BLADE_METHOD_CALL", None)], "from_id string, to_id string, type string, argument_index int"),
    )
    assert [tuple(r) for r in links.argument_edges(g).collect()] == [("v", "K::Run::$b", 1)]
    assert [tuple(r) for r in links.blade_calls(g).collect()] == [("view", "K::Run")]


def test_pruning_and_ties(spark):
    g = graph(spark, [("js:a", "method")], [("x", "js:a", "CALLS"), ("x", "js:b", "CALLS"), ("x", "P::b", "CALLS")])
    assert sorted(r.to_id for r in links.prune_dangling(g, "CALLS", "js:").edges.collect()) == ["P::b", "js:a"]
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 0)], "k string, s int")
    assert sorted(tuple(r) for r in links.best_by_group(df, "k", "s").collect()) == [("a", 2), ("a", 2), ("b", 0)]


def test_architecture(spark):
    g = graph(spark, [], [("App\\Domain\\A::m", "App\\Http\\B::m", "CALLS"), ("App\\Services\\A", "App\\Http\\B", "DEPENDS_ON"), ("App\\Http\\B::m", "App\\Domain\\A::m", "CALLS"), ("App\\Repository\\R::x", "App\\Services\\Q::query", "CALLS")])
    got = {(r.from_layer, r.to_layer, r.severity, r.reason) for r in analyzers.architecture(g).collect()}
    assert got == {("Domain", "Http", "HIGH", "Domain code should not call Http code."), ("Services", "Http", "MEDIUM", "Services code should not depend on Http code.")}
    assert analyzers.architecture(g, ignore=[text.glob_pattern("App\\Domain\\*")]).count() == 1


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_call_chain_looks_at_reached_callers_only(spark, monkeypatch):
    """Calls between others are not ranked."""
    names = ["s", "a", "b", *(f"x{n}" for n in range(200))]
    g = graph(spark, [(n, "method", "f") for n in names], [("s", "a", "CALLS"), ("a", "b", "CALLS"), *((f"x{n}", f"x{n + 1}", "CALLS") for n in range(199))])
    ranked, first = [], traversal.top_per_group
    monkeypatch.setattr(traversal, "top_per_group", lambda df, *a: ranked.append(df.count()) or first(df, *a))
    assert {(r.id, r.depth, r.parent) for r in traversal.call_chain(g, ids(spark, "s"), 2).collect()} == {("a", 1, "s"), ("b", 2, "a")}
    assert max(ranked) == 1


def test_impact_follows_equal_edges_once(spark):
    """Edges of the first level are joined once, not again where scores are added up."""
    g = graph(spark, [(n, "method", "f") for n in "tab"], [("a", "t", "CALLS")] * 500 + [("b", "a", "CALLS"), ("a", "gone", "CALLS"), ("gone", "t", "CALLS"), ("t", "gone", "CALLS")])
    found = analyzers.change_impact(g, ids(spark, "t", "nowhere"), 2)
    assert {(r.id, r.direction, r.score, r.distance) for r in found.collect()} == {("a", "caller", 2500.0, 1), ("b", "caller", 3.0, 2)}
    assert most_rows(found) < 500


def test_feature_asks_for_the_types_of_shown_files_only(spark):
    nodes = [("pay", "class", "pay.php"), *((f"n{n}", "class", f"n{n:03}.php") for n in range(100))]
    found = navigation.feature(graph(spark, nodes, [("pay", f"n{n}", "CALLS") for n in range(100)]), "pay", 5)
    assert [r.file for r in found.collect()] == ["pay.php", "n000.php", "n001.php", "n002.php", "n003.php"]
    assert most_rows(found) < 100
