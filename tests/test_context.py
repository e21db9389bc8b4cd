import pytest
from pyspark.sql import functions as F

from tests.joins import most_rows
from weftgraph.functions import text
from weftgraph.model import CodeGraph
from weftgraph.operators import context, navigation
from weftgraph.plans import queries as graph_queries
from weftgraph.plans import registry
from weftgraph.sources import graphs


def graph(spark, nodes, edges):
    n = spark.createDataFrame(nodes, "id string, type string, file string, parent string")
    return CodeGraph.of(n, spark.createDataFrame(edges, "from_id string, to_id string, type string"))


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


@pytest.fixture(scope="module")
def vue(spark):
    """A page that renders a loader, a form and a shared button; the loader renders back to the page and a panel."""
    nodes = [(f"js:{f}", "js_module", f, None) for f in ("page.vue", "loader.vue", "form.vue", "button.vue", "panel.vue", "plain.ts", *[f"u{i}.vue" for i in range(8)])]
    nodes += [("js:app/stores/cart.ts::useCart", "js_function", "app/stores/cart.ts", None), ("http:GET:/cart", "http_endpoint", None, None), ("http:GET:/button", "http_endpoint", None, None)]
    draws = [("page.vue::setup", "loader.vue"), ("page.vue", "form.vue"), ("page.vue", "button.vue"), ("page.vue", "plain.ts"), ("loader.vue", "page.vue"), ("loader.vue", "panel.vue"), ("button.vue", "panel.vue")]
    draws += [(f"u{i}.vue", "button.vue") for i in range(8)]
    edges = [(f"js:{a}", f"js:{b}", "RENDERS_COMPONENT") for a, b in draws]
    edges += [("js:panel.vue", "js:app/stores/cart.ts::useCart", "CALLS"), ("js:form.vue", "js:app/stores/cart.ts::useCart", "CALLS"), ("js:app/stores/cart.ts::useCart", "http:GET:/cart", "HTTP_REQUEST"), ("js:button.vue", "http:GET:/button", "HTTP_REQUEST")]
    return graph(spark, nodes, edges)


def test_rendered_flows(spark, vue):
    rows = context.rendered_flows(vue, ids(spark, "js:page.vue")).orderBy(F.desc("score"), "id").collect()
    assert [(r.id, r.depth, r.score) for r in rows] == [("js:form.vue", 1, 85), ("js:button.vue", 1, 60), ("js:panel.vue", 2, 45)]
    assert rows[2].path == ["js:loader.vue", "js:panel.vue"]
    assert rows[0].calls and rows[2].calls == []  # shown with the form


def test_rendered_flows_known_calls_and_nothing_rendered(spark, vue):
    known = spark.createDataFrame([("js:page.vue", "js:app/stores/cart.ts::useCart")], "start string, id string")
    assert [r.id for r in context.rendered_flows(vue, ids(spark, "js:page.vue"), known=known).collect()] == ["js:button.vue"]
    none = context.rendered_flows(vue, ids(spark, "js:plain.ts", "js:missing"))
    assert none.columns == ["start", "id", "depth", "path", "score", "calls", "endpoints"] and none.isEmpty()


def test_warnings_of_a_controller(spark):
    g = graph(spark, [("A\\UserController::show", "method", "a.php", "A\\UserController"), ("A\\Job::run", "method", "b.php", "A\\Job"), ("A\\PostController::store", "method", "c.php", None)],
              [("A\\UserController::show", "A\\Job::run", "CALLS"), ("A\\PostController::store", "request_field:x", "READS_FIELD"), ("A\\PostController::store", "A\\Job::run", "CALLS"), ("api:GET:/p", "A\\PostController::store", "ROUTES_TO")])
    rows = context.navigation_warnings(context.navigation_counts(g, g.nodes.select("id")))
    assert {r.id: r.warnings for r in rows.collect()} == {"A\\UserController::show": ["no_entry", "no_route", "no_fields"], "A\\Job::run": [], "A\\PostController::store": ["no_flow"]}


def test_entries_of_a_route_and_its_handler(spark):
    g = graph(spark, [("api:GET:/x", "api_endpoint", None, None), ("http:GET:/x", "http_endpoint", None, None), ("C::a", "method", None, None), ("D::b", "method", None, None)],
              [("js:p", "http:GET:/x", "HTTP_REQUEST"), ("js:q", "api:GET:/x", "HTTP_REQUEST"), ("http:GET:/x", "api:GET:/x", "RESOLVES_TO"), ("D::b", "C::a", "CALLS"), ("gone", "C::a", "CALLS")])
    pairs = spark.createDataFrame([("api:GET:/x", "C::a")], "endpoint string, handler string")
    got = lambda n: {(r.kind, r.from_id) for r in context.route_scoped_entries(g, pairs, n).collect()}
    assert got(20) == {("http_client", "js:p"), ("http_client", "js:q"), ("call", "D::b")}
    assert got(2) == {("http_client", "js:p"), ("http_client", "js:q")}


def test_matches_by_file_and_in_a_runtime(spark):
    g = graph(spark, [("m", "js_module", "apps\\Web\\useFeature.ts", None), ("m::useFeature", "js_function", "apps/web/useFeature.ts", None), ("n", "js_module", "apps/api/useFeature.ts", None), ("useFeature", "js_function", None, None)], [])
    scopes = spark.createDataFrame([("apps/web", "@org/web", "client"), ("apps/api", "@org/api", "server")], "directory string, workspace string, runtime string")
    all_ = context.find_in(g, "useFeature", scopes, by_file=True).collect()
    assert {(r.id, r.nodes) for r in all_} == {("useFeature", 1), ("m::useFeature", 2), ("n", 1)}
    assert [r.id for r in context.find_in(g, "useFeature", scopes, runtime="server").collect()] == ["n"]
    assert [r.id for r in context.find_in(g, "useFeature", scopes, workspace="WEB", types=["js_function"]).collect()] == ["m::useFeature"]
    assert context.find_in(g, "useFeature", scopes, workspace="eb").isEmpty()


@pytest.mark.parametrize("tag, name", [("user-card", "UserCard"), ("userCard", "UserCard"), ("h-2-x", "H2X"), ("a-B", "A-B"), ("font-face", None), (None, None)])
def test_component_names(spark, tag, name):
    assert spark.createDataFrame([(tag,)], "t string").select(text.component_name(F.col("t"))).first()[0] == name


@pytest.mark.parametrize("asked, path", [("${host}/api/v2/items/${id}?x=1", "/api/v2/items/{param}"), ("{host}{x}items//a", "/items/a"), ("", "/"), ("items", "/items"), ("/a b", "/a b")])
def test_fetch_paths(spark, asked, path):
    assert spark.createDataFrame([(asked,)], "t string").select(text.fetch_path(F.col("t"))).first()[0] == path


def test_several_roots_and_snippets(spark, tmp_path):
    for root in ("one", "two"):
        (tmp_path / root / "src").mkdir(parents=True)
        (tmp_path / root / "src" / "a.php").write_text(f"<?php\r\n\n   {root}();\n\nlast\n")
    files = graphs.source_roots(spark, [str(tmp_path / "one"), str(tmp_path / "two") + "/"], ["php"])
    assert {r.file for r in files.collect()} == {"one/src/a.php", "two/src/a.php"}
    assert [r.file for r in graphs.source_roots(spark, [str(tmp_path / "one")], ["php"]).collect()] == ["src/a.php"]
    places = spark.createDataFrame([("x", "one/src/a.php", 1), ("y", "app/two/src/a.php", 0), ("z", "one/src/a.php", None), ("w", "gone.php", 0), ("v", "one/src/a.php", 99)], "id string, file string, start_row int")
    got = {r.id: r.lines for r in graphs.snippets(files, places).collect()}
    assert got == {"x": ["3| one();", "5| last"], "y": ["1| <?php", "3| two();"]}


def test_route_scoped_entries_meet_only_the_first_clients_and_callers(spark):
    nodes = spark.range(400).selectExpr("concat('k', lpad(id, 3, '0')) AS id", "'method' AS type").unionByName(spark.createDataFrame([("api:GET:/x", "api_endpoint")], "id string, type string"))
    asks = spark.range(400).selectExpr("concat('k', lpad(id, 3, '0')) AS from_id", "'api:GET:/x' AS to_id", "'HTTP_REQUEST' AS type")
    calls = spark.range(400).selectExpr("concat('k', lpad(id, 3, '0')) AS from_id", "'H000' AS to_id", "'CALLS' AS type")
    pairs = spark.range(400).selectExpr("'api:GET:/x' AS endpoint", "concat('H', lpad(id, 3, '0')) AS handler")
    got = context.route_scoped_entries(CodeGraph.of(nodes, asks.unionByName(calls)), pairs, 5)
    rows = got.collect()
    assert len(rows) == 2000 and {(r.kind, r.from_id) for r in rows} == {("http_client", f"k00{i}") for i in range(5)}
    assert most_rows(got) <= 2000


def test_warnings_count_only_edges_that_matter(spark):
    """Resolved calls and dependencies make no rows, and an edge only those of the ends that it counts for."""
    edges = [("a", "b", "CALLS", "OVERRIDE_RESOLVED")] * 50 + [("a", "b", "DEPENDS_ON", None)] * 50 + [("a", "b", "CALLS", None), ("r", "a", "ROUTES_TO", None)]
    g = CodeGraph.of(spark.createDataFrame([("a",), ("b",), ("r",)], "id string"), spark.createDataFrame(edges, "from_id string, to_id string, type string, call_type string"))
    counts = context.navigation_counts(g, g.nodes.select("id"))
    assert {(r.id, r.routes, r.callers, r.callees) for r in counts.collect()} == {("a", 1, 0, 1), ("b", 0, 1, 0), ("r", 0, 0, 0)}
    assert most_rows(counts, "Generate") <= 4


def test_every_handler_counts_for_the_data_layer(spark, monkeypatch):
    """The last handler of many, and the last callee of many, decide as the first would; what reaches only itself does not."""
    calls = [("api:a", f"C{i:02}::act", "ROUTES_TO") for i in range(30)] + [("C29::act", f"S::m{i:02}", "CALLS") for i in range(40)] + [("S::m39", "OrderRepository::load", "CALLS")]
    own = [("api:b", "R1Repository::x", "ROUTES_TO"), ("R1Repository::x", "T::y", "CALLS"), ("T::y", "R1Repository::x", "CALLS")]
    edges = spark.createDataFrame(calls + own, "from_id string, to_id string, type string")
    ids = sorted({e[k] for e in calls + own for k in (0, 1)})
    g = CodeGraph.of(spark.createDataFrame([(i, "api_endpoint" if i.startswith("api:") else "method") for i in ids], "id string, type string"), edges)
    monkeypatch.setattr(graph_queries, "fx1", lambda spark, sf_dir: g)
    assert [tuple(r) for r in registry.queries()["a17_data_layer_reach"](spark, "").collect()] == [(2, 1)]
    starts = spark.createDataFrame([(i,) for i in ids], "id string")
    assert {(r.start, r.depth) for r in navigation.data_layer_reach(g, starts, 3).collect()} == {("S::m39", 1), ("C29::act", 2), ("T::y", 1)}
