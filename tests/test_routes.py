import pytest
from pyspark.sql import functions as F

from tests.joins import most_rows
from weftgraph.model import CodeGraph
from weftgraph.operators import navigation, routes, traversal
from weftgraph.plans import registry
from weftgraph.plans import requests as request_queries  # noqa: F401  registers its queries

ENDS = [
    ("api:GET:config/settings", "apps/front/routes/api.v3.php"),
    ("api:GET:items/{param}/views", "apps/front/routes/api.v3.php"),
    ("api:GET:items/{param}/views/metadata", "apps/front/routes/api.v3.php"),
    ("api:POST:users/{param}/settings", "routes/api.php"),
    ("api:DELETE:events/{param}", "routes/web.php"),
    ("api:GET:internal/api/v1/reports", "routes/api.php"),
    ("api:POST:api/v3/items/{param}/check", "k6/helpers.js"),
    ("api:GET:/items/{param}", "apps/api/routes/api.v3.php"),
    ("api:GET:/baseItems/{param}", "apps/admin/routes/api.php"),
    ("http:GET:/api/v3/items/{param}", "packages/sdk/useItem.ts"),
]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(i, i.split(":")[0] + "_endpoint", f) for i, f in ENDS], "id string, type string, file string")
    return CodeGraph.of(nodes, spark.createDataFrame([], "id string, from_id string, to_id string, type string"))


@pytest.mark.parametrize("query, want", [
    ("GET /api/v3/config/settings", {"api:GET:config/settings"}),
    ("api:GET:/api/v3/config/settings", {"api:GET:config/settings"}),
    ("GET /api/v3/items/{itemId}", {"api:GET:/items/{param}", "http:GET:/api/v3/items/{param}"}),
    ("GET /api/v3/items/{itemId}/views", {"api:GET:items/{param}/views"}),
    ("POST /api/v2/users/{userId}/settings", {"api:POST:users/{param}/settings"}),
    ("delete /api/v1/events/{eventId}", {"api:DELETE:events/{param}"}),
    ("GET /internal/api/v1/reports", {"api:GET:internal/api/v1/reports"}),
    ("POST api/v3/items/{x}/check", {"api:POST:api/v3/items/{param}/check"}),
    ("GET nothing/here", set()),
])
def test_routes_for(spark, graph, query, want):
    got = routes.routes_for(graph, spark.createDataFrame([(query,)], "query string")).collect()
    assert {r.id for r in got} == want


def test_request_parts(spark):
    asked = ["GET /api/v3/items/{itemId}/", "http:get:/a//b", "api:post:/api/v1", "/api/x", "word", "  put  /x ", "//"]
    got = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, q string").select("i", routes.request(F.col("q")).alias("r")).orderBy("i").collect()
    assert [tuple(r.r) for r in got] == [("GET", "api/v3/items/{param}", "items/{param}"), ("GET", "a/b", "a/b"), ("POST", "api/v1", "/"), (None, "api/x", "x"), (None, "word", "word"), ("PUT", "x", "x"), (None, "/", "/")]


def test_file_prefix(spark):
    files = {"routes/api.v3.php": "api/v3", "a/api.php": "api", "routes/web.php": None, "my-api_v2.ts": "api/v2", "apis.php": None, "API.V1.PHP": "api/v1", None: None}
    got = spark.createDataFrame([(f,) for f in files], "f string").select("f", routes.file_prefix(F.col("f")).alias("p")).collect()
    assert {r.f: r.p for r in got} == files


def test_follow_ups_and_plan(spark):
    one = spark.range(1).select(routes.request(F.lit("DELETE /api/v1/events/{eventId}")).alias("r")).select(routes.endpoint_ids(F.col("r")).alias("ids"), routes.path_terms(F.col("r.requested")).alias("terms"), routes.follow_ups(F.col("r")).alias("next")).first()
    assert "api:DELETE:events/{param}" in one.ids and one.terms == ["events"]
    assert one.next == ["events/{param}", "api/v1/events/{param}", "events"]


def test_nearest_source_however_far_up(spark):
    rows = [("n0", None, "a.php")] + [(f"n{i}", f"n{i - 1}", None) for i in range(1, 12)] + [("x", "y", None), ("y", "x", None)]
    g = CodeGraph.of(spark.createDataFrame(rows, "id string, parent string, file string"), spark.createDataFrame([], "from_id string, to_id string"))
    assert {r.id: r.source for r in navigation.nearest_source(g).collect()} == {f"n{i}": "n0" for i in range(12)}


def test_closure_has_no_depth_limit(spark):
    got = traversal.closure(spark.range(150).selectExpr("id AS src", "id + 1 AS dst"))
    assert got.count() == 150 * 151 // 2 and got.where("src = 0").agg(F.max("dist")).first()[0] == 150


def test_cycles_tell_when_they_stop(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 5}", "CALLS") for i in range(5)]
    g = CodeGraph.of(spark.createDataFrame([(f"n{i}",) for i in range(5)], "id string"), spark.createDataFrame(ring, "from_id string, to_id string, type string"))
    short, cut_off = traversal.cycles_up_to(g, 3)
    assert short.count() == 0 and cut_off
    whole, more = traversal.cycles_up_to(g, 6)
    assert [r.length for r in whole.collect()] == [5] and not more


def test_middleware_of_a_route_without_limit(spark):
    nodes = spark.createDataFrame([(f"mw:{i:02}", f"m{i:02}") for i in range(30)], "id string, name string")
    edges = spark.createDataFrame([("api:GET:/a", f"mw:{i % 30:02}", "USES_MIDDLEWARE") for i in range(60)], "from_id string, to_id string, type string")
    g = CodeGraph.of(nodes, edges)
    assert navigation.route_middleware(g, None).count() == 30 and navigation.route_middleware(g).count() == 12


def test_middleware_query_gives_all_of_every_route(spark, tmp_path):
    brands = spark.range(25).selectExpr("150 * id AS p_partkey", "concat('Brand#', id) AS p_brand", "1 AS p_size")
    brands.write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1).selectExpr("id AS l_suppkey", "id AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert registry.queries()["g33_route_middleware"](spark, str(tmp_path)).count() == 25


def test_repeated_edges_do_not_multiply(spark):
    ask = spark.range(3000).selectExpr("concat('c', id % 3) AS from_id", "'http:GET:/api/v1/x' AS to_id", "'HTTP_REQUEST' AS type")
    rest = spark.range(6000).selectExpr("if(id % 2 = 0, 'http:GET:/api/v1/x', concat('api:GET:/api/v', id % 4, '/x')) AS from_id", "if(id % 2 = 0, concat('api:GET:/api/v', id % 4 + 1, '/x'), concat('C', id % 5, '::act')) AS to_id", "if(id % 2 = 0, 'RESOLVES_TO', 'ROUTES_TO') AS type")
    g = CodeGraph.of(spark.createDataFrame([("http:GET:/api/v1/x", "http_endpoint"), ("api:GET:/api/v1/x", "api_endpoint"), ("api:GET:/api/v3/x", "api_endpoint")], "id string, type string"), ask.unionByName(rest))
    got = navigation.http_downstream(g)
    assert [(r.client, r.handler, r.score) for r in got.orderBy("client", "handler").collect()] == [(f"c{c}", f"C{k}::act", 100) for c in range(3) for k in range(5)]
    assert len(navigation.http_downstream(g, 2).collect()) == 6
    # no join gives more rows than there are edges
    assert most_rows(got) <= 9000


def test_downstream_query_gives_all_of_every_client(spark, tmp_path):
    """A client of fifty endpoints has a row for each, and one for each of an endpoint's handlers."""
    spark.range(50).selectExpr("id AS l_partkey", "1 AS l_suppkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(50).selectExpr("id AS p_partkey", "0 AS p_size", "'b' AS p_brand").unionByName(spark.range(39).selectExpr("150 * id AS p_partkey", "0 AS p_size", "'b' AS p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    rows = registry.queries()["j4_http_downstream"](spark, str(tmp_path)).collect()
    assert len({r.endpoint for r in rows}) == 50 and len(rows) == 49 + 4
