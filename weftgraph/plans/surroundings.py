"""Registered queries of what surrounds a node, and of rendered components, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.model import CodeGraph
from weftgraph.operators import context
from weftgraph.plans.fixtures import FX1_WITH, duck, fx1, spark_sql
from weftgraph.plans.registry import register


def _c(key: str) -> str:
    return f"concat('js:v/c', lpad(cast({key} as string), 8, '0'), '.vue')"


#: Components of parts: each renders four others, a shared one and sometimes the next; they call composables, stores and helpers.
_PARENT = _c("cast(floor(p_partkey / 4) as bigint)")
VUE_EDGES = f"""
SELECT concat({_PARENT}, '::setup') AS from_id, {_c('p_partkey')} AS to_id, 'RENDERS_COMPONENT' AS type FROM @part
UNION ALL SELECT {_c('p_partkey')}, concat('js:v/base', cast(p_size % 5 as string), '.vue'), 'RENDERS_COMPONENT' FROM @part
UNION ALL SELECT {_c('p_partkey')}, {_c('p_partkey + 1')}, 'RENDERS_COMPONENT' FROM @part WHERE p_size > 25
UNION ALL SELECT {_c('p_partkey')}, concat('js:lib/s.js::useS', cast(p_size % 13 as string)), 'CALLS' FROM @part WHERE p_size % 2 = 0
UNION ALL SELECT {_c('p_partkey')}, concat('js:app/stores/t', cast(p_size % 7 as string), '.js::open'), 'CALLS' FROM @part WHERE p_size % 3 = 0
UNION ALL SELECT {_c('p_partkey')}, concat('js:lib/u.js::fmt', cast(p_size % 3 as string)), 'CALLS' FROM @part
UNION ALL SELECT {_c('p_partkey')}, concat('http:POST:/c', cast(p_partkey as string)), 'HTTP_REQUEST' FROM @part WHERE p_size % 11 = 0
UNION ALL SELECT DISTINCT concat('js:lib/s.js::useS', cast(p_size % 13 as string)), concat('http:GET:/s', cast(p_size % 13 as string)), 'HTTP_REQUEST' FROM @part WHERE p_size % 13 < 5
"""
_VUE = f"WITH edges AS ({duck(VUE_EDGES)}) "


def vue_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Components, what they render, call and request."""
    e = spark_sql(spark, sf_dir, VUE_EDGES)
    ids = e.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    kind = F.when(F.col("id").startswith("http:"), "http_endpoint").when(F.col("id").contains("::"), "js_function").otherwise("js_module")
    file = F.when(F.col("id").startswith("js:"), F.regexp_extract("id", "^js:([^:]*)", 1))
    return CodeGraph.of(ids.select("id", kind.alias("type"), file.alias("file")), e)


@register("g14_rendered_flows", _VUE + """
, r AS (SELECT DISTINCT split_part(from_id, '::', 1) AS parent, to_id AS id FROM edges WHERE type = 'RENDERS_COMPONENT'),
fan AS (SELECT id, count(DISTINCT parent) AS fan_in FROM r GROUP BY 1),
a1 AS (SELECT r.parent AS start, r.id, fan_in, row_number() OVER (PARTITION BY r.parent ORDER BY fan_in, r.id) AS rk FROM r JOIN fan USING (id) WHERE r.id <> r.parent),
a2 AS (SELECT start, id, fan_in, row_number() OVER (PARTITION BY start ORDER BY fan_in, id) AS rk FROM (SELECT DISTINCT a1.start, r.id, fan.fan_in FROM a1 JOIN r ON r.parent = a1.id JOIN fan ON fan.id = r.id WHERE a1.rk <= 12 AND a1.fan_in < 8 AND r.id <> a1.start) n ANTI JOIN a1 USING (start, id)),
k AS (SELECT start, id, fan_in, 1 AS depth FROM a1 WHERE rk <= 12 UNION ALL SELECT start, id, fan_in, 2 FROM a2 WHERE rk <= 12),
calls AS (SELECT DISTINCT from_id AS id, to_id AS call FROM edges WHERE type = 'CALLS'),
asks AS (SELECT id, to_id AS endpoint FROM (SELECT id, call FROM calls UNION SELECT id, id FROM k) x JOIN edges e ON e.from_id = x.call AND e.type = 'HTTP_REQUEST'),
h AS (SELECT id, count(DISTINCT endpoint) AS n_http FROM asks GROUP BY 1),
c AS (SELECT id, count(*) AS n_calls, count_if(call LIKE '%::use%' OR call LIKE '%/stores/%') AS n_state FROM calls GROUP BY 1),
s AS (SELECT k.*, coalesce(n_http, 0) AS n_http, coalesce(n_state, 0) AS n_state, (100 * coalesce(n_http, 0) + 20 * coalesce(n_state, 0) + 5 * coalesce(n_calls, 0) - 40 * depth)::BIGINT AS score FROM k LEFT JOIN h USING (id) LEFT JOIN c USING (id)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, depth, id) AS place FROM s WHERE n_http > 0 OR (fan_in < 8 AND n_state > 0)) WHERE place <= 3),
shown AS (SELECT start, arg_min(id, place) AS id, call FROM b JOIN calls USING (id) GROUP BY start, call)
SELECT b.start, b.id, b.depth, b.score, b.n_http, count(shown.call) AS n_calls FROM b LEFT JOIN shown ON shown.start = b.start AND shown.id = b.id GROUP BY ALL
""")  # fmt: skip
def g14_rendered_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components below every component that request or hold something."""
    g = vue_graph(spark, sf_dir)
    flows = context.rendered_flows(g, g.nodes.where("type = 'js_module'").select("id"))
    return flows.select("start", "id", "depth", "score", F.size("endpoints").cast("long").alias("n_http"), F.size("calls").cast("long").alias("n_calls"))


@register("g2_sfc_modules", "SELECT DISTINCT concat('v/c', p_partkey, '.vue') AS id, concat('js:v/c', p_partkey, '.vue') AS module FROM part WHERE p_size > 10")
def g2_sfc_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The module of every component whose module was read."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    file = F.concat(F.lit("v/c"), "p_partkey", F.lit(".vue"))
    nodes = p.select(file.alias("id"), F.lit("vue_component").alias("type"), file.alias("file")).unionByName(p.where("p_size > 10").select(F.concat(F.lit("js:"), file).alias("id"), F.lit("js_module").alias("type"), file.alias("file")))
    edges = spark.createDataFrame([], "from_id string, to_id string, type string")
    return context.sfc_modules(CodeGraph.of(nodes, edges))


@register("g32_outbound_bridges", _VUE + """
, x AS (SELECT DISTINCT from_id, to_id AS endpoint FROM edges WHERE type = 'HTTP_REQUEST'),
o AS (SELECT from_id AS id, from_id, endpoint FROM x UNION SELECT split_part(from_id, '::', 1), from_id, endpoint FROM x)
SELECT id, from_id, endpoint FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY from_id <> id, endpoint, from_id) AS n FROM o) WHERE n <= 4
""")  # fmt: skip
def g32_outbound_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of every module, function and component."""
    g = vue_graph(spark, sf_dir)
    return context.outbound_bridges(g, g.edges.select(F.explode(F.array("from_id", F.substring_index("from_id", "::", 1))).alias("id")).distinct())


@register("j8_important_methods", FX1_WITH + """
, m AS (SELECT parent, id, (SELECT count(*) FROM visible v WHERE v.from_id = nodes.id) AS outgoing, (SELECT count(*) FROM visible v WHERE v.to_id = nodes.id) AS incoming FROM nodes WHERE type = 'method' AND parent IN (SELECT id FROM nodes))
SELECT parent, id, outgoing, incoming FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY outgoing + incoming DESC, id) AS n FROM m) WHERE n <= 1
""")  # fmt: skip
def j8_important_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The method with the most calls of every class."""
    g = fx1(spark, sf_dir)
    return context.important_methods(g, g.nodes.where("type = 'class'").select("id"), 1)


@register("ga6_call_kinds", FX1_WITH + """
, n AS (SELECT to_id, coalesce(call_type, type) AS kind, count(*) AS n FROM edges GROUP BY 1, 2)
SELECT to_id, string_agg(concat(kind, '(', n, ')'), ', ' ORDER BY n DESC, kind) AS kinds FROM n GROUP BY 1
""")  # fmt: skip
def ga6_call_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of edges into every node, as text."""
    return context.call_kinds(fx1(spark, sf_dir).edges, ["to_id"])


@register("ga9_matches_by_file", FX1_WITH + """
, s AS (SELECT id, type, file, CASE WHEN contains(lower(id), 'supplier') THEN 930 WHEN contains(lower(name), 'supplier') THEN 880 ELSE 830 END AS score FROM nodes WHERE contains(lower(id), 'supplier') OR contains(lower(name), 'supplier') OR contains(lower(file), 'supplier')),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS place, count(*) OVER (PARTITION BY file) AS nodes FROM s)
SELECT id, type, file, score::INT AS score, nodes, (SELECT string_agg(DISTINCT t.type, '+' ORDER BY t.type) FROM s t WHERE t.file = r.file) AS types FROM r WHERE place = 1 AND file LIKE 'app/infrastructure/%' ORDER BY score DESC, id LIMIT 20
""")  # fmt: skip
def ga9_matches_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best files that match `supplier` in the workspace of the infrastructure."""
    scopes = spark.createDataFrame([("app", "org/App", "server"), ("app/infrastructure", "org/Infra", "server"), ("routes", "org/Infra", "edge")], "directory string, workspace string, runtime string")
    found = context.find_in(fx1(spark, sf_dir), "supplier", scopes, workspace="infra", runtime="server", by_file=True)
    return found.withColumn("types", F.array_join("types", "+"))


@register("g25_route_scoped_entries", FX1_WITH + """
, p AS (SELECT DISTINCT from_id AS endpoint, to_id AS handler FROM edges WHERE type = 'ROUTES_TO'),
x AS (SELECT p.endpoint, p.handler, 'http_client' AS kind, concat('js:', n.name) AS from_id FROM p JOIN nodes n ON n.type = 'class' AND n.id = split_part(p.handler, '::', 1))
SELECT endpoint, handler, kind, from_id FROM (SELECT *, row_number() OVER (PARTITION BY endpoint, handler ORDER BY from_id) AS n FROM
  (SELECT p.endpoint, p.handler, 'http_client' AS kind, x.from_id FROM p JOIN (SELECT DISTINCT endpoint, from_id FROM x) x USING (endpoint))) WHERE n <= 5
""")  # fmt: skip
def g25_route_scoped_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients of every route with each of its handlers: the classes of the customers behind it."""
    g = fx1(spark, sf_dir)
    routes = g.edges.where("type = 'ROUTES_TO'")
    names = g.nodes.where("type = 'class'").select(F.col("id").alias("class"), "name")
    asks = routes.withColumn("class", F.substring_index("to_id", "::", 1)).join(names, "class").select(F.concat(F.lit("js:"), "name").alias("from_id"), F.col("from_id").alias("to_id"), F.lit("HTTP_REQUEST").alias("type"))
    all_ = CodeGraph.of(g.nodes, g.edges.unionByName(asks, allowMissingColumns=True))
    return context.route_scoped_entries(all_, routes.select(F.col("from_id").alias("endpoint"), F.col("to_id").alias("handler")), 5)


@register("g30_navigation_warnings", FX1_WITH + """
, w AS (SELECT n.id, EXISTS (SELECT 1 FROM edges e WHERE e.to_id = n.id AND e.type = 'ROUTES_TO') AS routed, EXISTS (SELECT 1 FROM visible e WHERE e.to_id = n.id) AS called FROM nodes n)
SELECT CASE WHEN routed OR called THEN '' ELSE 'no_entry' END AS warnings, count(*) AS n FROM w GROUP BY 1
""")  # fmt: skip
def g30_navigation_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes have which warnings (no class of the commerce graph is named a controller)."""
    g = fx1(spark, sf_dir)
    rows = context.navigation_warnings(context.navigation_counts(g, g.nodes.select("id")))
    return rows.groupBy(F.array_join("warnings", "+").alias("warnings")).agg(F.count("*").alias("n"))


@register("g34_factory_dependencies", FX1_WITH + """
SELECT m.id, e.to_id AS needs FROM nodes m JOIN (SELECT DISTINCT from_id, to_id FROM edges WHERE type = 'DEPENDS_ON') e ON e.from_id = m.parent WHERE m.type = 'method' AND m.parent LIKE '%Supplier%'
""")  # fmt: skip
def g34_factory_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suppliers' methods depend on, were suppliers named factories."""
    g = fx1(spark, sf_dir)
    named = lambda c: F.replace(F.col(c), F.lit("Supplier"), F.lit("SupplierFactory"))
    twin = CodeGraph(g.nodes.withColumn("parent", named("parent")), g.edges.withColumn("from_id", F.when(F.col("type") == "DEPENDS_ON", named("from_id")).otherwise(F.col("from_id"))))
    return context.factory_dependencies(twin, g.nodes.where("type = 'method'").select("id"))


#: How a page's path is asked for in code.
_ASKED = "concat(CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('$', '{host}') WHEN 2 THEN concat('$', '{host}/api/v2') ELSE '{base}{more}x' END, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1))"


@register("c22_fetch_paths", f"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace({_ASKED}, '\\$\\{{[^}}]+\\}}', '{{param}}', 'g'), '/+', '/', 'g') AS p FROM pages WHERE url IS NOT NULL)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN CASE WHEN p = '' THEN '/' ELSE p END WHEN 1 THEN CASE WHEN p = '{{param}}' THEN '/' ELSE substr(p, 8) END WHEN 2 THEN CASE WHEN contains(p, 'api/v2/') THEN regexp_extract(substr(p, 8), '^[^?\\s]*') ELSE substr(p, 8) END ELSE concat('/', substr(p, 13)) END AS path FROM p
""")  # fmt: skip
def c22_fetch_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path that code asks for, for every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where("url IS NOT NULL")
    return pages.select("page_id", text.fetch_path(F.expr(_ASKED)).alias("path"))


@register("c33_locations", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 5 > 0 THEN concat('f', l_suppkey, ':', coalesce(CASE WHEN l_quantity > 10 THEN l_linenumber END::VARCHAR, '?'), '-', coalesce(CASE WHEN l_quantity > 20 THEN l_partkey END::VARCHAR, '?')) END AS place FROM lineitem")
def c33_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item as a place in a file."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    file = F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit("f"), "l_suppkey")).otherwise("")
    return l.select("l_orderkey", "l_linenumber", text.location(file, F.when(F.col("l_quantity") > 10, F.col("l_linenumber")), F.when(F.col("l_quantity") > 20, F.col("l_partkey"))).alias("place"))


@register("c39_component_names", """
SELECT DISTINCT tag, list_aggregate(list_transform(string_split(tag, '-'), lambda w: concat(upper(w[1]), substr(w, 2))), 'string_agg', '') AS name FROM (SELECT replace(lower(p_type), ' ', '-') AS tag FROM part UNION ALL SELECT replace(lower(p_brand), '#', '-') FROM part)
""")  # fmt: skip
def c39_component_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and brands of parts as tags, and the components that these name."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    tags = p.select(F.replace(F.lower("p_type"), F.lit(" "), F.lit("-")).alias("tag")).union(p.select(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))))
    return tags.distinct().select("tag", text.component_name(F.col("tag")).alias("name"))
