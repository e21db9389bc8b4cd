"""Registered queries of requests, routes and what reaches what over HTTP, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph
from weftgraph.operators import lookups, navigation, routes
from weftgraph.plans.fixtures import FX1_WITH, duck, fx1, spark_sql
from weftgraph.plans.registry import register
from weftgraph.sources import graphs

#: Requests, written in four ways, for parts and their brands.
ASKED = """
SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN concat('get /api/v', cast(p_size % 3 as string), path) WHEN 1 THEN concat('http:GET:/api', path)
  WHEN 2 THEN concat('api:POST:', path, '/') ELSE path END AS query
FROM (SELECT *, concat('/', lower(replace(p_brand, '#', '')), '//{id}/size', cast(p_size as string)) AS path FROM @part) AS t
"""
#: Endpoints of brands in route files of several names.
ENDS = """
SELECT DISTINCT concat('api:', CASE WHEN p_partkey % 3 = 0 THEN 'POST' ELSE 'GET' END, ':/', lower(replace(p_brand, '#', '')), '/{key}/size', cast(p_size as string)) AS id, 'api_endpoint' AS type,
  CASE p_size % 5 WHEN 0 THEN 'routes/api.v1.php' WHEN 1 THEN 'routes/api.php' WHEN 2 THEN 'routes/web.php' WHEN 3 THEN 'k6/api.v2.js' ELSE 'src/my_api_v2.ts' END AS file
FROM @part
"""
#: Requests of suppliers, the routes that endpoints resolve to, and their handlers.
HTTP = """
SELECT concat('js:supplier', cast(l_suppkey as string)) AS from_id, concat('http:GET:/api/v1/x', cast(l_partkey % 150 as string)) AS to_id, 'HTTP_REQUEST' AS type FROM @lineitem
UNION ALL SELECT concat('http:GET:/api/v1/x', cast(p_partkey % 150 as string)), concat('api:GET:/api/v', cast(p_size % 2 + 1 as string), '/x', cast(p_partkey % 150 as string)), 'RESOLVES_TO' FROM @part WHERE p_partkey % 150 < 120
UNION ALL SELECT concat('api:GET:/api/v', cast(p_size % 2 + 1 as string), '/x', cast(p_partkey % 150 as string)), concat('C', cast(p_partkey % 40 as string), '::act'), 'ROUTES_TO' FROM @part WHERE p_partkey % 150 < 100
UNION ALL SELECT concat('api:GET:/api/v', cast(p_size % 2 + 1 as string), '/x', cast(p_partkey % 150 as string)), concat('mw:', lower(p_brand)), 'USES_MIDDLEWARE' FROM @part
"""
HTTP_WITH = f"""WITH edges AS ({duck(HTTP)}), ends AS (SELECT from_id AS id FROM edges WHERE from_id LIKE 'http:%' OR from_id LIKE 'api:%' UNION SELECT to_id FROM edges WHERE to_id LIKE 'http:%' OR to_id LIKE 'api:%'),
alias AS (SELECT id AS endpoint, id AS alias FROM ends UNION SELECT from_id, to_id FROM edges WHERE type = 'RESOLVES_TO'),
h AS (SELECT DISTINCT endpoint, to_id AS handler FROM alias JOIN edges e ON e.from_id = alias.alias AND e.type = 'ROUTES_TO'),
c AS (SELECT DISTINCT alias AS endpoint, e.from_id AS client FROM alias JOIN edges e ON e.to_id = alias.endpoint AND e.type = 'HTTP_REQUEST')
"""


def http_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Clients, endpoints, routes and handlers."""
    e = spark_sql(spark, sf_dir, HTTP)
    ids = e.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    kind = F.when(F.col("id").startswith("http:"), "http_endpoint").when(F.col("id").startswith("api:"), "api_endpoint").when(F.col("id").startswith("mw:"), "middleware").otherwise("method")
    return CodeGraph.of(ids.select("id", kind.alias("type"), F.when(F.col("id").startswith("mw:"), F.substring("id", 4, 100)).alias("name")), e)


_REQUEST = f"""WITH q AS ({duck(ASKED)}), s AS (SELECT query,
  CASE WHEN query LIKE 'get %' THEN 'GET' WHEN query LIKE 'http:%' THEN 'GET' WHEN query LIKE 'api:%' THEN 'POST' END AS verb,
  regexp_replace(regexp_replace(query, '^(get |http:GET:|api:POST:)', ''), '\\{{[^}}]+\\}}', '{{param}}', 'g') AS p FROM q),
r AS (SELECT query, verb, regexp_replace(trim(regexp_replace(p, '/+', '/', 'g'), '/'), '^$', '/') AS requested FROM s),
a AS (SELECT query, verb, requested, regexp_replace(requested, '^api(/v[0-9]+)?/', '') AS framework FROM r)
"""


@register("c3_route_requests", _REQUEST + "SELECT * FROM a")
def c3_route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verb and paths of every request."""
    return spark_sql(spark, sf_dir, ASKED).select("query", routes.request(F.col("query")).alias("r")).select("query", "r.*")


@register("c8_route_plans", _REQUEST + """
SELECT query, CASE WHEN verb IS NULL THEN '' WHEN requested = framework THEN concat('api:', verb, ':', requested) ELSE concat('api:', verb, ':', requested, ' api:', verb, ':', framework) END AS ids,
  regexp_replace(framework, '/[{]param[}]', '') AS terms
FROM a
""")  # fmt: skip
def c8_route_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact ids and path terms that every request is looked up by."""
    asked = spark_sql(spark, sf_dir, ASKED).select("query", routes.request(F.col("query")).alias("r"))
    return asked.select("query", F.array_join(routes.endpoint_ids(F.col("r")), " ").alias("ids"), F.array_join(routes.path_terms(F.col("r.requested")), "/").alias("terms"))


@register("c9_follow_ups", _REQUEST + """
SELECT query, concat(framework, CASE WHEN verb IS NULL OR requested = framework THEN '' ELSE concat(' ', requested) END, ' ', replace(regexp_replace(framework, '/[{]param[}]', ''), '/', ' ')) AS next
FROM a
""")  # fmt: skip
def c9_follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to look for after every request."""
    asked = spark_sql(spark, sf_dir, ASKED).select("query", routes.request(F.col("query")).alias("r"))
    return asked.select("query", F.array_join(routes.follow_ups(F.col("r")), " ").alias("next"))


_CANDIDATES = f"""ends AS ({duck(ENDS)}),
e AS (SELECT id, file, split_part(id, ':', 2) AS verb, regexp_replace(trim(split_part(id, ':', 3), '/'), '[{{]key[}}]', '{{param}}') AS stored,
  CASE WHEN file = 'routes/api.v1.php' THEN 'api/v1' WHEN file = 'routes/api.php' THEN 'api' WHEN file LIKE '%v2%' THEN 'api/v2' END AS prefix FROM ends),
k AS (SELECT id, file, verb, stored AS path FROM e UNION ALL SELECT id, file, verb, concat(prefix, '/', stored) FROM e WHERE prefix IS NOT NULL)
"""


@register("c7_candidate_paths", f"WITH {_CANDIDATES} SELECT id, file, path, file LIKE 'k6/%' AS low, file LIKE 'routes/%' AS production FROM k")
def c7_candidate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that every endpoint may be asked for by, and what its file is."""
    own = spark_sql(spark, sf_dir, ENDS)
    return own.select("id", "file", F.explode(routes.candidate_paths(F.col("id"), F.col("file"))).alias("path"), routes.low_signal(F.col("file")).alias("low"), routes.production_routes(F.col("file")).alias("production"))


@register("c5_routes_for", _REQUEST + f""", {_CANDIDATES},
w AS (SELECT query, verb, requested AS path, true AS exact FROM a UNION SELECT query, verb, framework, framework = requested FROM a),
f AS (SELECT w.query, k.id, bool_or(exact) AS exact, bool_and(k.file LIKE 'k6/%') AS low FROM w JOIN k USING (path) WHERE w.verb IS NULL OR w.verb = k.verb GROUP BY 1, 2)
SELECT query, id, exact FROM f WHERE low = (SELECT min(low) FROM f AS o WHERE o.query = f.query)
""")  # fmt: skip
def c5_routes_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints that every request means."""
    ends = spark_sql(spark, sf_dir, ENDS)
    return routes.routes_for(CodeGraph.of(ends, spark_sql(spark, sf_dir, HTTP)), spark_sql(spark, sf_dir, ASKED))


@register("j5_http_upstream", HTTP_WITH + "SELECT handler, client, endpoint FROM c JOIN h USING (endpoint)")
def j5_http_upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every client of every handler, over HTTP."""
    return navigation.http_upstream(http_graph(spark, sf_dir))


@register("g24_http_clients", HTTP_WITH + "SELECT endpoint, client FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY client) AS n FROM c) WHERE n <= 20")
def g24_http_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first clients of every endpoint."""
    return navigation.http_clients(http_graph(spark, sf_dir))


@register("j4_http_downstream", HTTP_WITH + """
, v AS (SELECT e.from_id AS client, e.to_id AS endpoint, a.alias, r.to_id AS handler FROM (SELECT DISTINCT from_id, to_id FROM edges WHERE type = 'HTTP_REQUEST') e JOIN alias a ON a.endpoint = e.to_id LEFT JOIN (SELECT DISTINCT from_id, to_id FROM edges WHERE type = 'ROUTES_TO') r ON r.from_id = a.alias),
s AS (SELECT DISTINCT client, endpoint, handler, (CASE WHEN handler IS NULL THEN -200 ELSE 0 END + CASE WHEN alias LIKE '%/api/v1/%' THEN 100 ELSE 0 END)::INT AS score FROM v),
t AS (SELECT *, max(score) OVER (PARTITION BY client, endpoint) AS top FROM s)
SELECT client, endpoint, handler, score FROM t WHERE score = top
""")  # fmt: skip
def j4_http_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that every client's requests reach."""
    return navigation.http_downstream(http_graph(spark, sf_dir), None)


@register("g33_route_middleware", HTTP_WITH + "SELECT DISTINCT from_id AS endpoint, substr(to_id, 4) AS middleware FROM edges WHERE type = 'USES_MIDDLEWARE'")
def g33_route_middleware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middleware of every route."""
    return navigation.route_middleware(http_graph(spark, sf_dir), None)


#: Fields that orders read and assign, and flows of arguments.
FIELDS = """
SELECT concat('C', cast(o_custkey % 97 as string), '::m', cast(o_orderkey % 5 as string), CASE WHEN o_orderkey % 3 = 0 THEN '::inner' ELSE '' END) AS from_id, concat('request_field:f', cast(o_orderkey % 61 as string)) AS to_id, 'READS_FIELD' AS type, NULL AS via FROM @orders
UNION ALL SELECT concat('request_field:f', cast(o_orderkey % 61 as string)), concat('var', cast(o_custkey % 11 as string)), 'ASSIGNS', NULL FROM @orders WHERE o_orderkey % 61 < 20
UNION ALL SELECT concat('m', cast(l_suppkey as string)), concat('n', cast(l_partkey % 100 as string)), CASE WHEN l_linenumber = 1 THEN 'ARGUMENT_TO' ELSE 'FLOWS_TO' END, CASE WHEN l_quantity > 25 THEN cast(l_linenumber % 2 as string) END FROM @lineitem
"""
_FIELDS = f"WITH e AS ({duck(FIELDS)}) "


@register("f4_field_intake", _FIELDS + "SELECT type, to_id, count(*) AS n FROM e WHERE type = 'ASSIGNS' OR (type = 'READS_FIELD' AND to_id NOT IN (SELECT from_id FROM e WHERE type = 'ASSIGNS')) GROUP BY 1, 2")
def f4_field_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assignments, and reads that none continues."""
    return lookups.field_intake(spark_sql(spark, sf_dir, FIELDS)).groupBy("type", "to_id").agg(F.count("*").alias("n"))


@register("f5_field_flow", _FIELDS + "SELECT type, to_id, count(*) AS n FROM e WHERE type <> 'FLOWS_TO' OR (from_id, coalesce(via, '')) NOT IN (SELECT (from_id, coalesce(via, '')) FROM e WHERE type = 'ARGUMENT_TO') GROUP BY 1, 2")
def f5_field_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of arguments without those that a parameter ends."""
    return lookups.field_flow(spark_sql(spark, sf_dir, FIELDS)).groupBy("type", "to_id").agg(F.count("*").alias("n"))


@register("g31_reads_of", _FIELDS + "SELECT DISTINCT m AS method, to_id AS field FROM (SELECT unnest([from_id, regexp_replace(from_id, '::inner$', '')]) AS m, to_id FROM e WHERE type = 'READS_FIELD')")
def g31_reads_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request fields that every method or one of its members reads."""
    edges = spark_sql(spark, sf_dir, FIELDS)
    return navigation.reads_of(CodeGraph.of(edges.select(F.col("from_id").alias("id")).distinct(), edges))


@register("a12_confidence", """
WITH r AS (SELECT l_orderkey AS k, l_linenumber AS line, cast(l_quantity * 25 AS INT) AS score, l_linenumber % 2 = 0 AS ambiguous, l_suppkey % 3 AS handlers, l_partkey % 4 <> 0 AS defined, l_suppkey % 2 AS entries, l_partkey % 5 AS files, l_returnflag = 'R' AS drifted, l_partkey % 30 AS age, l_suppkey % 5 AS gaps FROM lineitem),
p AS (SELECT k, line, CASE WHEN score < 500 THEN 2 WHEN score < 900 THEN 1 ELSE 0 END + ambiguous::INT + (handlers > 1)::INT + (NOT defined)::INT + (entries = 0)::INT + 2 * (files = 0)::INT + drifted::INT + (age > 14)::INT + (gaps >= 3)::INT AS p FROM r)
SELECT CASE WHEN p = 0 THEN 'high' WHEN p <= 2 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM p GROUP BY 1
""")  # fmt: skip
def a12_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the answers that line items stand for are sure."""
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    rows = l.selectExpr("cast(l_quantity * 25 as int) AS score", "l_linenumber % 2 = 0 AS ambiguous", "l_suppkey % 3 AS handlers", "l_partkey % 4 <> 0 AS action_defined", "l_suppkey % 2 AS entries", "l_partkey % 5 AS files", "l_returnflag = 'R' AS drifted", "l_partkey % 30 AS age_days", "l_suppkey % 5 AS gaps")
    return navigation.confidence(rows).groupBy("level").agg(F.count("*").alias("n"))


@register("s7_merge_keeps_rows", FX1_WITH + "SELECT CASE WHEN type = 'method' AND name <> 'ship' THEN 'new' ELSE name END AS name, count(*) AS n FROM nodes GROUP BY 1")
def s7_merge_keeps_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of the graph merged with the whole one under other names: rows that are there stay, others are added."""
    g = fx1(spark, sf_dir)
    part = CodeGraph(g.nodes.where("type <> 'method' OR name = 'ship'"), g.edges.where("type = 'EXTENDS'"))
    return graphs.merge(part, CodeGraph(g.nodes.withColumn("name", F.lit("new")), g.edges)).nodes.groupBy("name").agg(F.count("*").alias("n"))


@register("g35_source_of_members", FX1_WITH + "SELECT id, CASE WHEN name IN ('ship', 'audit') THEN parent ELSE id END AS source FROM nodes")
def g35_source_of_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each node's source is, if suppliers' methods have no file of their own."""
    g = fx1(spark, sf_dir)
    return navigation.nearest_source(CodeGraph(g.nodes.withColumn("file", F.when(F.col("name").isin("ship", "audit") & (F.col("type") == "method"), F.lit(None)).otherwise(F.col("file"))), g.edges))
