"""Registered queries of the graph engine, each over a whole graph, with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import predicates, text
from weftgraph.model import CodeGraph
from weftgraph.operators import analyzers, inheritance, links, lookups, navigation, search, traversal
from weftgraph.plans.fixtures import FX1_WITH, FX2_WITH, FX3_CLIENT, FX3_LINKS, FX3_ROUTE, duck, fx1, fx2, spark_sql
from weftgraph.plans.registry import register
from weftgraph.sources import graphs

NORMAL = "rtrim(ltrim(regexp_replace(regexp_replace({p}, '\\{{[^}}]+\\}}', '{{param}}', 'g'), '/+', '/', 'g'), '/'), '/')"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _all(graph: CodeGraph, type_: str) -> DataFrame:
    return graph.nodes.where(F.col("type") == type_).select("id")


@register("a2_hotspots", FX1_WITH + """
, ends AS (SELECT to_id AS id, 1 AS i, CASE WHEN type = 'CALLS' THEN 0 ELSE 0 END AS o FROM edges WHERE (type = 'CALLS' AND call_type IS NULL) OR type IN ('ROUTES_TO', 'BLADE_USES_ACTION')
  UNION ALL SELECT from_id, 0, 1 FROM visible),
t AS (SELECT n.id, n.type, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing, sum(i + o)::BIGINT AS score FROM ends JOIN nodes n USING (id) GROUP BY 1, 2),
dep AS (SELECT n.id, sum(i)::BIGINT AS incoming, sum(o)::BIGINT AS outgoing, sum(i + o)::BIGINT AS score FROM (SELECT to_id AS id, 1 AS i, 0 AS o FROM edges WHERE type = 'DEPENDS_ON' UNION ALL SELECT from_id, 0, 1 FROM edges WHERE type = 'DEPENDS_ON') JOIN nodes n USING (id) WHERE n.type = 'class' GROUP BY 1)
SELECT * FROM (SELECT 'method' AS list, id, incoming, outgoing, score FROM t WHERE type = 'method' AND score > 0 ORDER BY score DESC, id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'class' AS list, id, incoming, outgoing, score FROM t WHERE type = 'class' AND score > 0 ORDER BY score DESC, id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'dependency' AS list, id, incoming, outgoing, score FROM dep ORDER BY score DESC, id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'fan_out' AS list, id, incoming, outgoing, score FROM t WHERE outgoing > 0 ORDER BY outgoing DESC, id LIMIT 10)
""")  # fmt: skip
def a2_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four lists of the ten busiest nodes."""
    return analyzers.hotspots(fx1(spark, sf_dir), 10)


_IMPACT = """
, kind AS (SELECT from_id, to_id, type FROM edges WHERE (type = 'CALLS' AND call_type IS NULL) OR type IN ('EXTENDS', 'IMPLEMENTS', 'ROUTES_TO', 'BLADE_USES_ACTION')),
e AS (SELECT k.* FROM kind k SEMI JOIN nodes a ON k.from_id = a.id SEMI JOIN nodes b ON k.to_id = b.id),
w AS (SELECT * FROM (VALUES ('CALLS', 5, 2), ('EXTENDS', 3, 3), ('IMPLEMENTS', 2, 2), ('ROUTES_TO', 5, 0), ('BLADE_USES_ACTION', 4, 0)) AS v(type, w_in, w_out)),
targets AS (SELECT id FROM nodes WHERE {targets}),
l1 AS (SELECT DISTINCT t.id AS batch, e.from_id AS node FROM targets t JOIN e ON e.to_id = t.id WHERE e.from_id <> t.id),
up AS (SELECT t.id AS batch, e.from_id AS id, w_in * 1.0::DECIMAL(18, 6) AS s, 1 AS d FROM targets t JOIN e ON e.to_id = t.id JOIN w USING (type) WHERE e.from_id <> t.id
  UNION ALL SELECT l.batch, e.from_id, w_in * 0.6::DECIMAL(18, 6), 2 FROM l1 l JOIN e ON e.to_id = l.node JOIN w USING (type) WHERE e.from_id <> l.batch),
impact AS (SELECT batch AS target, id, 'caller' AS direction, sum(s)::DOUBLE AS score, min(d)::INT AS distance FROM up GROUP BY 1, 2
  UNION ALL SELECT t.id, e.to_id, 'callee', sum(w_out)::DOUBLE, 1 FROM targets t JOIN e ON e.from_id = t.id JOIN w USING (type) GROUP BY 1, 2)
"""
_PARTS = "type = 'method' AND name = 'reserve'"


@register("a1_change_impact", FX1_WITH + _IMPACT.format(targets=_PARTS) + "SELECT * FROM impact")
def a1_change_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is affected by a change of each part's method, two levels up and one down."""
    g = fx1(spark, sf_dir)
    return analyzers.change_impact(g, g.nodes.where(_PARTS).select("id"), 2)


_RISK = "CASE WHEN {s} >= 40 THEN 'CRITICAL' WHEN {s} >= 20 THEN 'HIGH' WHEN {s} >= 8 THEN 'MEDIUM' ELSE 'LOW' END"


@register("a1_impact_summary", FX1_WITH + _IMPACT.format(targets=_PARTS) + f"""
SELECT target, sum(score::DECIMAL(28, 6))::DOUBLE AS score, count(*) FILTER (direction = 'caller' AND distance = 1) AS direct_callers,
  count(*) FILTER (direction = 'caller' AND distance > 1) AS indirect_callers, count(*) FILTER (direction = 'callee') AS callees, {_RISK.format(s='sum(score)')} AS risk
FROM impact GROUP BY 1
""")  # fmt: skip
def a1_impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact score and tier of each part's method."""
    g = fx1(spark, sf_dir)
    return analyzers.impact_summary(analyzers.change_impact(g, g.nodes.where(_PARTS).select("id"), 2))


@register("a7_risk", FX1_WITH + """
, ends AS (SELECT to_id AS id, 1 AS i, 0 AS o FROM edges WHERE (type = 'CALLS' AND call_type IS NULL) OR type IN ('ROUTES_TO', 'BLADE_USES_ACTION') UNION ALL SELECT from_id, 0, 1 FROM visible),
t AS (SELECT n.id, n.type, sum(o) AS outgoing, sum(i + o)::BIGINT AS score FROM ends JOIN nodes n USING (id) GROUP BY 1, 2),
pool AS (SELECT id, max(score) AS hotspot_score FROM (
  (SELECT id, score FROM t WHERE type = 'method' ORDER BY score DESC, id LIMIT 100) UNION ALL (SELECT id, score FROM t WHERE type = 'class' ORDER BY score DESC, id LIMIT 100)
  UNION ALL (SELECT id, score FROM t WHERE outgoing > 0 ORDER BY outgoing DESC, id LIMIT 100)) GROUP BY 1)
""" + _IMPACT.format(targets="id IN (SELECT id FROM pool)") + f"""
, i AS (SELECT target AS id, sum(score::DECIMAL(28, 6))::DOUBLE AS impact_score FROM impact GROUP BY 1),
b AS (SELECT id, hotspot_score, coalesce(impact_score, 0) AS impact_score FROM pool LEFT JOIN i USING (id)),
c AS (SELECT *, impact_score * 3 + hotspot_score AS combined, {_RISK.format(s='impact_score')} AS risk FROM b)
SELECT *, row_number() OVER (ORDER BY CASE risk WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END, combined DESC, hotspot_score DESC, id)::INT AS rank FROM c
""")  # fmt: skip
def a7_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest nodes ranked by impact and traffic."""
    return analyzers.risk_ranking(fx1(spark, sf_dir), 100)


_STEPS = "\n".join(f", p{n} AS (SELECT start, b AS last, list_append(path, b) AS path FROM p{n - 1} JOIN adj ON a = last WHERE b > start AND NOT list_contains(path, b))" for n in range(3, 6))


@register("a3_cycles", FX2_WITH + f"""
, adj AS (SELECT DISTINCT from_id AS a, to_id AS b FROM edges WHERE from_id <> to_id), p2 AS (SELECT a AS start, b AS last, [a, b] AS path FROM adj WHERE b > a){_STEPS}
, c AS ({' UNION ALL '.join(f'SELECT path, {n} AS length FROM p{n} JOIN adj ON a = last AND b = start' for n in range(2, 6))})
SELECT array_to_string(path, ' -> ') AS path, length::INT AS length FROM c
""")  # fmt: skip
def a3_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every simple cycle of event types."""
    return traversal.cycles(fx2(spark, sf_dir)).select(F.array_join("path", " -> ").alias("path"), "length")


def _layer_sql(id_: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(split_part({id_}, '::', 1), '(^|\\\\){s}(\\\\|$)') THEN '{k}'" for s, k, _, _ in predicates.LAYERS) + " END"


def _rank_sql(layer: str) -> str:
    return f"CASE {layer} " + " ".join(f"WHEN '{k}' THEN {r}" for _, k, r, _ in predicates.LAYERS) + " END"


_ARCH = FX1_WITH + f"""
, e AS (SELECT from_id, to_id, type, {_layer_sql('from_id')} AS from_layer, {_layer_sql('to_id')} AS to_layer FROM edges WHERE (type = 'CALLS' AND call_type IS NULL) OR type = 'DEPENDS_ON'),
v AS (SELECT *, CASE WHEN type = 'DEPENDS_ON' THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  concat(from_layer, ' code should not ', CASE WHEN type = 'DEPENDS_ON' THEN 'depend on' ELSE 'call' END, ' ', to_layer, ' code.') AS reason, concat(from_layer, ' → ', to_layer) AS detected
  FROM e WHERE {_rank_sql('from_layer')} > {_rank_sql('to_layer')})
"""


@register("a4_architecture", _ARCH + "SELECT from_id, to_id, type, from_layer, to_layer, severity, reason, detected FROM v")
def a4_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge from an inner to an outer layer."""
    return analyzers.architecture(fx1(spark, sf_dir))


@register("a4_layer_counts", _ARCH + "SELECT from_layer, to_layer, severity, count(*) AS n FROM v GROUP BY 1, 2, 3")
def a4_layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by layers."""
    return analyzers.layer_counts(analyzers.architecture(fx1(spark, sf_dir)))


@register("a5_dead_code", FX1_WITH + """
, c AS (SELECT to_id AS id, count(*) AS incoming, count(*) + count(*) FILTER (type = 'CALLS' AND call_type IS NOT NULL) AS effective FROM edges WHERE type IN ('CALLS', 'ROUTES_TO') GROUP BY 1)
SELECT id, NULL::VARCHAR AS skipped, coalesce(incoming, 0) AS incoming, coalesce(effective, 0) AS effective, coalesce(effective, 0) = 0 AS dead
FROM nodes LEFT JOIN c USING (id) WHERE type = 'method' AND visibility = 'public'
""")  # fmt: skip
def a5_dead_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every public method, judged."""
    return analyzers.dead_code(fx1(spark, sf_dir))


@register("g3_incoming_calls", FX1_WITH + """
SELECT to_id AS id, from_id, file, call_type, NULL::VARCHAR AS via, edge_id FROM (SELECT e.to_id, e.from_id, n.file, e.call_type, e.id AS edge_id, row_number() OVER (PARTITION BY to_id ORDER BY from_id, e.id) AS r
FROM visible e JOIN nodes n ON n.id = e.from_id SEMI JOIN (SELECT id FROM nodes WHERE type = 'method') m ON m.id = e.to_id) WHERE r <= 20
""")  # fmt: skip
def g3_incoming_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty callers of every method."""
    g = fx1(spark, sf_dir)
    return lookups.incoming_calls(g, _all(g, "method"))


@register("g4_outgoing_calls", FX1_WITH + """
SELECT from_id AS id, to_id, file, call_type, NULL::VARCHAR AS via, edge_id FROM (SELECT e.to_id, e.from_id, n.file, e.call_type, e.id AS edge_id, row_number() OVER (PARTITION BY from_id ORDER BY to_id, e.id) AS r
FROM visible e JOIN nodes n ON n.id = e.to_id SEMI JOIN (SELECT id FROM nodes WHERE type = 'method') m ON m.id = e.from_id) WHERE r <= 20
""")  # fmt: skip
def g4_outgoing_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty callees of every method."""
    g = fx1(spark, sf_dir)
    return lookups.outgoing_calls(g, _all(g, "method"))


@register("g5_depends_on", FX1_WITH + """
, d AS (SELECT from_id AS id, 'outgoing' AS direction, to_id AS other FROM edges WHERE type = 'DEPENDS_ON' UNION ALL SELECT to_id, 'incoming', from_id FROM edges WHERE type = 'DEPENDS_ON'),
r AS (SELECT d.id, d.direction, d.other, n.type, n.file, row_number() OVER (PARTITION BY d.id, direction ORDER BY other) AS k FROM d LEFT JOIN nodes n ON n.id = d.other SEMI JOIN (SELECT id FROM nodes WHERE type = 'class') c ON c.id = d.id)
SELECT id, direction, other, type, file FROM r WHERE k <= 20
""")  # fmt: skip
def g5_depends_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of every class, either way."""
    g = fx1(spark, sf_dir)
    return lookups.depends_on(g, _all(g, "class"))


@register("g6_methods_by_parent", FX1_WITH + "SELECT parent, id, name, visibility FROM nodes WHERE type = 'method' AND parent IN (SELECT id FROM nodes WHERE type = 'class')")
def g6_methods_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of every class."""
    g = fx1(spark, sf_dir)
    return lookups.methods_by_parent(g, _all(g, "class"))


@register("g7_inheritance_chain", FX1_WITH + """
, up AS (SELECT from_id AS id, to_id AS ancestor, 1 AS dist FROM edges WHERE type = 'EXTENDS' UNION ALL SELECT up.id, e.to_id, dist + 1 FROM up JOIN edges e ON e.from_id = up.ancestor AND e.type = 'EXTENDS')
SELECT id, ancestor, dist FROM up
""")  # fmt: skip
def g7_inheritance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ancestors of every class."""
    return inheritance.inheritance_chain(fx1(spark, sf_dir))


@register("g8_resolve_method", FX1_WITH + """
, up AS (SELECT id, id AS owner, 0 AS dist FROM nodes WHERE type = 'class' UNION ALL SELECT up.id, e.to_id, dist + 1 FROM up JOIN edges e ON e.from_id = up.owner AND e.type = 'EXTENDS'),
f AS (SELECT up.id AS class, m.name AS method, m.id AS target, dist, row_number() OVER (PARTITION BY up.id, m.name ORDER BY dist, up.owner) AS r FROM up JOIN nodes m ON m.parent = up.owner AND m.type = 'method' WHERE m.name = 'ship')
SELECT class, method, target, dist FROM f WHERE r = 1
""")  # fmt: skip
def g8_resolve_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each class finds the method `ship`."""
    g = fx1(spark, sf_dir)
    return inheritance.resolve_through_inheritance(g, _all(g, "class").select(F.col("id").alias("class"), F.lit("ship").alias("method")))


@register("g10_call_chain", FX1_WITH + """
, calls AS (SELECT from_id, to_id FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS r FROM (SELECT DISTINCT from_id, to_id FROM visible SEMI JOIN nodes n ON n.id = visible.to_id)) WHERE r <= 20),
s AS (SELECT id AS start FROM nodes WHERE type = 'method' AND name = 'place'),
w AS (SELECT *, CASE WHEN regexp_matches(split_part(to_id, '::', 1), '(?i)Service|UseCase|Action|Handler|Interactor|Manager') THEN 80 ELSE 20 END AS weight FROM calls),
d1 AS (SELECT * FROM (SELECT start, to_id AS id, start AS parent, row_number() OVER (PARTITION BY start ORDER BY weight DESC, to_id) AS r FROM s JOIN w ON from_id = start) WHERE r <= 18),
u AS (SELECT start, count(*) AS used FROM d1 GROUP BY 1),
n2 AS (SELECT d1.start, to_id, any_value(weight) AS weight, min(d1.id) AS parent FROM d1 JOIN w ON from_id = d1.id WHERE to_id <> d1.start AND NOT EXISTS (SELECT 1 FROM d1 x WHERE x.start = d1.start AND x.id = to_id) GROUP BY 1, 2),
d2 AS (SELECT * FROM (SELECT start, to_id AS id, parent, used, row_number() OVER (PARTITION BY start ORDER BY weight DESC, to_id) AS r FROM n2 JOIN u USING (start)) WHERE r <= 20 - used)
SELECT start, id, 1 AS depth, parent FROM d1 UNION ALL SELECT start, id, 2, parent FROM d2
""")  # fmt: skip
def g10_call_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call chain of every customer's method, two levels and twenty callees."""
    g = fx1(spark, sf_dir)
    return traversal.call_chain(g, g.nodes.where("type = 'method' AND name = 'place'").select("id"), 2, 20)


@register("g15_implementations", FX1_WITH + """
SELECT i.to_id AS interface, m.name AS method, min(m.id) AS target, count(DISTINCT m.id) AS candidates FROM (SELECT DISTINCT from_id, to_id FROM edges WHERE type IN ('IMPLEMENTS', 'EXTENDS')) i JOIN nodes m ON m.parent = i.from_id AND m.type = 'method' GROUP BY 1, 2
""")  # fmt: skip
def g15_implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods by which classes implement those above them."""
    return lookups.implementations(fx1(spark, sf_dir))


@register("g16_abstract_targets", FX1_WITH + "SELECT id FROM nodes WHERE type = 'interface' UNION SELECT to_id FROM edges WHERE type = 'IMPLEMENTS'")
def g16_abstract_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interfaces and other abstract targets."""
    return lookups.abstract_targets(fx1(spark, sf_dir))


@register("g21_incoming_entries", FX1_WITH + """
SELECT id, kind::INT AS kind, from_id FROM (SELECT to_id AS id, CASE WHEN type = 'CALLS' THEN 0 WHEN type = 'ROUTES_TO' THEN 1 ELSE 2 END AS kind, from_id,
  row_number() OVER (PARTITION BY to_id ORDER BY CASE WHEN type = 'CALLS' THEN 0 WHEN type = 'ROUTES_TO' THEN 1 ELSE 2 END, from_id, id) AS r
  FROM edges e SEMI JOIN nodes n ON n.id = e.from_id SEMI JOIN (SELECT id FROM nodes WHERE type = 'method') m ON m.id = e.to_id WHERE (type = 'CALLS' AND call_type IS NULL) OR type IN ('ROUTES_TO', 'BLADE_USES_ACTION')) WHERE r <= 20
""")  # fmt: skip
def g21_incoming_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and entry points into every method."""
    g = fx1(spark, sf_dir)
    return lookups.incoming_entries(g, _all(g, "method"))


@register("g23_route_action_defined", FX1_WITH + """
, a AS (SELECT concat(id, '::ship') AS id, id AS class FROM nodes WHERE type = 'class'),
up AS (SELECT id, id AS owner FROM nodes WHERE type = 'class' UNION SELECT up.id, e.to_id FROM up JOIN edges e ON e.from_id = up.owner AND e.type IN ('EXTENDS', 'USES_TRAIT'))
SELECT a.id, bool_or(n.id IS NOT NULL) AS defined FROM a JOIN up ON up.id = a.class LEFT JOIN nodes n ON n.id = concat(up.owner, '::ship') GROUP BY 1
""")  # fmt: skip
def g23_route_action_defined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether `ship` is defined for every class."""
    g = fx1(spark, sf_dir)
    return inheritance.route_action_defined(g, _all(g, "class").select(F.concat("id", F.lit("::ship")).alias("id")))


@register("g28_scoped_edges", FX1_WITH + "SELECT id, from_id, to_id, type FROM edges WHERE type IN ('DEPENDS_ON', 'EXTENDS') AND (from_id IN (SELECT id FROM nodes WHERE type = 'class') OR to_id IN (SELECT id FROM nodes WHERE type = 'class'))")
def g28_scoped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies and parents that touch any class or its members."""
    g = fx1(spark, sf_dir)
    return lookups.scoped_edges(g, _all(g, "class"), ["DEPENDS_ON", "EXTENDS"])


@register("g39_descendants", FX1_WITH + """
, down AS (SELECT to_id AS id, from_id AS descendant, 1 AS dist FROM edges WHERE type = 'EXTENDS' UNION ALL SELECT down.id, e.from_id, dist + 1 FROM down JOIN edges e ON e.to_id = down.descendant AND e.type = 'EXTENDS')
SELECT id, count(*) AS descendants, max(dist)::INT AS depth FROM down GROUP BY 1
""")  # fmt: skip
def g39_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many classes descend from each, and how deep."""
    g = fx1(spark, sf_dir)
    down = inheritance.descendants(g, g.edges.where("type = 'EXTENDS'").select(F.col("to_id").alias("id")).distinct())
    return down.groupBy("id").agg(F.count("*").alias("descendants"), F.max("dist").alias("depth"))


@register("bfs_levels", FX1_WITH + """
, e AS (SELECT DISTINCT from_id, to_id FROM edges WHERE type IN ('DEPENDS_ON', 'IMPLEMENTS')), l0 AS (SELECT id AS batch, id AS node FROM nodes WHERE type = 'interface'),
l1 AS (SELECT DISTINCT batch, e.from_id AS node FROM l0 JOIN e ON e.to_id = node), l2 AS (SELECT DISTINCT batch, e.from_id AS node FROM l1 JOIN e ON e.to_id = node)
SELECT batch, node, min(lvl)::INT AS lvl FROM (SELECT *, 0 AS lvl FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2) GROUP BY 1, 2
""")  # fmt: skip
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What depends on each interface within two levels."""
    g = fx1(spark, sf_dir)
    e = g.edges.where("type IN ('DEPENDS_ON', 'IMPLEMENTS')").select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    return traversal.bfs_levels(e, _all(g, "interface").select(F.col("id").alias("batch"), F.col("id").alias("node")), 2)


@register("c17_class_parts", FX1_WITH + "SELECT id, split_part(id, '::', 1) AS class, string_split(id, chr(92))[-1] AS label FROM nodes")
def c17_class_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and short label of every node."""
    return fx1(spark, sf_dir).nodes.select("id", predicates.class_of(F.col("id")).alias("class"), text.short_label(F.col("id")).alias("label"))


@register("f18_layers", FX1_WITH + f"SELECT id, {_layer_sql('id')} AS layer, CASE WHEN regexp_matches(split_part(id, '::', 1), '(?i)Service|UseCase|Action|Handler|Interactor|Manager') THEN 80 ELSE 20 END AS weight FROM nodes")
def f18_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer and weight of every node."""
    return fx1(spark, sf_dir).nodes.select("id", predicates.layer_strict(F.col("id")).alias("layer"), predicates.layer_priority(F.col("id")).alias("weight"))


_DOCFILE = "concat(CASE source WHEN 'src1' THEN 'app/Tests/' WHEN 'src2' THEN 'db/migrations/' WHEN 'src3' THEN 'Fixtures/' WHEN 'src4' THEN 'app/Services/' WHEN 'src5' THEN 'routes/' ELSE 'src/' END, lang, '/doc', cast(doc_id as string), CASE WHEN lang = 'de' THEN 'Test.php' WHEN lang = 'fr' THEN '.spec.ts' WHEN source = 'src6' THEN 'Controller.php' ELSE '.php' END)"
_FILES = f"SELECT {_DOCFILE} AS file FROM @documents"
_ROLE = "CASE WHEN regexp_matches(lower(file), '(^|/)tests/') OR regexp_matches(file, '(Test\\.php|[.]spec[.]ts)$') THEN 'test' WHEN file LIKE '%/migrations/%' THEN 'migration' WHEN file LIKE 'Fixtures/%' THEN 'fixture' ELSE 'source' END"


@register("f10_file_roles", f"SELECT file, {_ROLE} AS role, CASE {_ROLE} WHEN 'test' THEN 900 WHEN 'fixture' THEN 700 WHEN 'migration' THEN 450 ELSE 0 END AS penalty FROM ({duck(_FILES)})")
def f10_file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role and penalty of each document as a file."""
    return spark_sql(spark, sf_dir, _FILES).select("file", predicates.file_role(F.col("file")).alias("role"), predicates.file_role_penalty(F.col("file")).alias("penalty"))


@register("f9_test_files", f"SELECT file, coalesce({' OR '.join(f'file ILIKE {chr(39)}{p}{chr(39)}' for p in predicates.TEST_PATTERNS)}, false) AS test FROM ({duck(_FILES)})")
def f9_test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document as a file looks like a test."""
    return spark_sql(spark, sf_dir, _FILES).select("file", predicates.test_file(F.col("file")).alias("test"))


@register("c27_feature_roles", f"""
SELECT file, CASE WHEN regexp_matches(lower(file), '(^|/)(test|tests|__tests__)/|[.](spec|test|stories)[.][^.]+$') THEN 'test' WHEN regexp_matches(lower(file), '(^|/)routes?/') THEN 'route'
  WHEN lower(file) LIKE '%controller%' THEN 'controller' WHEN lower(file) LIKE '%service%' THEN 'service' ELSE 'other' END AS role FROM ({duck(_FILES)})
""")  # fmt: skip
def c27_feature_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role in a feature of each document as a file."""
    return spark_sql(spark, sf_dir, _FILES).select("file", predicates.feature_file_role(F.col("file"), F.array(F.lit("class"))).alias("role"))


_SCOPES = [("app", "back", "php"), ("app/Services", "services", "php"), ("db/migrations", "back", "sql"), ("src/en", "web", "node")]


@register("f14_code_location", f"""
WITH s AS (SELECT * FROM (VALUES {', '.join(map(str, _SCOPES))}) AS v(directory, workspace, runtime)), f AS (SELECT DISTINCT file FROM ({duck(_FILES)})),
m AS (SELECT f.file, s.*, row_number() OVER (PARTITION BY f.file ORDER BY length(s.directory) DESC) AS r FROM f LEFT JOIN s ON starts_with(f.file, concat(s.directory, '/')))
SELECT file, directory, workspace, runtime FROM m WHERE r = 1
""")  # fmt: skip
def f14_code_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project scope of each document as a file."""
    return lookups.code_location(spark_sql(spark, sf_dir, _FILES), spark.createDataFrame(_SCOPES, "directory string, workspace string, runtime string"))


@register("c1_route_paths", f"SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, {NORMAL.format(p=chr(39).join(['regexp_extract(url, ', '^[a-z]+://[^/?#]*(.*)$', ', 1)']))} AS p FROM pages)")
def c1_route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised path of every page."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1)
    return _read(spark, sf_dir, "pages").select("page_id", text.normalize_route_path(path).alias("path"))


@register("c21_comparable_paths", "SELECT page_id, CASE WHEN p LIKE '/%' THEN p ELSE concat('/', p) END AS path FROM (SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1), '[?#].*$', ''), '/+', '/', 'g'), '(.)/$', '\\1')) AS p FROM pages)")
def c21_comparable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable path of every page."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*(.*)$", 1)
    return _read(spark, sf_dir, "pages").select("page_id", text.comparable_path(path).alias("path"))


@register("c24_terms", "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), '\\s+'), lambda w: len(w) > 1 AND NOT list_contains([" + ", ".join(f"'{t}'" for t in text.GENERIC_TERMS) + "], w)))), ' ') AS terms FROM part")
def c24_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every part's name."""
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(text.split_terms(F.col("p_name"))), " ").alias("terms"))


@register("c32_token_estimates", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS four, ceil(length(text) / 3.5)::BIGINT AS less FROM documents")
def c32_token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimates of every document."""
    return _read(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("four"), text.estimate_tokens(F.col("text"), 3.5).alias("less"))


_COMPARABLE = "lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(id, '^(?:api|http):[^:]+:(.*)$', 1), '[?#].*$', ''), '/+', '/', 'g'), '(.)/$', '\\1'))"


@register("l2_link_endpoints", f"""
WITH c AS (SELECT id AS from_id, {_COMPARABLE} AS p FROM ({duck(FX3_CLIENT)})), r AS (SELECT id AS to_id, mount, {_COMPARABLE} AS p FROM ({duck(FX3_ROUTE)})),
ways AS (SELECT from_id, to_id, 1.0 AS confidence FROM c JOIN r USING (p)
  UNION ALL SELECT from_id, to_id, 0.8 FROM c JOIN r ON concat('/api', c.p) = r.p WHERE mount IS NOT NULL AND NOT regexp_matches(c.p, '^/api(/|$)')
  UNION ALL SELECT from_id, to_id, 0.7 FROM c JOIN r ON r.p = CASE WHEN regexp_replace(c.p, '^/api(/v[0-9]+)?', '') = '' THEN '/' ELSE regexp_replace(c.p, '^/api(/v[0-9]+)?', '') END WHERE mount IS NULL AND regexp_matches(c.p, '^/api(/|$)')),
e AS (SELECT from_id, to_id, max(confidence) AS confidence FROM ways GROUP BY 1, 2),
b AS (SELECT *, max(confidence) OVER (PARTITION BY from_id) AS top FROM e)
SELECT from_id, to_id, CASE WHEN count(*) OVER (PARTITION BY from_id) > 1 THEN least(confidence, 0.5) ELSE confidence END::DOUBLE AS confidence FROM b WHERE confidence = top
""")  # fmt: skip
def l2_link_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests linked with the routes that serve them."""
    return links.link_endpoints(spark_sql(spark, sf_dir, FX3_CLIENT), spark_sql(spark, sf_dir, FX3_ROUTE))


@register("page_links", f"SELECT href, count(*) AS n FROM ({duck(FX3_LINKS)}) GROUP BY 1")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often pages link to each target."""
    return spark_sql(spark, sf_dir, FX3_LINKS).groupBy("href").agg(F.count("*").alias("n"))


@register("l4_prune_dangling", FX1_WITH + "SELECT type, count(*) AS n FROM edges e WHERE type <> 'CALLS' OR to_id IN (SELECT id FROM nodes) GROUP BY 1")
def l4_prune_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by type once calls of missing nodes are gone."""
    return links.prune_dangling(fx1(spark, sf_dir), "CALLS").edges.groupBy("type").agg(F.count("*").alias("n"))


@register("l9_override_calls", FX1_WITH + """
, down AS (SELECT to_id AS class, from_id AS owner FROM edges WHERE type = 'EXTENDS' UNION SELECT down.class, e.from_id FROM down JOIN edges e ON e.to_id = down.owner AND e.type = 'EXTENDS'),
c AS (SELECT DISTINCT from_id, split_part(to_id, '::', 1) AS class, split_part(to_id, '::', 2) AS method FROM visible)
SELECT to_id, count(*) AS n FROM (SELECT DISTINCT c.from_id, m.id AS to_id FROM c JOIN down USING (class) JOIN nodes m ON m.parent = down.owner AND m.name = c.method AND m.type = 'method') GROUP BY 1
""")  # fmt: skip
def l9_override_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls each overriding method gets from calls of its ancestors'."""
    return links.override_counts(fx1(spark, sf_dir))


@register("s7_merge", FX1_WITH + "SELECT type, count(*) AS n FROM nodes GROUP BY 1")
def s7_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph merged with itself has each node once."""
    g = fx1(spark, sf_dir)
    return graphs.merge(g, g).nodes.groupBy("type").agg(F.count("*").alias("n"))


@register("keep_last", "SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS ord FROM events GROUP BY 1")
def keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user, as an upsert would leave it."""
    return graphs.keep_last(_read(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("ord")), ["user_id"])


_FIND = "CASE WHEN id = '{q}' THEN 1530 WHEN lower(id) = '{q}' OR suffix(lower(id), concat(chr(92), '{q}')) THEN 1480 WHEN suffix(lower(id), '::{q}') THEN 1455 WHEN lower(name) = '{q}' THEN 1430 WHEN contains(lower(id), '{q}') THEN 930 WHEN contains(lower(name), '{q}') THEN 880 WHEN contains(lower(file), '{q}') THEN 830 END"


@register("a9_find", FX1_WITH + f"""
, s AS (SELECT id, type, file, {_FIND.format(q='part')} AS score FROM nodes)
SELECT id, type, file, score::INT AS score, CASE score WHEN 1430 THEN 'exact name' WHEN 930 THEN 'id contains query' WHEN 880 THEN 'name contains query' ELSE 'file path contains query' END || ' via raw:part' AS reason
FROM s WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 20
""")  # fmt: skip
def a9_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best matches for `part`."""
    return search.find(fx1(spark, sf_dir), "part", 20)


@register("a8_similar")
def a8_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the whole graph that resemble the file of each nation and region: those files are what is asked for."""
    g = fx1(spark, sf_dir)
    return analyzers.similar_files(g, g.nodes.where("type IN ('class', 'interface') AND (file LIKE 'app/domain/nation%' OR file LIKE 'app/contracts/%')").select("file").distinct())


@register("g22_route_handlers", FX1_WITH + "SELECT from_id AS endpoint, to_id AS handler FROM (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY to_id) AS r FROM (SELECT DISTINCT from_id, to_id FROM edges WHERE type = 'ROUTES_TO' AND from_id IN (SELECT id FROM nodes WHERE type = 'api_endpoint'))) WHERE r <= 6")
def g22_route_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers of every route."""
    return navigation.route_handlers(fx1(spark, sf_dir))


@register("g35_nearest_source", FX1_WITH + "SELECT id, id AS source FROM nodes WHERE file IS NOT NULL")
def g35_nearest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each node's source is."""
    return navigation.nearest_source(fx1(spark, sf_dir))


@register("a6_feature", FX1_WITH + f"""
, s AS (SELECT file, {_FIND.format(q='nation')} AS score, id FROM nodes),
top AS (SELECT * FROM s WHERE score IS NOT NULL ORDER BY score DESC, id LIMIT 60), hits AS (SELECT file, max(score) AS score FROM top WHERE file IS NOT NULL GROUP BY 1),
seeds AS (SELECT file FROM hits ORDER BY score DESC, file LIMIT 8),
b AS (SELECT from_id AS id, to_id AS other, type FROM edges UNION ALL SELECT to_id, from_id, type FROM edges),
near AS (SELECT o.file, max(450 + CASE WHEN b.type IN ('ROUTES_TO') THEN 280 WHEN b.type IN ('CALLS', 'DEPENDS_ON') THEN 210 ELSE 80 END) AS score FROM b JOIN nodes n ON n.id = b.id JOIN nodes o ON o.id = b.other WHERE n.file IN (SELECT file FROM seeds) AND o.file NOT IN (SELECT file FROM seeds) GROUP BY 1),
u AS (SELECT file, max(score)::INT AS score FROM (SELECT * FROM hits UNION ALL SELECT * FROM near) GROUP BY 1)
SELECT file, CASE WHEN regexp_matches(file, '(^|/)routes?/') THEN 'route' WHEN file LIKE '%controller%' THEN 'controller' WHEN file LIKE '%service%' THEN 'service' WHEN file LIKE '%model%' THEN 'model' ELSE 'other' END AS role, score FROM u ORDER BY score DESC, file LIMIT 20
""")  # fmt: skip
def a6_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the feature `nation`."""
    return navigation.feature(fx1(spark, sf_dir), "nation")


@register("a10_locate")
def a10_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where work on `customer` begins."""
    return navigation.locate(fx1(spark, sf_dir), "customer")


@register("a17_data_layer_reach", FX1_WITH + "SELECT count(*) AS starts, 0::BIGINT AS reached FROM nodes WHERE type = 'api_endpoint'")
def a17_data_layer_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many routes reach a class of the data layer (the commerce graph has none)."""
    g = fx1(spark, sf_dir)
    starts = navigation.route_handlers(g, None).select("endpoint", F.col("handler").alias("start"))
    reach = navigation.data_layer_reach(g, starts.select(F.col("start").alias("id")), 3).select("start", F.lit(1).alias("hit"))
    by_route = _all(g, "api_endpoint").join(starts.join(reach, "start", "left"), F.col("endpoint") == F.col("id"), "left").groupBy("id").agg(F.max("hit").alias("hit"))
    return by_route.agg(F.count("*").alias("starts"), F.count("hit").alias("reached"))


@register("p32_expand_resources", """
WITH r AS (SELECT * FROM (VALUES ('GET', '', 'index'), ('GET', '/create', 'create'), ('POST', '', 'store'), ('GET', '/{param}', 'show'), ('GET', '/{param}/edit', 'edit'), ('PUT', '/{param}', 'update'), ('PATCH', '/{param}', 'update'), ('DELETE', '/{param}', 'destroy')) AS v(verb, suffix, action)),
b AS (SELECT DISTINCT lower(replace(p_brand, '#', '.')) AS base, CASE WHEN p_size > 25 THEN 'resource' ELSE 'apiResource' END AS kind FROM part)
SELECT base, kind, verb, concat('/', replace(base, '.', '/{param}/'), suffix) AS path, action FROM b, r WHERE kind = 'resource' OR action NOT IN ('create', 'edit')
""")  # fmt: skip
def p32_expand_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REST routes of a resource for each brand."""
    base = _read(spark, sf_dir, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("."))).alias("base"), F.when(F.col("p_size") > 25, "resource").otherwise("apiResource").alias("kind")).distinct()
    return links.expand_resources(base)


_ENDPOINT = "concat('http:', CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END, ':', regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1))"


@register("c15_endpoint_parts", f"SELECT page_id, nullif(regexp_extract(e, '^(?:api|http):([^:]+):', 1), '') AS verb, nullif(regexp_extract(e, '^(?:api|http):[^:]+:(.*)$', 1), '') AS path FROM (SELECT page_id, {_ENDPOINT} AS e FROM pages)")
def c15_endpoint_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verb and path of an endpoint id for each page."""
    e = _read(spark, sf_dir, "pages").select("page_id", F.expr(_ENDPOINT).alias("e"))
    return e.select("page_id", text.endpoint_verb(F.col("e")).alias("verb"), text.endpoint_path(F.col("e")).alias("path"))


@register("c31_risk_tiers", "SELECT o_orderkey, CASE WHEN o_totalprice / 10000 >= 40 THEN 'CRITICAL' WHEN o_totalprice / 10000 >= 20 THEN 'HIGH' WHEN o_totalprice / 10000 >= 8 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM orders")
def c31_risk_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of a score for each order."""
    return _read(spark, sf_dir, "orders").select("o_orderkey", predicates.risk(F.col("o_totalprice") / 10000).alias("tier"))


_TURN = "concat('conv', lpad(cast(conv_id as string), 8, '0'), '::turn', lpad(cast({t} as string), 4, '0'))"


@register("fx4_conversation_closure", f"""
WITH RECURSIVE e AS (SELECT DISTINCT {_TURN.format(t='turn')} AS a, {_TURN.format(t='turn + 1')} AS b FROM conversations c WHERE EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1)),
r AS (SELECT a, b, 1 AS dist FROM e UNION ALL SELECT r.a, e.b, dist + 1 FROM r JOIN e ON e.a = r.b)
SELECT a AS src, b AS dst, dist FROM r
""")  # fmt: skip
def fx4_conversation_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later turn of every turn."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"))
    pairs = turns.join(after, ["conv_id", "turn"])
    return traversal.closure(pairs.select(F.expr(_TURN.format(t="turn")).alias("src"), F.expr(_TURN.format(t="turn + 1")).alias("dst")))


@register("a13_relations", FX1_WITH + """
SELECT id, direction, kind, count(*) AS n FROM (SELECT to_id AS id, 'in' AS direction, coalesce(call_type, type) AS kind FROM edges UNION ALL SELECT from_id, 'out', coalesce(call_type, type) FROM edges) AS e SEMI JOIN nodes USING (id) GROUP BY 1, 2, 3
""")  # fmt: skip
def a13_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each kind that every node has, either way."""
    return lookups.relations(fx1(spark, sf_dir))


@register("a13_unresolved_calls", FX1_WITH + "SELECT from_id, to_id, count(*) AS n FROM edges WHERE type = 'CALLS' AND to_id NOT IN (SELECT id FROM nodes) AND from_id IN (SELECT id FROM nodes) GROUP BY 1, 2")
def a13_unresolved_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of missing nodes."""
    return lookups.unresolved_calls(fx1(spark, sf_dir))


@register("ga2_file_fan_in", FX1_WITH + "SELECT e.to_id AS id, count(DISTINCT n.file) AS files FROM edges e JOIN nodes n ON n.id = e.from_id WHERE e.type = 'CALLS' GROUP BY 1")
def ga2_file_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From how many files each method is called."""
    return lookups.file_fan_in(fx1(spark, sf_dir), "CALLS")


@register("j10_impact_edges", FX1_WITH + "SELECT type, count(*) AS n FROM edges e SEMI JOIN nodes a ON a.id = e.from_id SEMI JOIN nodes b ON b.id = e.to_id WHERE (type = 'CALLS' AND call_type IS NULL) OR type IN ('EXTENDS', 'IMPLEMENTS', 'ROUTES_TO', 'BLADE_USES_ACTION', 'DEPENDS_ON') GROUP BY 1")
def j10_impact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose ends are both nodes, by type."""
    return analyzers.impact_edges(fx1(spark, sf_dir), include_depends_on=True).groupBy("type").agg(F.count("*").alias("n"))


@register("d3_layer_loose", FX1_WITH + "SELECT id, CASE " + " ".join(f"WHEN contains(split_part(id, '::', 1), '{k}') THEN '{k}'" for k in ("Controller", "Http", "Presentation", "UseCase", "Service", "Repository", "Repositories", "Domain", "Infrastructure")) + " END AS layer FROM nodes")
def d3_layer_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer of every node by the first word contained."""
    return fx1(spark, sf_dir).nodes.select("id", predicates.layer_loose(F.col("id")).alias("layer"))


_TERMS = "list_distinct(list_filter(string_split_regex(lower(regexp_replace(regexp_replace({c}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), '\\s+'), lambda w: len(w) > 1 AND NOT list_contains([" + ", ".join(f"'{t}'" for t in text.GENERIC_TERMS) + "], w)))"


@register("c25_jaccard", f"SELECT p_partkey, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END::DOUBLE AS jaccard FROM (SELECT p_partkey, {_TERMS.format(c='p_name')} AS a, {_TERMS.format(c='p_type')} AS b FROM part)")
def c25_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How similar each part's name and type are."""
    a, b = text.split_terms(F.col("p_name")), text.split_terms(F.col("p_type"))
    return _read(spark, sf_dir, "part").select("p_partkey", text.jaccard(a, b).alias("jaccard"))


@register("c2_strip_api", "SELECT page_id, CASE WHEN p = '' THEN '/' ELSE p END AS path FROM (SELECT page_id, rtrim(ltrim(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/'), '/') AS p FROM pages)")
def c2_strip_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path of every page as a mounted route, without the mount."""
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return _read(spark, sf_dir, "pages").select("page_id", text.strip_api_prefix(F.concat(F.lit("/api/v2"), path)).alias("path"))
