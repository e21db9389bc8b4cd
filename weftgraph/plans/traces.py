"""Registered queries of traces and of what surrounds a target, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph
from weftgraph.operators import trace
from weftgraph.plans.fixtures import _CFILE, _CUSTOMER, _NATION, _REGION, _ROUTE, FX1_EDGES, FX1_NODES, _k, _m, _O, _S, duck, spark_sql
from weftgraph.plans.registry import register

_SEG = "lower(c_mktsegment)"
_LOAD, _ASK, _PLACE, _VIEW = f"concat('js:pages/', {_SEG}, '.js::load')", f"concat('http:GET:/api/', {_SEG})", _m(_CUSTOMER, "place"), f"concat('blade:', {_SEG}, '.form')"
_PLACED = _m(_CUSTOMER.replace("c_custkey", "o_custkey"), "place")

#: The commerce graph behind pages that request its routes; suppliers bill through those above them, and audit through interfaces that nations implement.
NODES = f"""{FX1_NODES}
UNION ALL SELECT DISTINCT {_ASK}, NULL, 'http_endpoint', NULL, NULL, NULL FROM @customer
UNION ALL SELECT DISTINCT concat('js:pages/', {_SEG}, '.js'), NULL, 'js_module', {_SEG}, concat('pages/', {_SEG}, '.js'), NULL FROM @customer
UNION ALL SELECT DISTINCT {_LOAD}, NULL, 'js_function', 'load', concat('pages/', {_SEG}, '.js'), NULL FROM @customer
UNION ALL SELECT {_CUSTOMER}, NULL, 'class', 'x', {_CFILE}, NULL FROM @customer WHERE 1 = 0
UNION ALL SELECT {_m(_S('s_suppkey'), 'billing')}, {_S('s_suppkey')}, CASE WHEN s_suppkey % 10 < 2 THEN 'method' ELSE 'external' END, 'billing', CASE WHEN s_suppkey % 10 < 2 THEN concat('app/b', cast(s_suppkey as string), '.php') END, NULL FROM @supplier
UNION ALL SELECT {_m(_k(_NATION, 'n_nationkey'), 'audit')}, {_k(_NATION, 'n_nationkey')}, 'method', 'audit', CASE WHEN n_nationkey = 3 THEN 'tests/AuditTest.php' ELSE concat('app/n', cast(n_nationkey as string), '.php') END, 'public' FROM @nation WHERE n_nationkey < 7
UNION ALL SELECT {_m(_k(_REGION, 'r_regionkey'), 'audit')}, {_k(_REGION, 'r_regionkey')}, 'method', 'audit', concat('app/contracts/region', cast(r_regionkey as string), '.php'), 'public' FROM @region
"""
EDGES = f"""SELECT id, from_id, to_id, type, call_type, NULL AS via FROM ({FX1_EDGES}) AS f
UNION ALL SELECT DISTINCT concat('T1:', {_SEG}), {_LOAD}, {_ASK}, 'HTTP_REQUEST', NULL, NULL FROM @customer
UNION ALL SELECT DISTINCT concat('T2:', {_SEG}), {_ASK}, {_ROUTE}, 'RESOLVES_TO', NULL, NULL FROM @customer WHERE c_mktsegment > 'B'
UNION ALL SELECT concat('T3:', cast(c_custkey as string)), {_ASK}, {_PLACE}, 'ROUTES_TO', NULL, NULL FROM @customer WHERE c_custkey % 50 = 3
UNION ALL SELECT concat('T4:', cast(o_orderkey as string)), {_m(_O('o_orderkey'), 'fulfil')}, {_m(_S('o_custkey % n'), 'billing')}, 'CALLS', CASE WHEN o_orderkey % 3 = 0 THEN 'STATIC' END, NULL FROM @orders, (SELECT count(*) AS n FROM @supplier) AS c
UNION ALL SELECT concat('T5:', cast(s_suppkey as string)), {_m(_S('s_suppkey'), 'ship')}, {_m(_S('s_suppkey'), 'audit')}, 'CALLS', NULL, NULL FROM @supplier
UNION ALL SELECT concat('T6:', cast(s_suppkey as string)), {_m(_S('s_suppkey'), 'audit')}, {_m(_k(_REGION, 'n_regionkey'), 'audit')}, 'CALLS', CASE WHEN s_suppkey % 6 = 0 THEN 'STATIC' END, NULL FROM @supplier JOIN @nation ON n_nationkey = s_nationkey
UNION ALL SELECT concat('T7:', cast(c_custkey as string)), concat('request_field:', {_SEG}), concat({_PLACE}, '::input'), 'ASSIGNS', NULL, NULL FROM @customer WHERE c_custkey % 3 = 0
UNION ALL SELECT concat('T8:', cast(c_custkey as string)), {_PLACE}, concat('request_field:', {_SEG}), 'READS_FIELD', NULL, NULL FROM @customer WHERE c_custkey % 2 = 0
UNION ALL SELECT concat('T9:', cast(c_custkey as string)), {_PLACE}, concat('request_field:phone', cast(c_nationkey as string)), 'READS_FIELD', NULL, NULL FROM @customer
UNION ALL SELECT concat('TA:', cast(o_orderkey as string)), concat({_PLACED}, '::input'), {_m(_O('o_orderkey'), 'fulfil')}, 'FLOWS_TO', NULL, CASE WHEN o_orderkey % 4 = 0 THEN 'input' END FROM @orders WHERE o_orderkey % 5 < 3
UNION ALL SELECT concat('TB:', cast(o_orderkey as string)), concat({_PLACED}, '::input'), concat({_m(_O('o_orderkey'), 'fulfil')}, '::$dto'), 'ARGUMENT_TO', NULL, CASE WHEN o_orderkey % 8 = 0 THEN 'input' END FROM @orders WHERE o_orderkey % 9 < 2
UNION ALL SELECT concat('TC:', cast(c_custkey as string)), {_PLACE}, concat('request_field:', {_SEG}), CASE WHEN c_custkey % 4 = 1 THEN 'VALIDATES' ELSE 'VALIDATES_FIELD' END, NULL, NULL FROM @customer WHERE c_custkey % 4 < 3
UNION ALL SELECT concat('TD:', cast(o_orderkey as string)), {_PLACED}, concat('model_field:order:', cast(o_orderkey % 7 as string)), 'PERSISTS', NULL, NULL FROM @orders WHERE o_orderkey % 6 = 0
UNION ALL SELECT concat('TE:', cast(c_custkey as string)), {_PLACE}, 'config_key:app.name', 'REFERENCES', NULL, NULL FROM @customer WHERE c_custkey % 10 = 0
UNION ALL SELECT concat('TF:', cast(c_custkey as string)), {_VIEW}, {_PLACE}, 'BLADE_USES_ACTION', NULL, NULL FROM @customer WHERE c_custkey % 9 = 0
UNION ALL SELECT concat('TG:', {_SEG}, cast(c_nationkey as string)), concat('js:pages/', {_SEG}, '.js'), concat('field:', cast(min(c_nationkey) as string)), 'ASSIGNS', NULL, NULL FROM @customer GROUP BY c_mktsegment, c_nationkey
"""
#: The rule by which callees are rewritten, as SQL.
WITH = f"""WITH RECURSIVE nodes AS (SELECT * FROM ({duck(NODES)})), edges AS (SELECT * FROM ({duck(EDGES)})),
seen AS (SELECT e.from_id, e.to_id AS id, e.call_type, n.file, n.parent AS class, split_part(e.to_id, '::', 2) AS method FROM edges e JOIN nodes n ON n.id = e.to_id WHERE e.type = 'CALLS' AND (call_type IS NULL OR call_type = 'STATIC')),
impl AS (SELECT e.to_id AS class, m.name AS method, min(m.id) AS one, count(DISTINCT m.id) AS candidates FROM edges e JOIN nodes m ON m.parent = e.from_id AND m.type = 'method' AND m.file NOT LIKE 'tests/%' WHERE e.type IN ('IMPLEMENTS', 'EXTENDS') GROUP BY ALL),
up AS (SELECT DISTINCT class AS class, class AS owner, 0 AS d FROM seen WHERE method = 'billing' UNION ALL SELECT class, e.to_id, d + 1 FROM up JOIN edges e ON e.type = 'EXTENDS' AND e.from_id = owner),
above AS (SELECT up.class, m.name AS method, arg_min(m.id, d) AS found FROM up JOIN nodes m ON m.parent = owner AND m.type = 'method' AND m.name = 'billing' GROUP BY ALL),
led AS (SELECT s.*, CASE WHEN s.call_type IS NULL AND s.class LIKE '%Interface' THEN coalesce(i.candidates, 0) END AS candidates,
  CASE WHEN s.call_type = 'STATIC' THEN s.id WHEN s.class LIKE '%Interface' AND i.candidates = 1 THEN i.one WHEN s.file IS NULL THEN coalesce(found, s.id) ELSE s.id END AS target
  FROM seen s LEFT JOIN impl i USING (class, method) LEFT JOIN above a USING (class, method))"""


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Pages, routes, the commerce graph, and fields that flow through it."""
    return CodeGraph.of(spark_sql(spark, sf_dir, NODES), spark_sql(spark, sf_dir, EDGES))


@register("g11_traversal_targets", WITH + " SELECT DISTINCT id, call_type, target, candidates FROM led WHERE method IN ('billing', 'audit')")
def g11_traversal_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where traces go on from every callee that bills or audits."""
    g = graph(spark, sf_dir)
    calls = g.edges.where("type = 'CALLS' AND to_id RLIKE '::(billing|audit)$' AND (call_type IS NULL OR call_type = 'STATIC')").select(F.col("to_id").alias("id"), "call_type").distinct()
    return trace.traversal_targets(g, calls.join(g.nodes.select("id", "file"), "id")).select("id", "call_type", "target", "candidates")


_WALK = WITH + """,
steps AS (SELECT from_id AS node, 'call' AS phase, target AS dst, 'call' AS next, 'CALLS' AS type, min(id) AS called FROM led GROUP BY ALL
  UNION ALL SELECT from_id, 'handler', target, 'call', 'CALLS', min(id) FROM led GROUP BY ALL
  UNION ALL SELECT from_id, 'call', to_id, 'request', type, to_id FROM edges WHERE type = 'HTTP_REQUEST' UNION ALL SELECT split_part(from_id, '::', 1), 'call', to_id, 'request', type, to_id FROM edges WHERE type = 'HTTP_REQUEST'
  UNION ALL SELECT from_id, 'request', to_id, 'bridge', type, to_id FROM edges WHERE type = 'RESOLVES_TO'
  UNION ALL SELECT e.from_id, p.phase, e.to_id, 'handler', e.type, e.to_id FROM edges e, (VALUES ('request'), ('bridge'), ('route')) p(phase) WHERE type = 'ROUTES_TO'),
starts AS (SELECT id AS start, CASE type WHEN 'js_module' THEN 'call' WHEN 'api_endpoint' THEN 'route' ELSE 'request' END AS phase FROM nodes WHERE type IN ('js_module', 'api_endpoint', 'http_endpoint')),
walk AS (SELECT start, 0 AS hop, start AS node, phase FROM starts UNION SELECT w.start, w.hop + 1, s.dst, s.next FROM walk w JOIN steps s ON s.node = w.node AND s.phase = w.phase WHERE w.hop < 7),
states AS (SELECT start, node, phase, min(hop) AS hop FROM walk GROUP BY ALL),
found AS (SELECT t.start, t.hop, t.node, t.phase, s.type, s.called, s.node AS parent, s.phase AS parent_phase, row_number() OVER (PARTITION BY t.start, t.node, t.phase ORDER BY s.node, s.phase, s.type) AS r
  FROM states t JOIN states p ON p.start = t.start AND p.hop = t.hop - 1 JOIN steps s ON s.node = p.node AND s.phase = p.phase AND s.dst = t.node AND s.next = t.phase)
"""


@register("a11_trace", _WALK + "SELECT start, hop::INT AS hop, node, phase, type, called, parent, parent_phase FROM found WHERE r = 1")
def a11_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven steps from every page, route and request."""
    g = graph(spark, sf_dir)
    starts = g.nodes.where("type IN ('js_module', 'api_endpoint', 'http_endpoint')").select("id")
    return trace.trace(g, starts, 7).where("hop > 0").select("start", "hop", "node", "phase", "type", "called", "parent", "parent_phase")


_SUBJECTS = WITH + """,
sub AS (SELECT id AS target, 'method' AS kind, id AS own, 6 AS most FROM nodes WHERE type = 'method' AND name = 'place'
  UNION ALL SELECT c.id, 'class', m.id, 5 FROM nodes c JOIN nodes m ON m.parent = c.id AND m.type = 'method' WHERE c.type = 'class' AND c.name LIKE 'Customer%'
  UNION ALL SELECT target, 'endpoint', min(handler), 6 FROM (SELECT n.id AS target, e.to_id AS handler FROM nodes n JOIN edges e ON e.type = 'ROUTES_TO' AND e.from_id = n.id WHERE n.type IN ('api_endpoint', 'http_endpoint')
    UNION ALL SELECT n.id, e.to_id FROM nodes n JOIN edges x ON x.type = 'RESOLVES_TO' AND x.from_id = n.id JOIN edges e ON e.type = 'ROUTES_TO' AND e.from_id = x.to_id WHERE n.type = 'http_endpoint') GROUP BY target
  UNION ALL SELECT id, 'other', id, 6 FROM nodes WHERE type IN ('js_module', 'js_function')),
alias AS (SELECT id AS endpoint, id AS route FROM nodes WHERE type IN ('api_endpoint', 'http_endpoint') UNION SELECT from_id, to_id FROM edges WHERE type = 'RESOLVES_TO'),
req AS (SELECT DISTINCT h.from_id AS client, h.to_id AS endpoint, r.to_id AS handler FROM edges h JOIN alias a ON a.endpoint = h.to_id JOIN edges r ON r.type = 'ROUTES_TO' AND r.from_id = a.route WHERE h.type = 'HTTP_REQUEST'),
raw AS (SELECT DISTINCT to_id AS own, CASE type WHEN 'CALLS' THEN 'calls' WHEN 'ROUTES_TO' THEN 'route_entries' ELSE 'blade_entries' END AS section, type AS kind, from_id, to_id, via FROM edges WHERE (type = 'CALLS' AND call_type IS NULL AND from_id IN (SELECT id FROM nodes)) OR type IN ('ROUTES_TO', 'BLADE_USES_ACTION')
  UNION ALL SELECT DISTINCT s.o, CASE WHEN type IN ('ASSIGNS', 'READS_FIELD') THEN 'field_assignments' ELSE 'field_flows' END, type, from_id, to_id, via
    FROM edges, unnest([from_id, to_id, regexp_replace(from_id, '::[^:]*$', ''), regexp_replace(to_id, '::[^:]*$', '')]) s(o) WHERE type IN ('ASSIGNS', 'READS_FIELD', 'FLOWS_TO', 'ARGUMENT_TO')
  UNION ALL SELECT DISTINCT from_id, CASE WHEN type = 'PERSISTS' THEN 'persists' WHEN type = 'REFERENCES' THEN 'config_refs' ELSE 'validates' END, type, from_id, to_id, via FROM edges WHERE type IN ('VALIDATES', 'VALIDATES_FIELD', 'PERSISTS', 'REFERENCES')
  UNION ALL SELECT handler, 'http_upstream', 'HTTP_REQUEST', client, endpoint, handler FROM req
  UNION ALL SELECT client, 'http_downstream', 'HTTP_REQUEST', client, endpoint, handler FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY endpoint, handler) AS n FROM req) WHERE n <= 6),
near AS (SELECT target, sub.kind AS of, own, most, section, raw.kind, from_id, to_id, via FROM sub JOIN raw USING (own) WHERE CASE sub.kind WHEN 'method' THEN true WHEN 'class' THEN true
    WHEN 'endpoint' THEN section IN ('field_assignments', 'field_flows', 'validates', 'persists', 'config_refs') ELSE section = 'http_downstream' OR (section IN ('field_assignments', 'field_flows') AND from_id = own AND raw.kind <> 'READS_FIELD') END),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, own, section ORDER BY kind, from_id, to_id, via NULLS FIRST) AS n FROM near) WHERE n <= most),
kept AS (SELECT * FROM one o WHERE NOT (kind = 'READS_FIELD' AND EXISTS (SELECT 1 FROM one a WHERE a.target = o.target AND a.own = o.own AND a.kind = 'ASSIGNS' AND a.section = o.section AND a.from_id = o.to_id AND a.from_id LIKE 'request@_field:%' ESCAPE '@'))
  AND NOT (kind = 'FLOWS_TO' AND EXISTS (SELECT 1 FROM one a WHERE a.target = o.target AND a.own = o.own AND a.kind = 'ARGUMENT_TO' AND a.from_id = o.from_id AND coalesce(a.via, '') = coalesce(o.via, '')))),
pair AS (SELECT n.id AS target, min(r.from_id) AS route, min(r.to_id) AS handler FROM nodes n JOIN alias a ON a.endpoint = n.id JOIN edges r ON r.type = 'ROUTES_TO' AND r.from_id = a.route WHERE n.type IN ('api_endpoint', 'http_endpoint') GROUP BY 1),
cl AS (SELECT DISTINCT p.target, p.route, h.from_id AS client FROM pair p JOIN alias a ON a.route = p.route JOIN edges h ON h.type = 'HTTP_REQUEST' AND h.to_id = a.endpoint),
every AS (SELECT target, section, kind, from_id, to_id, via, 0 AS o FROM kept WHERE section <> 'calls'
  UNION SELECT target, 'graph_entries', kind, from_id, to_id, via, CASE kind WHEN 'CALLS' THEN 1 WHEN 'ROUTES_TO' THEN 2 ELSE 3 END FROM kept WHERE section IN ('calls', 'route_entries', 'blade_entries')
  UNION SELECT target, 'route_entries', 'ROUTES_TO', route, handler, NULL, 0 FROM pair UNION SELECT target, 'http_upstream', 'HTTP_REQUEST', client, route, NULL, 0 FROM cl
  UNION SELECT target, 'graph_entries', 'HTTP_REQUEST', client, route, NULL, 0 FROM cl UNION SELECT DISTINCT p.target, 'graph_entries', 'CALLS', e.from_id, e.to_id, NULL, 1 FROM pair p JOIN edges e ON e.type = 'CALLS' AND e.call_type IS NULL AND e.to_id = p.handler
  UNION SELECT c.id, 'route_entries', 'ROUTES_TO', e.from_id, e.to_id, NULL, 0 FROM nodes c JOIN edges e ON e.type = 'ROUTES_TO' AND split_part(e.to_id, '::', 1) = c.id WHERE c.type = 'class'),
ctx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, section ORDER BY o, kind, from_id, to_id, via NULLS FIRST) AS place FROM every) WHERE place <= 6)
"""


def _targets(g: CodeGraph) -> DataFrame:
    return g.nodes.where("(type = 'method' AND name = 'place') OR (type = 'class' AND name LIKE 'Customer%') OR type IN ('api_endpoint', 'http_endpoint', 'js_module', 'js_function')").select("id")


@register("g42_navigation_context", _SUBJECTS + "SELECT target, section, kind, from_id, to_id, via, place::INT AS place FROM ctx")
def g42_navigation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What surrounds every customer, its method, and every endpoint and page, six rows a section."""
    g = graph(spark, sf_dir)
    return trace.navigation_context(g, _targets(g), 6)


@register("a11_coverage", _SUBJECTS + """,
n AS (SELECT target AS id, count_if(section IN ('route_entries', 'blade_entries', 'graph_entries')) AS entries, count_if(section IN ('route_entries', 'blade_entries')) AS routes, count_if(section = 'http_downstream') AS requests, count_if(section = 'field_assignments') AS fields, count_if(section = 'field_flows') AS flows, count_if(section = 'validates') AS validated, count_if(section = 'persists') AS persisted FROM ctx GROUP BY 1),
c AS (SELECT from_id AS id, count(DISTINCT to_id) AS callees FROM edges WHERE type = 'CALLS' AND call_type IS NULL AND to_id IN (SELECT id FROM nodes) AND from_id LIKE '%::place' GROUP BY 1),
r AS (SELECT DISTINCT split_part(from_id, '::', 1) || '::place' AS id FROM edges WHERE type = 'READS_FIELD'),
x AS (SELECT id, coalesce(entries, 0) AS entries, coalesce(routes, 0) AS routes, coalesce(requests, 0) AS requests, coalesce(fields, 0) AS fields, coalesce(flows, 0) AS flows, coalesce(validated, 0) AS validated, coalesce(persisted, 0) AS persisted, coalesce(callees, 0) AS callees, id IN (SELECT id FROM r) AS reads FROM (SELECT * FROM n FULL JOIN c USING (id)) WHERE id IN (SELECT id FROM nodes)),
w AS (SELECT id, list_filter([CASE WHEN entries > 0 THEN 'entry' END, CASE WHEN fields > 0 THEN 'intake' END, CASE WHEN validated > 0 THEN 'validation' END, CASE WHEN callees + requests > 0 THEN 'calls' END, CASE WHEN requests > 0 THEN 'HTTP downstream' END, CASE WHEN flows > 0 THEN 'field flow to callees' END, CASE WHEN persisted > 0 THEN 'persistence' END, CASE WHEN reads THEN 'reads' END], lambda v: v IS NOT NULL) AS complete,
  callees > 0 AND fields > 0 AND flows = 0 AS partial, list_filter([CASE WHEN entries = 0 THEN 'entry' END, CASE WHEN fields = 0 THEN 'intake' END, CASE WHEN validated = 0 THEN 'validation' END, CASE WHEN callees + requests = 0 THEN 'calls' END], lambda v: v IS NOT NULL) AS missing,
  list_filter([CASE WHEN entries + requests = 0 THEN 'no_entry' END, CASE WHEN callees > 0 AND flows = 0 AND fields > 0 THEN 'no_flow' END], lambda v: v IS NOT NULL) AS warnings FROM x)
SELECT id, array_to_string(complete, ',') AS complete, CASE WHEN partial THEN 'field flow to callees' ELSE '' END AS partial, array_to_string(missing, ',') AS missing, array_to_string(warnings, ',') AS warnings FROM w
""")  # fmt: skip
def a11_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts of the flow through each of those the graph knows, and what to be warned of."""
    g = graph(spark, sf_dir)
    places = g.nodes.where("type = 'method' AND name = 'place'").select("id")
    calls = trace.trace(g, places, 1).where("hop = 1 AND phase = 'call'").select(F.col("start").alias("target"), F.col("node").alias("id"))
    reads = g.edges.where("type = 'READS_FIELD'").select(F.col("from_id").alias("id"))
    found = trace.coverage(trace.context_counts(g, trace.navigation_context(g, _targets(g), 6), calls), reads=reads)
    return found.select("id", *[F.array_join(c, ",").alias(c) for c in ("complete", "partial", "missing", "warnings")])
