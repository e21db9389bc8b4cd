"""Registered queries of the resolving passes, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph
from weftgraph.operators import resolution
from weftgraph.plans.fixtures import FX1_WITH, duck, fx1, spark_sql
from weftgraph.plans.registry import register

#: Suppliers whose `ship` counts as abstract, by the number that their class ends with.
ABSTRACT = 5

#: Requests of pages, each endpoint spelt in several ways.
CALLS = """
SELECT concat('js:page', cast(page_id as string)) AS from_id, 'HTTP_REQUEST' AS type,
  concat('http:GET:/items//', CASE WHEN page_id % 3 = 0 THEN '{id}' WHEN page_id % 3 = 1 THEN concat('$', '{row.id}') ELSE '{param}' END, '/', cast(page_id % 7 as string), CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END) AS to_id
FROM @pages
"""


@register("l8_extends_calls", FX1_WITH + f"""
, down AS (SELECT to_id AS class, from_id AS owner FROM edges WHERE type = 'EXTENDS' UNION SELECT down.class, e.from_id FROM down JOIN edges e ON e.to_id = down.owner AND e.type = 'EXTENDS'),
own AS (SELECT *, name = 'ship' AND CAST(right(parent, 8) AS INT) < {ABSTRACT} AS is_abstract FROM nodes WHERE type = 'method'),
wanted AS (SELECT DISTINCT c.from_id, o.parent AS class, o.name FROM edges c JOIN own o ON o.id = c.to_id WHERE c.type = 'CALLS' AND o.is_abstract)
SELECT to_id, count(*) AS n FROM (SELECT DISTINCT w.from_id, m.id AS to_id FROM wanted w JOIN down USING (class) JOIN own m ON m.parent = down.owner AND m.name = w.name AND NOT m.is_abstract) GROUP BY 1
""")  # fmt: skip
def l8_extends_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls of abstract methods reach each method that fills one in."""
    g = fx1(spark, sf_dir)
    nodes = g.nodes.withColumn("is_abstract", F.when(F.col("name") == "ship", F.right("parent", F.lit(8)).cast("int") < ABSTRACT))
    return resolution.extends_calls(CodeGraph(nodes, g.edges)).groupBy("to_id").agg(F.count("*").alias("n"))


@register("l1_canonical_endpoints", f"""
SELECT to_id, count(*) AS n FROM (
  SELECT DISTINCT from_id, regexp_replace(regexp_replace(regexp_replace(to_id, '\\$?\\{{[^}}]+\\}}', '{{param}}', 'g'), '/+', '/', 'g'), '/$', '') AS to_id FROM ({duck(CALLS)})
) GROUP BY 1
""")  # fmt: skip
def l1_canonical_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each endpoint once its spellings are one."""
    calls = spark_sql(spark, sf_dir, CALLS)
    nodes = calls.select(F.col("to_id").alias("id"), F.lit("http_endpoint").alias("type")).distinct()
    return resolution.canonical_endpoints(CodeGraph.of(nodes, calls)).edges.groupBy("to_id").agg(F.count("*").alias("n"))


@register("g17_prefer_concrete", FX1_WITH + """
, abstract AS (SELECT id FROM nodes WHERE type = 'interface' UNION SELECT to_id FROM edges WHERE type = 'IMPLEMENTS'),
calls AS (SELECT DISTINCT e.from_id, concat(i.to_id, '::', 'load') AS to_id FROM edges e JOIN edges i ON i.from_id = e.to_id AND i.type = 'IMPLEMENTS' WHERE e.type = 'DEPENDS_ON'
  UNION SELECT from_id, concat(to_id, '::', CASE WHEN from_id LIKE '%Supplier%' THEN 'load' ELSE 'store' END) FROM edges WHERE type = 'DEPENDS_ON'),
t AS (SELECT c.*, split_part(to_id, '::', 2) AS name, split_part(to_id, '::', 1) IN (SELECT id FROM abstract) AS ab FROM calls c)
SELECT from_id, to_id FROM t WHERE NOT ab UNION ALL SELECT from_id, min(to_id) FROM t GROUP BY from_id, name HAVING bool_and(ab)
""")  # fmt: skip
def g17_prefer_concrete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers and suppliers call of their nation and of the interface above it."""
    g = fx1(spark, sf_dir)
    needs = g.edges.where("type = 'DEPENDS_ON'").select("from_id", "to_id")
    above = g.edges.where("type = 'IMPLEMENTS'").select(F.col("from_id").alias("to_id"), F.col("to_id").alias("face"))
    name = F.when(F.col("from_id").contains("Supplier"), "load").otherwise("store")
    calls = needs.select("from_id", F.concat("to_id", F.lit("::"), name).alias("to_id")).unionByName(needs.join(above, "to_id").select("from_id", F.concat("face", F.lit("::load")).alias("to_id")))
    return resolution.prefer_concrete(g, calls)
