"""Registered queries of inheritance, components and cycles, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph
from weftgraph.operators import components, inheritance
from weftgraph.plans.fixtures import duck, spark_sql
from weftgraph.plans.registry import register

#: Parts that lead to others of their group of four, by key and size, some to the part of half their number, and few to one of twice theirs: components of many sizes.
_P = "concat('p', lpad(cast({} as string), 8, '0'))".format
PART_STEPS = f"""
SELECT {_P('p_partkey')} AS from_id, {_P('p_partkey - p_partkey % 4 + (p_partkey * 3 + p_size) % 4')} AS to_id, 'CALLS' AS type, p_partkey AS ord FROM @part
UNION ALL SELECT {_P('p_partkey')}, {_P('cast(floor(p_partkey / 2) as bigint)')}, 'DEPENDS_ON', p_partkey FROM @part WHERE p_size % 5 = 0
UNION ALL SELECT {_P('p_partkey')}, {_P('(p_partkey * 2 + 1) % n')}, 'CALLS', p_partkey + n FROM @part, (SELECT count(*) AS n FROM @part) AS c WHERE p_size % 9 = 4
"""
_PARTS = f"WITH RECURSIVE edges AS ({duck(PART_STEPS)}), adj AS (SELECT from_id AS a, to_id AS b, arg_min(type, ord) AS kind FROM edges WHERE from_id <> to_id GROUP BY ALL)"


def part_steps(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """Parts and their steps; each is in a file of ten."""
    e = spark_sql(spark, sf_dir, PART_STEPS).withColumn("id", F.concat("type", F.lit(":"), "from_id"))
    nodes = e.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return CodeGraph.of(nodes.select("id", F.lit("method").alias("type"), F.concat(F.substring("id", 1, 8), F.lit(".php")).alias("file")), e)


@register("a3_components", _PARTS + """
, r(a, b) AS (SELECT a, b FROM adj UNION SELECT r.a, adj.b FROM r JOIN adj ON adj.a = r.b),
m AS (SELECT x.a AS id, max(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1 HAVING bool_or(x.b <> x.a)),
i AS (SELECT s.component, count(*) AS edges FROM adj JOIN m s ON s.id = adj.a JOIN m d ON d.id = adj.b AND d.component = s.component GROUP BY 1)
SELECT component, size, edges, members FROM (SELECT component, count(*) AS size, array_to_string(list_sort(list(id))[1:5], ',') AS members FROM m GROUP BY 1) JOIN i USING (component)
""")  # fmt: skip
def a3_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components among all parts."""
    found = components.component_sizes(part_steps(spark, sf_dir), include_depends_on=True)
    return found.withColumn("members", F.array_join("members", ","))


_GROW = "".join(
    f", w{n + 1} AS (SELECT start, place, b AS last, list_append(path, b) AS path, list_append(kinds, kind) AS kinds FROM w{n} JOIN adj ON a = last WHERE NOT list_contains(path, b) AND NOT EXISTS (SELECT 1 FROM starts s WHERE s.id = b AND s.place < w{n}.place))"
    for n in range(2, 6)
)


@register("a3_cycles_from_nodes", _PARTS + f"""
, starts AS (SELECT concat('p', lpad(cast(p_partkey as string), 8, '0')) AS id, p_size * 1000000 + p_partkey AS place FROM part WHERE p_partkey % 3 = 0)
, w2 AS (SELECT s.id AS start, place, b AS last, [a, b] AS path, [kind] AS kinds FROM starts s JOIN adj ON a = s.id WHERE NOT EXISTS (SELECT 1 FROM starts x WHERE x.id = b AND x.place < s.place)){_GROW}
, c AS ({' UNION ALL '.join(f'SELECT path, {n} AS length, list_append(kinds, kind) AS kinds FROM w{n} JOIN adj ON a = last AND b = start' for n in range(2, 7))})
, o AS (SELECT *, array_to_string(list_append(path, path[1]), ' -> ') AS name FROM c ORDER BY length, name LIMIT 20)
SELECT name AS path, length::INT AS length, array_to_string(kinds, ',') AS kinds, array_to_string(list_sort(list_distinct(list_transform(path, lambda p: concat(p[1:8], '.php')))), ',') AS files FROM o
""")  # fmt: skip
def a3_cycles_from_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty shortest cycles, of six parts at most, that pass every third part; those of small size are asked for first."""
    g = part_steps(spark, sf_dir)
    asked = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 3 = 0").selectExpr("concat('p', lpad(cast(p_partkey as string), 8, '0')) AS id", "p_size * 1000000 + p_partkey AS place")
    found = components.cycles_from_nodes(g, asked, 6, 20, include_depends_on=True)
    name = F.array_join(F.array_append("path", F.element_at("path", 1)), " -> ")
    return found.select(name.alias("path"), "length", F.array_join("kinds", ",").alias("kinds"), F.array_join("files", ",").alias("files"))


#: Suppliers under suppliers, with traits by nation; only some have the method `ship`, and some nations lend it.
_S = "concat('S', lpad(cast({} as string), 8, '0'))".format
_T = "concat('T', lpad(cast({} as string), 8, '0'))".format
SUPPLIER_EDGES = f"""
SELECT {_S('s_suppkey')} AS from_id, {_S('cast(floor(s_suppkey / 2) as bigint)')} AS to_id, 'EXTENDS' AS type, s_suppkey AS ord FROM @supplier WHERE s_suppkey > 0 AND s_suppkey % 16 <> 0
UNION ALL SELECT {_S('s_suppkey')}, {_T('s_nationkey')}, 'USES_TRAIT', 1 FROM @supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT {_S('s_suppkey')}, {_T('(s_nationkey + 5) % 25')}, 'USES_TRAIT', 0 FROM @supplier WHERE s_suppkey % 4 = 0
"""
SUPPLIER_NODES = f"""
SELECT concat({_S('s_suppkey')}, '::ship') AS id, 'method' AS type FROM @supplier WHERE s_suppkey % 7 = 1
UNION ALL SELECT concat({_T('n_nationkey')}, '::ship'), 'method' FROM @nation WHERE n_nationkey % 2 = 0
"""
_SUPPLIERS = f"WITH RECURSIVE edges AS ({duck(SUPPLIER_EDGES)}), nodes AS ({duck(SUPPLIER_NODES)}), classes AS (SELECT {_S('s_suppkey')} AS id FROM supplier), up AS (SELECT id AS class, id AS owner, 0 AS dist FROM classes UNION ALL SELECT class, e.to_id, dist + 1 FROM up JOIN edges e ON e.type = 'EXTENDS' AND e.from_id = up.owner)"


@register("g40_lookup_method", _SUPPLIERS + """
, places AS (SELECT class, owner, dist, -1 AS place, CAST(NULL AS VARCHAR) AS trait FROM up UNION ALL SELECT class, e.to_id, dist, e.ord, e.to_id FROM up JOIN edges e ON e.type = 'USES_TRAIT' AND e.from_id = up.owner),
f AS (SELECT p.*, n.id AS target, row_number() OVER (PARTITION BY class ORDER BY dist, place, owner) AS r FROM places p JOIN nodes n ON n.id = concat(p.owner, '::ship'))
SELECT class, target, dist, trait FROM f WHERE r = 1
""")  # fmt: skip
def g40_lookup_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every supplier finds the method `ship`: itself, its traits, or those above it."""
    g = CodeGraph.of(spark_sql(spark, sf_dir, SUPPLIER_NODES), spark_sql(spark, sf_dir, SUPPLIER_EDGES))
    asked = spark_sql(spark, sf_dir, f"SELECT {_S('s_suppkey')} AS class, 'ship' AS method FROM @supplier")
    return inheritance.lookup_method(g, asked).select("class", "target", "dist", "trait")


@register("g40_same_or_ancestor", _SUPPLIERS + f"""
, pairs AS (SELECT DISTINCT {_S('cast(floor(l_suppkey / 4) as bigint)')} AS ancestor, {_S('(l_suppkey + l_partkey % 3 * 25) % 100')} AS descendant FROM lineitem)
SELECT ancestor, descendant, EXISTS (SELECT 1 FROM up WHERE class = descendant AND owner = ancestor) OR ancestor = descendant AS holds FROM pairs
""")  # fmt: skip
def g40_same_or_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one supplier stands over another, for the pairs that line items make."""
    trees = inheritance.forest(inheritance.first_parents(CodeGraph.of(spark_sql(spark, sf_dir, SUPPLIER_NODES), spark_sql(spark, sf_dir, SUPPLIER_EDGES))))
    pairs = spark_sql(spark, sf_dir, f"SELECT DISTINCT {_S('cast(floor(l_suppkey / 4) as bigint)')} AS ancestor, {_S('(l_suppkey + l_partkey % 3 * 25) % 100')} AS descendant FROM @lineitem")
    return inheritance.same_or_ancestor(trees, pairs)
