"""Registered queries of imports, inherited types and output budgets, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators import budget, imports, properties
from weftgraph.plans.fixtures import duck, spark_sql
from weftgraph.plans.registry import register

#: Modules of parts in seven packages, with several extensions, some as a directory's index.
FILES = """
SELECT concat('src/g', cast(p_size % 7 as string), '/m', cast(p_partkey as string), CASE p_partkey % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.vue' WHEN 2 THEN '/index.js' WHEN 3 THEN '.js' WHEN 4 THEN '.jsx' ELSE '/index.tsx' END) AS file FROM @part
UNION ALL SELECT concat('src/g', cast(p_size % 7 as string), '/m', cast(p_partkey as string), '/index.ts') FROM @part WHERE p_partkey % 12 < 5
"""
#: What line items' parts import from those of the next package: by relative paths, general and scoped aliases, full names, and packages.
_AT = "concat('g', cast(p_size % 7 as string), '/m', cast(p_partkey as string))"
IMPORTS = f"""
SELECT file, k, base, CASE k WHEN 0 THEN concat('..//x/../', base) WHEN 1 THEN concat('@/', base) WHEN 2 THEN concat('~lib/', base) WHEN 3 THEN concat('./../', base, '.vue') WHEN 4 THEN concat('lib/', base) WHEN 5 THEN concat('./../../../', base) ELSE '"@"' END AS source
FROM (SELECT DISTINCT concat('src/g', cast(l_suppkey % 7 as string), '/a', cast(l_suppkey as string), '.ts') AS file, (l_partkey + l_suppkey) % 7 AS k, {_AT} AS base FROM @lineitem JOIN @part ON p_partkey = l_partkey) AS t
"""
ALIASES = "SELECT NULL AS directory, '@' AS alias, './src/' AS target UNION ALL SELECT 'src/g3', '~lib', 'src' UNION ALL SELECT 'src', '~lib/', 'old' UNION ALL SELECT 'src/g3', '@', 'never' UNION ALL SELECT '', 'lib/g2', 'src/g3' UNION ALL SELECT '', 'lib', 'src'"


@register("x3_resolve_imports", f"""
WITH files AS ({duck(FILES)}), i AS ({duck(IMPORTS)}),
p AS (SELECT DISTINCT file, regexp_replace(source, '"', '', 'g') AS source, CASE k WHEN 0 THEN 'src/' || base WHEN 1 THEN 'src/' || base WHEN 2 THEN CASE WHEN file LIKE 'src/g3/%' THEN 'src/' || base ELSE 'old/' || base END WHEN 3 THEN 'src/' || base || '.vue'
  WHEN 4 THEN CASE WHEN base LIKE 'g2/%' THEN 'src/g3' || substr(base, 3) ELSE 'src/' || base END WHEN 5 THEN '../' || base ELSE 'src' END AS path FROM i),
e AS (SELECT p.*, t.place, p.path || t.ending AS spot FROM p, (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.vue'), (8, '/index.ts'), (9, '/index.tsx'), (10, '/index.js')) t(place, ending) WHERE place = 0 OR NOT suffix(path, '.vue')),
h AS (SELECT e.file, source, arg_min(spot, place) AS hit FROM e JOIN (SELECT DISTINCT file AS spot FROM files) f USING (spot) GROUP BY ALL)
SELECT file, source, coalesce(hit, CASE WHEN suffix(path, '.vue') THEN path ELSE path || '.js' END) AS path, CASE WHEN hit IS NULL THEN 'missing' ELSE 'found' END AS how FROM p LEFT JOIN h USING (file, source)
""")  # fmt: skip
def x3_resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the imports of every supplier's module lead."""
    return imports.resolve_imports(spark_sql(spark, sf_dir, IMPORTS), spark_sql(spark, sf_dir, FILES), spark_sql(spark, sf_dir, ALIASES))


#: Types of suppliers' properties, and the suppliers, or nations, that they take others from.
TYPES = """
SELECT concat('S', cast(s_suppkey as string)) AS class, concat('this.p', cast(s_suppkey % 3 as string)) AS property, concat('T', cast(s_nationkey as string)) AS type FROM @supplier WHERE s_suppkey % 4 = 1
UNION ALL SELECT concat('N', cast(n_nationkey as string)), 'this.region', concat('R', cast(n_regionkey as string)) FROM @nation
UNION ALL SELECT concat('N', cast(n_nationkey as string)), 'this.p1', concat('N', cast(n_regionkey as string)) FROM @nation WHERE n_nationkey % 3 = 0
"""
PARENTS = """
SELECT concat('S', cast(s_suppkey as string)) AS class, concat('S', cast(cast(floor(s_suppkey / 2) as bigint) as string)) AS parent, s_suppkey AS ord FROM @supplier WHERE s_suppkey > 1
UNION ALL SELECT concat('S', cast(s_suppkey as string)), concat('N', cast(s_nationkey as string)), s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END FROM @supplier WHERE s_suppkey % 5 < 2
"""
_ROUND = "r{n} AS (SELECT coalesce(o.class, x.class) AS class, coalesce(o.property, x.property) AS property, coalesce(x.type, o.type) AS type FROM r{m} o FULL JOIN (SELECT e.class, r.property, arg_max(r.type, ord) AS type FROM parents e JOIN r{m} r ON r.class = e.parent GROUP BY ALL) x ON x.class = o.class AND x.property = o.property)"


@register("p28_inherited_types", f"WITH parents AS ({duck(PARENTS)}), r0 AS ({duck(TYPES)}), {', '.join(_ROUND.format(n=n, m=n - 1) for n in range(1, 9))} SELECT class, property, type FROM r8")
def p28_inherited_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of properties of every supplier after eight rounds."""
    return properties.inherited_types(spark_sql(spark, sf_dir, TYPES), spark_sql(spark, sf_dir, PARENTS))

#: What a customer's orders say, as lines of three sections: the open ones, the finished ones, and the rest.
LINES = """
SELECT o_custkey AS task, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END AS section, o_orderkey AS place, repeat(concat(o_orderpriority, ' order ', cast(o_orderkey as string), ' is ', o_orderstatus, '; '), 3) AS line,
  CASE o_orderstatus WHEN 'O' THEN 4 WHEN 'F' THEN 1 ELSE 0 END AS keep, o_orderstatus <> 'O' AS may_go FROM @orders
"""
BUDGETS = "SELECT c_custkey AS task, 200 + c_custkey % 40 AS tokens FROM @customer WHERE c_custkey % 9 > 0"


@register("a15_output_budget", f"""
WITH RECURSIVE lines AS ({duck(LINES)}), budgets AS ({duck(BUDGETS)}),
n AS (SELECT *, row_number() OVER (PARTITION BY task, section ORDER BY place) AS nr FROM lines),
u AS (SELECT task, section, place, CASE WHEN nr > keep + 1 THEN 1 WHEN may_go THEN 2 ELSE 3 END AS phase, CASE WHEN nr > keep + 1 THEN nr ELSE 0 END AS nr, len(line) + 1 AS size FROM n),
k AS (SELECT task, row_number() OVER (PARTITION BY task ORDER BY phase, section DESC, nr DESC) AS step, phase, section, nr, sum(size) AS size FROM u WHERE phase < 3 GROUP BY task, phase, section, nr),
w AS (SELECT task, 0 AS step, sum(size)::BIGINT AS size FROM u GROUP BY 1
  UNION ALL SELECT w.task, w.step + 1, (w.size - k.size)::BIGINT FROM w JOIN budgets b ON b.task = w.task JOIN k ON k.task = w.task AND k.step = w.step + 1 WHERE ceil((w.size - 1) / 3.5) > greatest(200, b.tokens)),
d AS (SELECT task, max(step) AS steps FROM w GROUP BY 1)
SELECT u.task, u.section, u.place, d.steps > 0 AS trimmed FROM u JOIN d USING (task) LEFT JOIN k ON k.task = u.task AND k.phase = u.phase AND k.section = u.section AND k.nr = u.nr WHERE k.step IS NULL OR k.step > d.steps
""")  # fmt: skip
def a15_output_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines about every customer's orders that fit the customer's budget."""
    return budget.trim(spark_sql(spark, sf_dir, LINES), spark_sql(spark, sf_dir, BUDGETS)).select("task", "section", "place", "trimmed")
