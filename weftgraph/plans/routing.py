"""Registered queries of route files, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import route_files
from weftgraph.plans.fixtures import duck, spark_sql
from weftgraph.plans.registry import register

_Q, _NL = "chr(39)", "chr(10)"
#: A route for each part, in blocks of suppliers' groups, those in the groups of their nations; comments and strings hold brackets.
_PART = f"concat('    // {{ ( ', p_name, {_NL}, '    Route::', CASE WHEN p_partkey % 4 = 3 THEN 'apiResource' WHEN p_partkey % 4 = 2 THEN 'post' ELSE 'get' END, '(', {_Q}, 'part', cast(p_partkey as string), CASE WHEN p_partkey % 4 = 3 THEN '.lines' ELSE '/{{id}}' END, {_Q}, ', ', CASE WHEN p_partkey % 4 = 3 THEN 'Part::class' WHEN p_partkey % 4 = 2 THEN concat('[', chr(92), 'Own', chr(92), 'Part::class, ', {_Q}, 'keep', {_Q}, ']') ELSE 'Shown::class' END, ')', CASE WHEN p_partkey % 4 = 3 THEN concat('->only([', {_Q}, 'index', {_Q}, ', ', {_Q}, 'edit', {_Q}, ', ', {_Q}, 'show', {_Q}, '])') WHEN p_partkey % 4 = 1 THEN concat('->middleware(', {_Q}, 'throttle:', cast(p_size as string), ',(1', {_Q}, ')') ELSE '' END, ';', {_NL})"
ROUTE_FILES = f"""
SELECT concat('routes/s', cast(s_suppkey as string), '.php') AS file, CASE WHEN s_suppkey % 3 = 0 THEN '/mounted/' END AS mount,
  concat('<?php', {_NL}, 'use App', chr(92), 'Http', chr(92), 'Part;', {_NL}, 'use App', chr(92), 'Views', chr(92), 'Show as Shown;', {_NL},
  'Route::prefix(', {_Q}, 'nation', cast(s_nationkey as string), {_Q}, ')->middleware([', {_Q}, 'auth', {_Q}, ', Part::class])->group(function () {{ /* }} */ $x = ', {_Q}, '}}', {_Q}, ';', {_NL},
  '  Route::group([', {_Q}, 'prefix', {_Q}, ' => ', {_Q}, 's', cast(s_suppkey as string), {_Q}, ', ', {_Q}, 'middleware', {_Q}, ' => [', {_Q}, 'auth', {_Q}, ', ', {_Q}, 'log', {_Q}, ']], function (): void {{', {_NL}, body, '  }});', {_NL}, '}});', {_NL},
  'Route::get(', {_Q}, '/', {_Q}, ', Shown::class);', {_NL}, 'Route::get(', {_Q}, '/closed', {_Q}, ', function () {{ return 1; }});', {_NL}) AS text
FROM (SELECT s_suppkey, s_nationkey, array_join(array_sort(collect_list(part)), '') AS body FROM (SELECT DISTINCT l_suppkey, {_PART} AS part FROM @lineitem JOIN @part ON p_partkey = l_partkey) AS p JOIN @supplier ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_nationkey) AS s
""".replace("{{", "{").replace("}}", "}")


def found_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of every supplier's file."""
    return route_files.routes(spark_sql(spark, sf_dir, ROUTE_FILES))


@register("p31_file_routes", r"""
WITH own AS (SELECT DISTINCT s_suppkey AS s, s_nationkey AS n, p_partkey AS p, p_size AS z FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
spots AS (SELECT *, CASE WHEN s % 3 = 0 THEN '/mounted/' ELSE '' END || 'nation' || n || '/s' || s || '/part' || p AS base FROM own)
SELECT 'routes/s' || s || '.php' AS file, CASE WHEN p % 4 = 2 THEN 'POST' ELSE 'GET' END AS verb, base || CASE WHEN p % 4 = 3 THEN '/{param}/lines' ELSE '/{id}' END || e.more AS path,
  CASE p % 4 WHEN 3 THEN 'App\Http\Part' WHEN 2 THEN 'Own\Part' ELSE 'App\Views\Show' END AS controller, CASE p % 4 WHEN 3 THEN e.does WHEN 2 THEN 'keep' ELSE '__invoke' END AS action,
  'auth|App\Http\Part|log' || CASE WHEN p % 4 = 1 THEN '|throttle:' || z || ',(1' ELSE '' END AS middleware
FROM spots JOIN (VALUES ('', 'index'), ('/{param}', 'show')) e(more, does) ON e.more = '' OR p % 4 = 3
UNION ALL SELECT DISTINCT 'routes/s' || s || '.php', 'GET', CASE WHEN s % 3 = 0 THEN '/mounted/' ELSE '/' END, 'App\Views\Show', '__invoke', '' FROM own
""")  # fmt: skip
def p31_file_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every route of suppliers' files, with what its groups add."""
    return found_routes(spark, sf_dir).select("file", "verb", "path", "controller", "action", F.array_join("middleware", "|").alias("middleware"))


@register("p35_route_graph", r"""
WITH own AS (SELECT DISTINCT s_suppkey AS s, s_nationkey AS n, p_partkey AS p, p_size AS z FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
ends AS (SELECT *, 'api:' || CASE WHEN p % 4 = 2 THEN 'POST' ELSE 'GET' END || ':' || CASE WHEN s % 3 = 0 THEN 'mounted/' ELSE '' END || 'nation' || n || '/s' || s || '/part' || p || CASE WHEN p % 4 = 3 THEN '/{param}/lines' ELSE '/{param}' END || more AS id FROM own JOIN (VALUES (''), ('/{param}')) e(more) ON more = '' OR p % 4 = 3),
guards AS (SELECT id, unnest(['auth', 'App\Http\Part', 'log']) AS m FROM ends UNION ALL SELECT id, 'throttle:' || z || ',(1' FROM ends WHERE p % 4 = 1)
SELECT 'USES_MIDDLEWARE' AS type, 'middleware:' || m AS to_id, count(*) AS n FROM guards GROUP BY m
UNION ALL SELECT 'ROUTES_TO', CASE p % 4 WHEN 3 THEN 'App\Http\Part::' || CASE more WHEN '' THEN 'index' ELSE 'show' END WHEN 2 THEN 'Own\Part::keep' ELSE 'App\Views\Show::__invoke' END,
  count(*) + CASE WHEN min(p % 4) IN (0, 1) THEN (SELECT count(DISTINCT s % 3 = 0) FROM own) ELSE 0 END FROM ends GROUP BY 2
""")  # fmt: skip
def p35_route_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many endpoints of suppliers' files lead to each handler and pass each middleware."""
    return route_files.route_graph(found_routes(spark, sf_dir)).edges.groupBy("type", "to_id").agg(F.count("*").alias("n"))
