"""Registered queries of components that files define by their names, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import autonames
from weftgraph.plans.fixtures import duck, spark_sql
from weftgraph.plans.registry import register

_APP, _KIND, _ITEM = "CASE p_partkey % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'admin' ELSE 'base' END", "concat('kind', cast(p_size % 4 as string))", "cast(p_partkey % 100 as string)"
#: Component files of parts in two applications and a layer that both have; some run in one place only, some are tests or modules.
PARTS = f"""
SELECT DISTINCT {_APP} AS app, p_size % 5 = 0 AS deep, {_KIND} AS kind, CASE p_partkey % 5 WHEN 0 THEN '' ELSE concat('Item', {_ITEM}) END AS item, p_partkey % 5 = 1 AS again,
  CASE p_partkey % 7 WHEN 1 THEN 'client' WHEN 2 THEN 'server' WHEN 3 THEN 'server' ELSE 'all' END AS mode, p_partkey % 11 = 0 AS module, p_partkey % 11 = 1 AS test,
  concat({_APP}, '/components/', CASE WHEN p_size % 5 = 0 THEN 'deep/' ELSE '' END, {_KIND}, '/', CASE p_partkey % 5 WHEN 0 THEN 'index' WHEN 1 THEN concat({_KIND}, 'Item', {_ITEM}) ELSE concat('item', {_ITEM}) END,
    CASE p_partkey % 7 WHEN 1 THEN '.client' WHEN 2 THEN '.server' WHEN 3 THEN '.island' ELSE '' END, CASE p_partkey % 11 WHEN 0 THEN '.ts' WHEN 1 THEN '.spec.ts' ELSE '.vue' END) AS file
FROM @part
"""
DIRS = """
SELECT 'shop/' AS root, 1 AS place, 'shop/components/deep' AS path, 'Deep' AS prefix, true AS path_prefix, 2 AS priority, NULL AS only
UNION ALL SELECT 'shop/', 2, 'shop/components/', NULL, true, 2, NULL UNION ALL SELECT 'shop/', 3, './base//components', NULL, NULL, 2, NULL
UNION ALL SELECT 'admin/', 1, 'admin/components', NULL, false, 2, NULL UNION ALL SELECT 'admin/', 2, 'base/components', NULL, true, 1, '.vue' UNION ALL SELECT 'admin/', 3, 'shop/components/deep', 'Deep', true, 3, NULL
"""
LAYERS = "SELECT 'shop/' AS root, 'shop' AS layer UNION ALL SELECT 'shop/', 'base' UNION ALL SELECT 'admin/', 'admin' UNION ALL SELECT 'admin/', 'base'"
#: Tags that line items' parts give the pages of their suppliers.
TAGS = """
SELECT concat(CASE l_suppkey % 4 WHEN 0 THEN 'shop' WHEN 1 THEN 'admin' WHEN 2 THEN 'base' ELSE 'other' END, '/pages/s', cast(l_suppkey as string), '.vue') AS file,
  concat(CASE l_partkey % 6 WHEN 1 THEN 'Lazy' WHEN 2 THEN 'LazyVisible' WHEN 3 THEN 'Deep' WHEN 4 THEN 'lazy' ELSE '' END, CASE WHEN l_partkey % 7 = 0 THEN '' ELSE concat('Kind', cast(l_partkey % 4 as string)) END, CASE WHEN l_partkey % 10 = 9 THEN '' ELSE concat('Item', cast(l_partkey % 100 as string)) END) AS tag
FROM @lineitem
"""
REGISTRY = f"""
WITH RECURSIVE parts AS ({duck(PARTS)}),
claims AS (SELECT 'shop/' AS root, CASE WHEN app = 'base' THEN 3 WHEN deep THEN 1 ELSE 2 END AS place, 2 AS priority, * FROM parts WHERE app <> 'admin' AND NOT test
  UNION ALL SELECT 'admin/', CASE app WHEN 'admin' THEN 1 WHEN 'base' THEN 2 ELSE 3 END, CASE app WHEN 'admin' THEN 2 WHEN 'base' THEN 1 ELSE 3 END, * FROM parts WHERE NOT test AND (app <> 'base' OR NOT module) AND (app <> 'shop' OR deep)),
named AS (SELECT root, place, priority, file, mode, CASE WHEN app <> 'admin' THEN CASE WHEN deep THEN 'Deep' ELSE '' END || 'K' || substr(kind, 2) || item WHEN item = '' OR again THEN 'K' || substr(kind, 2) || item ELSE item END AS name FROM claims),
ranked AS (SELECT *, row_number() OVER (PARTITION BY root, place, name, mode ORDER BY file) AS nr, min(CASE mode WHEN 'all' THEN file END) OVER (PARTITION BY root, place, name) AS everywhere FROM named),
good AS (SELECT *, nr = 1 AND (mode = 'all' OR everywhere IS NULL OR file < everywhere) AS ok FROM ranked),
twice AS (SELECT root, name, bool_or(NOT ok) AS dup FROM good GROUP BY ALL),
entries AS (SELECT root, name, mode, {{'file': file, 'priority': priority}} AS f, row_number() OVER (PARTITION BY root, name ORDER BY place, file) AS step FROM good WHERE ok),
fold AS (SELECT root, name, 0 AS k, NULL::STRUCT(file VARCHAR, priority INT) AS a, NULL::STRUCT(file VARCHAR, priority INT) AS c, NULL::STRUCT(file VARCHAR, priority INT) AS s, dup FROM twice
  UNION ALL
  SELECT root, name, k + 1, CASE WHEN mode = 'all' AND how IN ('new', 'win') THEN f WHEN spot = 'all' AND how = 'win' THEN NULL ELSE a END,
    CASE WHEN mode = 'client' AND how IN ('new', 'win') THEN f ELSE c END, CASE WHEN mode = 'server' AND how IN ('new', 'win') THEN f ELSE s END, dup OR how = 'tie'
  FROM (SELECT *, CASE WHEN other IS NULL THEN 'new' WHEN f.priority > other.priority THEN 'win' WHEN f.priority = other.priority THEN 'tie' ELSE 'lose' END AS how
    FROM (SELECT *, coalesce(own, a) AS other, CASE WHEN own IS NULL THEN 'all' ELSE mode END AS spot
      FROM (SELECT fold.*, e.mode, e.f, CASE e.mode WHEN 'all' THEN a WHEN 'client' THEN c ELSE s END AS own FROM fold JOIN entries e ON e.root = fold.root AND e.name = fold.name AND e.step = fold.k + 1)))),
last AS (SELECT root, name, arg_max(struct_pack(a := a, c := c, s := s, dup := dup), k) AS z FROM fold GROUP BY ALL),
found AS (SELECT root, name, m.mode, m.x.file AS file, m.x.priority AS priority, z.dup AS duplicate FROM (SELECT root, name, z, unnest([{{'mode': 'all', 'x': z.a}}, {{'mode': 'client', 'x': z.c}}, {{'mode': 'server', 'x': z.s}}]) AS m FROM last) WHERE m.x IS NOT NULL)
"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = spark_sql(spark, sf_dir, DIRS).withColumn("extensions", F.when(F.col("only").isNotNull(), F.array("only")))
    return autonames.registry(spark_sql(spark, sf_dir, PARTS).select("file"), dirs)


@register("n6_component_registry", REGISTRY + "SELECT root, name, mode, file, priority, duplicate FROM found")
def n6_component_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of two applications that share a layer."""
    return _registry(spark, sf_dir)


@register("n7_component_tags", REGISTRY + f"""
, used AS (SELECT DISTINCT file, tag, split_part(file, '/', 1) AS layer FROM ({duck(TAGS)})),
asked AS (SELECT u.*, l.root, n.way, n.name FROM used u JOIN (SELECT DISTINCT root, layer FROM ({duck(LAYERS)})) l USING (layer), LATERAL (SELECT 0 AS way, u.tag AS name UNION SELECT 1, regexp_replace(u.tag, '^Lazy(Visible)?([A-Z])', '\\2')) n),
hits AS (SELECT file, tag, root, arg_min(struct_pack(files := files, dup := dup), way) AS k FROM asked JOIN (SELECT root, name, list(DISTINCT found.file) AS files, bool_or(duplicate) AS dup FROM found GROUP BY ALL) USING (root, name) GROUP BY ALL),
answers AS (SELECT file, tag, count(*) AS apps, bool_or(k.dup OR len(k.files) > 1) AS several, list_sort(list_distinct(flatten(list(CASE WHEN k.dup THEN [] ELSE k.files END)))) AS files FROM hits GROUP BY ALL)
SELECT u.file, u.tag, CASE WHEN apps IS NULL THEN 'unresolved' WHEN several OR len(files) <> 1 THEN 'ambiguous' ELSE 'resolved' END AS kind, CASE WHEN NOT several AND len(files) = 1 THEN files[1] END AS target, coalesce(array_to_string(files, '|'), '') AS files, coalesce(apps, 0) AS apps
FROM used u LEFT JOIN answers USING (file, tag)
""")  # fmt: skip
def n7_component_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every tag on suppliers' pages means."""
    found = autonames.resolve_tags(spark_sql(spark, sf_dir, TAGS), spark_sql(spark, sf_dir, LAYERS), _registry(spark, sf_dir))
    return found.select("file", "tag", "kind", "target", F.array_join("files", "|").alias("files"), F.size("roots").cast("long").alias("apps"))
