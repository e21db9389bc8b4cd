"""Registered queries of the search for many texts at once, with the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph
from weftgraph.operators import grams
from weftgraph.operators.search import BONUS, SUFFIX_MALUS, TOKEN_CAP, query_variants, split_parts
from weftgraph.plans.fixtures import FX1_WITH, fx1, spark_sql
from weftgraph.plans.registry import register
from weftgraph.plans.requests import _CANDIDATES, _REQUEST, ASKED, ENDS
from weftgraph.sources.storage import cut

#: Texts of several shapes: words, names in mixed case, members, paths, what is no symbol, and what is nowhere.
TEXTS = ("supplier00000007", "Order00000012", "RegionInterface", "Customer00000003::place", "domain part", "app/domain/part00000001.php", "NationSupplier", "ship", "furniture", "x9z9x9")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VARIANTS = ", ".join(f"({_quoted(q)}, {k}, {_quoted(t)}, {_quoted(t.lower())}, {_quoted(s)}, {BONUS[s]}, [{', '.join(map(_quoted, split_parts(t.lower())))}])" for q in TEXTS for k, (t, s) in enumerate(query_variants(q)))


@register("a9_find_many", FX1_WITH + f"""
, v(query, k, text, low, source, bonus, words) AS (VALUES {_VARIANTS}),
n AS (SELECT id, type, file, lower(id) AS i, lower(coalesce(name, '')) AS m, lower(coalesce(file, '')) AS f, type IN ('class', 'method', 'interface') AS own FROM nodes),
s AS (SELECT query, k, text, source, bonus, n.*, CASE WHEN id = text THEN 1500 WHEN suffix(i, concat(chr(92), low)) OR i = low THEN 1450 WHEN suffix(i, '::' || low) THEN 1425 WHEN m = low THEN 1400 WHEN contains(i, low) THEN 900 WHEN contains(m, low) THEN 850 WHEN contains(f, low) THEN 800
  ELSE 50 * len(list_filter(words, lambda x: contains(i, x) OR contains(m, x) OR contains(f, x))) + CASE WHEN len(list_filter(words, lambda x: contains(i, x) OR contains(m, x) OR contains(f, x))) > 0 THEN 250 ELSE 0 END END AS score FROM v, n),
t AS (SELECT query, k, id, type, file, own, CASE WHEN source = 'token' THEN least(score, {TOKEN_CAP}) ELSE score END + bonus - CASE WHEN source = 'token' AND regexp_full_match(query, '[A-Z][A-Za-z0-9]+') AND len(text) < len(query) AND (suffix(id, concat(chr(92), text)) OR suffix(id, '::' || text))
  AND NOT suffix(i, concat(chr(92), lower(query))) AND NOT contains(i, concat(chr(92), lower(query), '::')) THEN {SUFFIX_MALUS} ELSE 0 END AS score FROM s WHERE score > 0),
b AS (SELECT query, id, type, file, own, max(score) AS score FROM t GROUP BY ALL),
w AS (SELECT *, bool_or(own) OVER (PARTITION BY query) AS has_own FROM b)
SELECT query, place::INT AS place, id, type, file, score::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM w WHERE own OR NOT has_own) WHERE place <= 20
""")  # fmt: skip
def a9_find_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best symbols of the commerce graph for each text; where there is none, of all nodes."""
    g = CodeGraph.of(fx1(spark, sf_dir).nodes, spark.createDataFrame([], "from_id string, to_id string, type string"))
    found = grams.find_many(g, spark.createDataFrame([(t,) for t in TEXTS], "query string").withColumn("kind", F.lit("symbol")))
    return found.select("query", "place", "id", "type", "file", "score")


@register("a9_find_routes", _REQUEST + f""", {_CANDIDATES},
p AS (SELECT id, file, verb AS own, list(path) AS paths FROM k GROUP BY ALL),
z AS (SELECT a.query, p.id, p.file, verb, own, CASE WHEN list_contains(paths, requested) THEN CASE WHEN own = verb THEN 1450 ELSE 1250 END WHEN list_contains(paths, framework) THEN CASE WHEN own = verb THEN 1400 ELSE 1200 END
  ELSE 500 + 10 * list_max(list_transform(list_filter(string_split(regexp_replace(framework, '/[{{]param[}}]', ''), '/'), lambda t: contains(p.id, t)), lambda t: len(t))) END AS score FROM a, p),
y AS (SELECT *, score + CASE WHEN verb IS NULL THEN 0 WHEN own = verb THEN 200 ELSE -300 END + CASE WHEN file LIKE 'routes/%' THEN 150 ELSE 0 END + CASE WHEN file LIKE 'k6/%' THEN -600 ELSE 0 END AS total FROM z WHERE score IS NOT NULL)
SELECT query, place::INT AS place, id, file, total::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY total DESC, id) AS place FROM y WHERE total > 0) WHERE place <= 5
""")  # fmt: skip
def a9_find_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best routes for every request."""
    g = CodeGraph.of(cut(spark_sql(spark, sf_dir, ENDS)), spark.createDataFrame([], "from_id string, to_id string, type string"))
    found = grams.find_many(g, spark_sql(spark, sf_dir, ASKED).withColumn("kind", F.lit("route")), 5)
    return found.select("query", "place", "id", "file", "score")
