"""Graphs over the driver's tables. Each is SQL that Spark and DuckDB both run; `{t}` stands for table t."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from weftgraph.model import CodeGraph

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _n(key: str) -> str:
    return f"lpad(cast({key} as string), 8, '0')"


def _ns(*parts: str) -> str:
    """A name with namespace separators."""
    return "concat('" + "', chr(92), '".join(parts) + "'"


_CUSTOMER = f"{_ns('app', 'Http', 'Controllers', 'Customer')}, {_n('c_custkey')})"
_ORDER = f"{_ns('app', 'Services', 'Order')}, {_n('{k}')})"
_PART = f"{_ns('app', 'Domain', 'Part')}, {_n('{k}')})"
_SUPPLIER = f"{_ns('app', 'Infrastructure', 'Supplier')}, {_n('{k}')})"
_NATION = f"{_ns('app', 'Domain', 'Nation')}, {_n('{k}')})"
_REGION = f"{_ns('app', 'Contracts', 'Region')}, {_n('{k}')}, 'Interface')"


def _k(text: str, key: str) -> str:
    return text.replace("{k}", key)


def _m(cls: str, name: str) -> str:
    return f"concat({cls}, '::{name}')"


_O, _P, _S = (lambda key, t=t: _k(t, key) for t in (_ORDER, _PART, _SUPPLIER))
_PFILE = f"concat('app/domain/part', {_n('p_partkey')}, '.php')"
_SFILE = f"concat('app/infrastructure/supplier', {_n('s_suppkey')}, '.php')"
_CFILE = f"concat('app/http/controllers/', lower(c_mktsegment), '/customer', {_n('c_custkey')}, '.php')"
_ROUTE = "concat('api:GET:/', lower(c_mktsegment), '/{{param}}')".replace("{{", "{").replace("}}", "}")

#: Layered commerce call graph.
FX1_NODES = f"""
SELECT {_m(_CUSTOMER, 'place')} AS id, {_CUSTOMER} AS parent, 'method' AS type, 'place' AS name, {_CFILE} AS file, 'public' AS visibility FROM @customer
UNION ALL SELECT {_CUSTOMER}, NULL, 'class', concat('Customer', {_n('c_custkey')}), {_CFILE}, NULL FROM @customer
UNION ALL SELECT {_m(_O('o_orderkey'), 'fulfil')}, {_O('o_orderkey')}, 'method', 'fulfil', concat('app/services/', lower(o_orderstatus), '/order', {_n('o_orderkey')}, '.php'), 'public' FROM @orders
UNION ALL SELECT {_m(_P('p_partkey'), 'reserve')}, {_P('p_partkey')}, 'method', 'reserve', {_PFILE}, 'public' FROM @part WHERE p_size <= 45
UNION ALL SELECT {_m(_S('s_suppkey'), 'ship')}, {_S('s_suppkey')}, 'method', 'ship', {_SFILE}, 'public' FROM @supplier
UNION ALL SELECT {_m(_S('s_suppkey'), 'audit')}, {_S('s_suppkey')}, 'method', 'audit', {_SFILE}, 'public' FROM @supplier
UNION ALL SELECT {_S('s_suppkey')}, NULL, 'class', concat('Supplier', {_n('s_suppkey')}), {_SFILE}, NULL FROM @supplier
UNION ALL SELECT {_k(_NATION, 'n_nationkey')}, NULL, 'class', n_name, concat('app/domain/nation', {_n('n_nationkey')}, '.php'), NULL FROM @nation
UNION ALL SELECT {_k(_REGION, 'r_regionkey')}, NULL, 'interface', r_name, concat('app/contracts/region', {_n('r_regionkey')}, '.php'), NULL FROM @region
UNION ALL SELECT DISTINCT {_ROUTE}, NULL, 'api_endpoint', lower(c_mktsegment), 'routes/api.php', NULL FROM @customer
"""
FX1_EDGES = f"""
SELECT concat('E1:', {_n('o_orderkey')}) AS id, {_m(_CUSTOMER.replace('c_custkey', 'o_custkey'), 'place')} AS from_id, {_m(_O('o_orderkey'), 'fulfil')} AS to_id, 'CALLS' AS type, NULL AS call_type FROM @orders
UNION ALL SELECT concat('E2:', {_n('l_orderkey')}, ':', cast(l_linenumber as string)), {_m(_O('l_orderkey'), 'fulfil')}, {_m(_P('l_partkey'), 'reserve')}, 'CALLS', CASE WHEN l_linestatus = 'O' THEN 'OVERRIDE_RESOLVED' END FROM @lineitem
UNION ALL SELECT concat('E3:', {_n('l_partkey')}, ':', {_n('l_suppkey')}), {_m(_P('l_partkey'), 'reserve')}, {_m(_S('l_suppkey'), 'ship')}, 'CALLS', NULL FROM (SELECT DISTINCT l_partkey, l_suppkey FROM @lineitem) AS d
UNION ALL SELECT concat('E4:', {_n('l_orderkey')}, ':', cast(l_linenumber as string)), {_m(_S('l_suppkey'), 'ship')}, {_m(_O('l_orderkey'), 'fulfil')}, 'CALLS', NULL FROM @lineitem WHERE l_returnflag = 'R' AND l_orderkey % 10 = 0
UNION ALL SELECT concat('E5c:', {_n('c_custkey')}), {_CUSTOMER}, {_k(_NATION, 'c_nationkey')}, 'DEPENDS_ON', NULL FROM @customer
UNION ALL SELECT concat('E5s:', {_n('s_suppkey')}), {_S('s_suppkey')}, {_k(_NATION, 's_nationkey')}, 'DEPENDS_ON', NULL FROM @supplier
UNION ALL SELECT concat('E6:', {_n('n_nationkey')}), {_k(_NATION, 'n_nationkey')}, {_k(_REGION, 'n_regionkey')}, 'IMPLEMENTS', NULL FROM @nation
UNION ALL SELECT concat('E7:', {_n('s_suppkey')}), {_S('s_suppkey')}, {_S('cast(floor(s_suppkey / 2) as bigint)')}, 'EXTENDS', NULL FROM @supplier WHERE s_suppkey > 0
UNION ALL SELECT concat('E8:', {_n('c_custkey')}), {_ROUTE}, {_m(_CUSTOMER, 'place')}, 'ROUTES_TO', NULL FROM @customer WHERE c_custkey % 7 = 0
"""

#: Transitions between event types.
FX2_NODES = "SELECT DISTINCT event_type AS id, NULL AS parent, 'method' AS type, event_type AS name, concat('events/', event_type, '.php') AS file FROM @events"
FX2_EDGES = "SELECT concat(a, '->', b) AS id, a AS from_id, b AS to_id, 'CALLS' AS type, count(*) AS weight FROM (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM @events) AS t WHERE b IS NOT NULL GROUP BY a, b"

#: Endpoints of pages and of the links in them.
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)"
_BARE = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
#: Requests as pages of .net hosts under an API prefix, others as they are; routes of https pages are mounted under /api.
FX3_CLIENT = f"SELECT DISTINCT concat('http:GET:', CASE WHEN url LIKE '%.net/%' THEN '/api/v1' ELSE '' END, {_PATH}) AS id FROM @pages WHERE url IS NOT NULL"
FX3_ROUTE = f"SELECT DISTINCT concat('api:GET:', CASE WHEN url LIKE 'https:%' THEN '/api' ELSE '' END, {_BARE}) AS id, CASE WHEN url LIKE 'https:%' THEN 'api' END AS mount FROM @pages WHERE url IS NOT NULL"
#: Links of pages.
FX3_LINKS = "SELECT page_id, explode(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM @pages"


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run fixture SQL over the Parquet tables."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"@{t}" in sql}
    text = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"@(\w+)", r"{\1}", text), **used)


def duck(sql: str) -> str:
    """The same SQL for DuckDB."""
    return re.sub(r"@(\w+)", r"\1", sql).replace("explode(", "unnest(")


def fx1(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The commerce call graph."""
    return CodeGraph.of(spark_sql(spark, sf_dir, FX1_NODES), spark_sql(spark, sf_dir, FX1_EDGES))


def fx2(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The event transition graph."""
    return CodeGraph.of(spark_sql(spark, sf_dir, FX2_NODES), spark_sql(spark, sf_dir, FX2_EDGES))


#: Opening of an oracle query over the commerce call graph.
FX1_WITH = f"WITH RECURSIVE nodes AS ({duck(FX1_NODES)}), edges AS ({duck(FX1_EDGES)}), visible AS (SELECT * FROM edges WHERE type = 'CALLS' AND call_type IS NULL)"
FX2_WITH = f"WITH RECURSIVE nodes AS ({duck(FX2_NODES)}), edges AS ({duck(FX2_EDGES)})"
