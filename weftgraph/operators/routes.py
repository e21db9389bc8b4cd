"""Requests written as text (`GET /api/v3/items/{id}`, `api:GET:items/{param}`, a bare path) and the routes that they mean.

All are column expressions, so that any number of requests is read and matched at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import normalize_route_path, strip_api_prefix
from weftgraph.model import CodeGraph

# Verbs, and path segments that tell nothing about a route.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
STOP_SEGMENTS = ("api", "www", *VERBS)


def request(query: Column) -> Column:
    """(verb, requested, framework) of a request: verb in capitals or null, the path as asked for, and without a leading API version."""
    text = F.trim(query)
    known = F.lower(text).rlike(r"^(?:api|http):.*:") & (text.startswith("api:") | text.startswith("http:"))
    marked = F.regexp_extract(text, r"^(?:api:|http:)([^:]*):", 1)
    verb = F.when(known, F.upper(marked))
    spoken = F.regexp_extract(text, rf"(?i)^({'|'.join(VERBS)})\s+(\S+)", 1)
    verb = verb.otherwise(F.nullif(F.upper(spoken), F.lit("")))
    path = F.when(known, F.regexp_extract(text, r"^(?:api|http):[^:]*:(.*)$", 1)).when(spoken != "", F.regexp_extract(text, rf"(?i)^({'|'.join(VERBS)})\s+(\S+)", 2)).otherwise(text)
    asked = normalize_route_path(path)
    return F.struct(verb.alias("verb"), asked.alias("requested"), strip_api_prefix(asked).alias("framework"))


def same_path(left: Column, right: Column) -> Column:
    """Whether two paths have equal segments, whatever their case and the names of their parameters."""
    return F.lower(normalize_route_path(left)) == F.lower(normalize_route_path(right))


def file_prefix(file: Column) -> Column:
    """The path under which a route file is mounted by its name: `api.v3.php` under `api/v3`, `api.php` under `api`, others nowhere (null)."""
    base = F.regexp_replace(F.substring_index(F.lower(F.translate(file, "\\", "/")), "/", -1), r"\.(php|ts|js)$", "")
    parts = F.filter(F.split(base, "[._-]+"), lambda x: x != "")
    at = F.array_position(parts, F.lit("api")).cast("int")
    version = F.get(parts, at)  # what follows `api`, as positions count from 1
    return F.when(F.coalesce(at, F.lit(0)) == 0, F.lit(None)).when(version.rlike(r"^v\d+$"), F.concat(F.lit("api/"), version)).otherwise(F.lit("api"))


def candidate_paths(id: Column, file: Column) -> Column:
    """The paths that an endpoint may be asked for by: as stored, and under its file's prefix."""
    stored = normalize_route_path(F.when(id.rlike("^(?:api|http):[^:]*:"), F.regexp_extract(id, r"^(?:api|http):[^:]*:(.*)$", 1)).otherwise(id))
    prefix = file_prefix(file)
    mounted = prefix.isNotNull() & (stored != prefix) & ~stored.startswith(F.concat(prefix, F.lit("/")))
    return F.when(mounted, F.array(stored, normalize_route_path(F.concat(prefix, F.lit("/"), stored)))).otherwise(F.array(stored))


def path_terms(path: Column) -> Column:
    """Segments of a path that say something: no parameters, verbs, API marks or versions, two characters at least."""
    segments = F.transform(F.split(path, "/"), lambda s: F.trim(F.regexp_replace(s, r"^\{.*\}$", "")))
    return F.array_distinct(F.filter(segments, lambda s: (F.length(s) >= 2) & ~F.lower(s).isin(*STOP_SEGMENTS) & ~F.lower(s).rlike(r"^v\d+$")))


# Places of routes that only tests use, and of those that production registers.
LOW_SIGNAL = r"(^|/)(k6|tests?|fixtures?|benchmark|load[_-]?test)(/|$)"
PRODUCTION = r"(^|/)routes/|(^|/)[^/]*(routes?|router)[^/]*\.(php|ts|js)$"


def low_signal(file: Column) -> Column:
    """Whether routes in a file are those of tests, fixtures or load tests."""
    return F.coalesce(F.lower(F.translate(file, "\\", "/")).rlike(LOW_SIGNAL), F.lit(False))


def production_routes(file: Column) -> Column:
    """Whether a file registers routes in production."""
    return F.coalesce(F.lower(F.translate(file, "\\", "/")).rlike(PRODUCTION), F.lit(False))


def endpoint_ids(asked: Column) -> Column:
    """The ids that a request (of `request`) may have as an endpoint, exactly."""
    paths = F.array_distinct(F.array(asked["requested"], asked["framework"]))
    return F.when(asked["verb"].isNotNull(), F.transform(paths, lambda p: F.concat(F.lit("api:"), asked["verb"], F.lit(":"), p))).otherwise(F.array().cast("array<string>"))


def follow_ups(asked: Column, most: int = 5) -> Column:
    """What to look for next: the path without its version, the path as asked for, then the last three terms."""
    terms = path_terms(asked["requested"])
    last = F.slice(F.reverse(terms), 1, 3)
    all_ = F.concat(F.array(asked["framework"]), F.when(asked["verb"].isNotNull(), F.array(asked["requested"])).otherwise(F.array().cast("array<string>")), F.reverse(last))
    return F.slice(F.array_distinct(F.filter(all_, lambda x: (x != "/") & (F.length(x) >= 2))), 1, most)


def routes_for(graph: CodeGraph, requests: DataFrame) -> DataFrame:
    """(query, id, exact): the endpoints that each request means, by equality joins on verb and path; those of tests only where nothing else fits.

    `exact`: the path as asked for, not only what is left of it without the API version. Requests without a verb fit any.
    """
    asked = requests.select("query").distinct().withColumn("r", request(F.col("query")))
    ways = asked.select("query", "r.verb", F.explode(F.array_distinct(F.array(F.struct(F.lower("r.requested").alias("path"), F.lit(True).alias("exact")), F.struct(F.lower("r.framework").alias("path"), (F.lower("r.framework") == F.lower("r.requested")).alias("exact"))))).alias("w")).select("query", "verb", "w.*")
    ends = graph.nodes.where(F.col("type").isin("api_endpoint", "http_endpoint")).select("id", "file", F.upper(F.regexp_extract("id", r"^(?:api|http):([^:]*):", 1)).alias("own"), F.explode(candidate_paths(F.col("id"), F.col("file"))).alias("path"))
    found = ways.join(ends.withColumn("path", F.lower("path")), "path").where(F.col("verb").isNull() | (F.col("verb") == F.col("own")))
    one = found.groupBy("query", "id").agg(F.bool_or("exact").alias("exact"), F.bool_and(low_signal(F.col("file"))).alias("low"))
    least = one.groupBy("query").agg(F.min("low").alias("low"))
    return one.join(least, ["query", "low"]).select("query", "id", "exact")
