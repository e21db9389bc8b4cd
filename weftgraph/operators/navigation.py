"""Ways from entry points to code: routes, clients, fields, tests, freshness and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.predicates import class_of, data_layer, edge_bonus, feature_file_role, file_role, file_role_penalty, framework_noise, semantic_bonus, visible_call
from weftgraph.functions.text import endpoint_path, endpoint_version, short_label
from weftgraph.model import CodeGraph
from weftgraph.operators.search import find
from weftgraph.operators.traversal import call_chain
from weftgraph.sources.graphs import top_per_group
from weftgraph.sources.storage import cut, stored


def endpoint_aliases(graph: CodeGraph) -> DataFrame:
    """(endpoint, alias): each endpoint itself, and the routes that it resolves to. Makes `is it or resolves to it` an equality join."""
    ends = graph.nodes.where(F.col("type").isin("api_endpoint", "http_endpoint")).select(F.col("id").alias("endpoint"), F.col("id").alias("alias"))
    return ends.unionByName(graph.edges.where("type = 'RESOLVES_TO'").select(F.col("from_id").alias("endpoint"), F.col("to_id").alias("alias"))).distinct()


def route_handlers(graph: CodeGraph, limit: int | None = 6) -> DataFrame:
    """(endpoint, handler): methods that serve an endpoint, directly or through the route that it resolves to; all, without a limit."""
    routes = graph.edges.where("type = 'ROUTES_TO'").select(F.col("from_id").alias("alias"), F.col("to_id").alias("handler")).distinct()
    found = endpoint_aliases(graph).join(routes, "alias").select("endpoint", "handler").distinct()
    return found if limit is None else top_per_group(found, ["endpoint"], ["handler"], limit)


def http_clients(graph: CodeGraph, limit: int | None = 20) -> DataFrame:
    """(endpoint, client): code that requests an endpoint, or one that resolves to it; all, without a limit."""
    asks = graph.edges.where("type = 'HTTP_REQUEST'").select(F.col("from_id").alias("client"), F.col("to_id").alias("endpoint")).distinct()
    found = endpoint_aliases(graph).join(asks, "endpoint").select(F.col("alias").alias("endpoint"), "client").distinct()
    return found if limit is None else top_per_group(found, ["endpoint"], ["client"], limit)


def http_upstream(graph: CodeGraph) -> DataFrame:
    """(handler, client, endpoint): who reaches a method over HTTP."""
    return http_clients(graph, None).join(route_handlers(graph, None), "endpoint").select("handler", "client", "endpoint")


def http_downstream(graph: CodeGraph, limit: int | None = 20) -> DataFrame:
    """(client, endpoint, handler, score): what a client's requests reach; of several handlers those of the same API version stay. All, without a limit."""
    # repeated edges count once, before they can multiply each other
    asks = graph.edges.where("type = 'HTTP_REQUEST'").select(F.col("from_id").alias("client"), F.col("to_id").alias("endpoint")).distinct()
    way = endpoint_aliases(graph).join(graph.edges.where("type = 'ROUTES_TO'").select(F.col("from_id").alias("alias"), F.col("to_id").alias("handler")).distinct(), "alias", "left")
    # the score does not depend on the client: of each endpoint only the best handlers meet its clients
    version = endpoint_version(endpoint_path(F.col("endpoint")))
    score = F.when(F.col("handler").isNull(), -200).otherwise(0) + F.when(version == endpoint_version(endpoint_path(F.col("alias"))), 100).otherwise(0) + F.when(F.lower("handler").contains(F.concat(F.lit("\\v"), version, F.lit("\\"))), 80).otherwise(0)
    scored = way.select("endpoint", "handler", F.coalesce(score, F.lit(0)).alias("score")).distinct()
    best = scored.groupBy("endpoint").agg(F.max("score").alias("top"))
    ways = scored.join(best, "endpoint").where("score = top").drop("top")
    if limit is not None:
        # an endpoint gives a client `limit` rows at most
        ways = top_per_group(ways, ["endpoint"], ["handler"], limit)
    # a client's request of an endpoint without a node has no way
    rows = asks.join(ways, "endpoint", "left").select("client", "endpoint", "handler", F.coalesce("score", F.lit(-200)).alias("score"))
    return rows if limit is None else top_per_group(rows, ["client"], ["endpoint", "handler"], limit)


def route_middleware(graph: CodeGraph, limit: int | None = 12) -> DataFrame:
    """(endpoint, middleware); all, without a limit."""
    edges = graph.edges.where("type = 'USES_MIDDLEWARE'").select(F.col("from_id").alias("endpoint"), "to_id").distinct()
    found = edges.join(graph.nodes.select(F.col("id").alias("to_id"), F.col("name").alias("middleware")), "to_id").select("endpoint", "middleware").distinct()
    return found if limit is None else top_per_group(found, ["endpoint"], ["middleware"], limit)


def reads_of(graph: CodeGraph) -> DataFrame:
    """(method, field): request fields that a method or one of its members reads."""
    return graph.edges.where("type = 'READS_FIELD'").select(F.explode(F.array_distinct(F.array("from_id", F.regexp_replace("from_id", r"^(.*::[^:]+)::.*$", "$1")))).alias("method"), F.col("to_id").alias("field")).distinct()


def nearest_source(graph: CodeGraph) -> DataFrame:
    """(id, source): the node itself, or its nearest container, that has a file; however far up. Containers that hold each other end."""
    n = graph.nodes.select("id", "file", F.coalesce("parent", F.nullif(F.regexp_extract("id", "^(.*)::[^:]*$", 1), F.lit(""))).alias("up"))
    done, todo = n.where("file IS NOT NULL").select("id", F.col("id").alias("source")), cut(n.where("file IS NULL AND up IS NOT NULL").select("id", "up"))
    above, seen = n.select(F.col("id").alias("up"), F.col("file").alias("f"), F.col("up").alias("next")), todo
    while not todo.isEmpty():
        step = todo.join(above, "up")
        done = done.unionByName(step.where("f IS NOT NULL").select("id", F.col("up").alias("source")))
        todo = cut(step.where("f IS NULL AND next IS NOT NULL").select("id", F.col("next").alias("up")).join(seen, ["id", "up"], "left_anti"))
        seen = seen.unionByName(todo)
    return done


def data_layer_reach(graph: CodeGraph, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, depth): the starts from which `depth` visible calls at most lead to a class of the data layer, and the fewest that do.

    Goes back from the data layer for all starts at once. A level has one row a node, with the first and the last of what it reaches: a node that
    reaches nothing but itself does not count.
    """
    calls = graph.edges.where(visible_call() & ~framework_noise(F.col("to_id"))).select("from_id", "to_id")
    known = graph.nodes.select(F.col("id").alias("to_id"))
    front = stored(known.where(data_layer(F.col("to_id"))).distinct().select("to_id", F.col("to_id").alias("lo"), F.col("to_id").alias("hi")))
    found = starts.select(F.col("id").alias("start"), F.lit(0).alias("depth")).where("false")
    for lvl in range(1, depth + 1):
        if front.isEmpty():
            break
        step = stored(calls.join(front, "to_id").groupBy("from_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        found = found.unionByName(step.where("lo <> from_id OR hi <> from_id").select(F.col("from_id").alias("start"), F.lit(lvl).alias("depth")))
        front = step.withColumnRenamed("from_id", "to_id").join(known, "to_id", "left_semi")
    own = starts.select(F.col("id").alias("start"))
    return found.join(own, "start", "left_semi").groupBy("start").agg(F.min("depth").alias("depth"))


def related_tests(graph: CodeGraph, symbols: DataFrame, limit: int = 3) -> DataFrame:
    """(id, file, how): test files with edges into a symbol, then those whose name holds the symbol's class."""
    files = graph.nodes.where(file_role(F.col("file")) == "test").select(F.col("id").alias("from_id"), "file")
    kinds = ("CALLS", "INSTANTIATES", "DEPENDS_ON", "REFERENCES", "HTTP_REQUEST", "IMPORTS")
    linked = graph.edges.where(F.col("type").isin(*kinds)).join(files, "from_id").join(symbols.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("to_id").alias("id"), "file", F.lit(0).alias("how"))
    short = lambda c: F.lower(short_label(class_of(c)))
    stem = F.regexp_replace(F.lower(F.regexp_replace(F.substring_index("file", "/", -1), r"(\.(test|spec))?\.[^.]+$", "")), "(test|spec|cest)$", "")
    named = symbols.select("id", short(F.col("id")).alias("k")).where(F.length("k") >= 4).join(files.select("file", stem.alias("k")).distinct(), "k").select("id", "file", F.lit(1).alias("how"))
    each = linked.unionByName(named).groupBy("id", "file").agg(F.min("how").alias("how"))
    return top_per_group(each, ["id"], ["how", "file"], limit)


def freshness(meta: DataFrame, now: Column | None = None, head: str | None = None) -> DataFrame:
    """(age_days, drifted, stale): how old a graph is, and whether the code moved on since."""
    at = F.max(F.when(F.col("key") == "scanned_at", F.col("value")))
    commit = F.max(F.when(F.col("key") == "git_commit", F.col("value")))
    row = meta.agg(F.try_to_timestamp(at).alias("at"), commit.alias("commit"))
    age = F.greatest(F.lit(0), F.round((F.unix_timestamp(now if now is not None else F.current_timestamp()) - F.unix_timestamp("at")) / 86400).cast("int"))
    drifted = F.lit(head).isNotNull() & F.col("commit").isNotNull() & (F.col("commit") != F.lit(head))
    return row.select(age.alias("age_days"), F.coalesce(drifted, F.lit(False)).alias("drifted")).withColumn("stale", F.coalesce(F.col("age_days") > 14, F.lit(False)) | F.col("drifted"))


def confidence(rows: DataFrame) -> DataFrame:
    """Adds `level`: high, medium or low, from penalties for a weak match, ambiguity, gaps and age.

    Needs score, ambiguous, handlers, action_defined, entries, files, drifted, age_days and gaps.
    """
    yes = lambda c, n=1: F.when(c, n).otherwise(0)
    penalty = (
        F.when(F.col("score") < 500, 2).when(F.col("score") < 900, 1).otherwise(0) + yes(F.col("ambiguous")) + yes(F.col("handlers") > 1) + yes(~F.col("action_defined"))
        + yes(F.col("entries") == 0) + yes(F.col("files") == 0, 2) + yes(F.col("drifted")) + yes(F.col("age_days") > 14) + yes(F.col("gaps") >= 3)
    )
    return rows.withColumn("level", F.when(penalty == 0, "high").when(penalty <= 2, "medium").otherwise("low"))


def feature(graph: CodeGraph, query: str, limit: int = 20) -> DataFrame:
    """(file, role, score): files of a feature: those of matches, and their neighbours by strength of the edge."""
    hits = stored(find(graph, query, 60).where("file IS NOT NULL").groupBy("file").agg(F.max("score").alias("score")))
    seeds = stored(hits.orderBy(F.desc("score"), "file").limit(8).select("file"))
    f = graph.nodes.where("file IS NOT NULL").select("id", "file")
    # the seeds' nodes are written down, so that Spark knows how few they are before it deals out the edges
    own = stored(f.join(seeds, "file", "left_semi").select("id"))
    way = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("other"))
    both = graph.edges.select(F.explode(F.array(way("from_id", "to_id"), way("to_id", "from_id"))).alias("e"), "type").select("e.*", "type")
    best = both.join(own, "id", "left_semi").groupBy(F.col("other").alias("id")).agg(F.max(F.lit(450) + edge_bonus(F.col("type"))).alias("score"))
    more = stored(best).join(f, "id").join(seeds, "file", "left_anti").groupBy("file").agg(F.max("score").alias("score"))
    # every file here holds a node: the first ones are found before their types
    top = stored(hits.unionByName(more).groupBy("file").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "file").limit(limit))
    types = graph.nodes.join(top.select("file"), "file", "left_semi").groupBy("file").agg(F.collect_set("type").alias("types"))
    return top.join(types, "file").select("file", feature_file_role(F.col("file"), F.col("types")).alias("role"), "score").orderBy(F.desc("score"), "file")


def locate(graph: CodeGraph, query: str, depth: int = 3, limit: int = 12, files: int = 5) -> DataFrame:
    """(file, score, id): the files where work on a feature begins: matches, their callees by distance and layer, their handlers."""
    match = stored(find(graph, query, 3)).select("id", "file", F.col("score").alias("base"), F.lit(True).alias("matched"))
    chain = call_chain(graph, match.select("id"), depth, limit).join(graph.nodes.select("id", "file"), "id").select("id", "file", (F.lit(870) - F.col("depth") * 10).alias("base"), F.lit(False).alias("matched"))
    routes = route_handlers(graph).join(match.select(F.col("id").alias("endpoint")), "endpoint", "left_semi").select(F.col("handler").alias("id")).join(graph.nodes.select("id", "file"), "id").select("id", "file", F.lit(1250).alias("base"), F.lit(False).alias("matched"))
    penalty = F.when(F.col("matched"), 0).otherwise(file_role_penalty(F.col("file")))
    ranked = match.unionByName(chain).unionByName(routes).where("file IS NOT NULL").select("id", "file", (F.col("base") + semantic_bonus(short_label(F.col("id")), F.col("file")) - penalty).alias("score"))
    return ranked.groupBy("file").agg(F.max("score").alias("score"), F.min_by("id", F.struct(-F.col("score"), F.col("id"))).alias("id")).orderBy(F.desc("score"), "file").limit(files)
