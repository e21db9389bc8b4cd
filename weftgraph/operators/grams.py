"""Search for many queries at once over an index of character n-grams.

The index holds each distinct run of one, two and three characters of a node's id, name and file once, dealt by run. Whatever a query looks for (its spellings and
their words, or the paths and segments of a request) is a term; the rarest run of a term leads to all nodes that can hold it, by one equality join,
and each is verified on its text. So no query scans the nodes, and no spelling takes a pass of its own. An index costs more than a pass over the nodes: where
none is given and the terms are few, one pass looks for all of them. What is found is scored once for each
query: symbols by the ladder of spellings, requests by the ladder of routes. If nothing of the kinds asked for matches, all kinds count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import normalize_route_path
from weftgraph.model import CodeGraph
from weftgraph.operators.routes import candidate_paths, low_signal, path_terms, production_routes, request
from weftgraph.operators.search import BONUS, FILE_TYPES, SUFFIX_MALUS, TOKEN_CAP, query_variants, split_parts
from weftgraph.sources.graphs import top_per_group
from weftgraph.sources.storage import cut

#: Longest run of characters in the index.
GRAM = 3
#: Most terms that a pass over the nodes looks for where no index is given; the results are the same.
SCAN = 1_000
# Node types of each kind of search, and scores of a route's steps.
KINDS = {
    "symbol": "class method interface trait vue_component js_module blade_view property parameter".split(),
    "route": "api_endpoint http_endpoint route_name".split(),
    "field": "request_field model_field variable_field response_field".split(),
    "config": ["config_literal"],
}
EXPLICIT, EXACT, PUBLIC_VERB, PUBLIC, FRAMEWORK_VERB, FRAMEWORK, SUFFIX, TERM = 2500, 1500, 1450, 1250, 1400, 1200, 900, 500
SAME_VERB, OTHER_VERB, PRODUCTION_FILE, TEST_FILE = 200, -300, 150, -600
_VERB = "(get|post|put|patch|delete|head|options)"


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def gram_index(graph: CodeGraph) -> DataFrame:
    """(gram, id): the distinct runs of 1 to GRAM characters of each node's lower-cased id, name and file, dealt by run and written down."""
    text = F.concat_ws("\n", _low("id"), _low("name"), _low("file"))
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, n)))))
    each = graph.nodes.select("id", F.explode(runs).alias("gram")).where("NOT contains(gram, '\n')").distinct()
    return cut(each.repartition("gram"))


def kind_of(query: Column) -> Column:
    """What a query without a kind asks for: route, field, config or symbol."""
    verb = query.rlike(rf"(?i)\b{_VERB}\b")
    route = query.rlike("^(api|http):") | query.rlike(rf"(?i)^{_VERB}\s+/") | (query.contains("/") & verb)
    return F.when(route, "route").when(query.rlike("^(request|model)_field:"), "field").when(query.startswith("config_key:"), "config").otherwise("symbol")


def _bare(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def _spelled(queries: DataFrame) -> DataFrame:
    """Adds `variants`, (text, source, words, low, want, bonus) of each usual spelling, and `looked`, the terms that they look for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[{"text": t, "source": s, "words": split_parts(t.lower()), "bonus": BONUS[s]} for t, s in query_variants(q)] for q in batch["query"]]
            yield batch.assign(variants=rows)

    found = queries.mapInPandas(run, "query string, kind string, variants array<struct<text:string,source:string,words:array<string>,bonus:int>>")
    low = lambda v: F.lower(v["text"])
    variants = F.transform("variants", lambda v: F.struct(v["text"], v["source"], v["words"], low(v).alias("low"), _bare(low(v)).alias("want"), v["bonus"]))
    return found.select("query", "kind", variants.alias("variants"), _looked(F.flatten(F.transform("variants", lambda v: F.concat(F.array(low(v)), v["words"])))))


def _looked(terms: Column) -> Column:
    return F.array_distinct(F.filter(terms, lambda t: t != "")).alias("looked")


def scan(nodes: DataFrame, asked: DataFrame, texts: list[str]) -> DataFrame:
    """Each node beside each query that looks for a term which one of its `texts` holds. The queries travel as one row to every task.

    A node is few bytes and much work, so nodes are dealt out first.
    """
    one = asked.agg(F.collect_list(F.struct(*asked.columns)).alias("_asked"))
    held = lambda q: F.exists(q["looked"], lambda t: reduce(or_, [F.col(c).contains(t) for c in texts]))
    return nodes.repartition("id").crossJoin(one).select(*nodes.columns, F.explode(F.filter("_asked", held)).alias("_q")).select(*nodes.columns, "_q.*")


def holders(index: DataFrame, nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, in_id, id): nodes whose id, name or file holds one of a query's terms, or its id alone where `in_id`. Terms are (query, term, in_id), lower-cased."""
    terms = cut(terms.distinct())
    n = F.least(F.length("term"), F.lit(GRAM))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - n + 1), lambda i: F.substring("term", i, n)))
    runs = terms.select("term").distinct().select("term", F.explode(grams).alias("gram"))
    often = index.join(runs.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a run that stands nowhere ends its term
    rarest = runs.join(often, "gram", "left").groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    found = rarest.join(index, "gram").select("term", "id").join(nodes.select("id", "low_id", "low_name", "low_file"), "id")
    in_id = F.col("low_id").contains(F.col("term"))
    held = found.withColumn("in_id_", in_id).where(in_id | F.col("low_name").contains(F.col("term")) | F.col("low_file").contains(F.col("term"))).select("term", "id", "in_id_")
    return terms.join(held, "term").where("in_id_ OR NOT in_id").select("query", "in_id", "id").distinct()


def _read(nodes: DataFrame) -> DataFrame:
    """(id, type, file, low_id, low_name, low_file, path, base, stem): what scores read of a node, made once."""
    low = nodes.select("id", "type", "file", _low("id").alias("low_id"), _low("name").alias("low_name"), _low("file").alias("low_file")).withColumn("path", _bare(F.col("low_file")))
    base = low.withColumn("base", F.substring_index("path", "/", -1))
    return base.withColumn("stem", F.regexp_replace("base", r"\.(blade\.php|php|vue|tsx?|jsx?|mjs|cjs)$", ""))


def _symbol_score(variants: Column, query: Column) -> Column:
    """(score, first, why, source, text) of a node's best spelling; of equal ones the first."""
    id_, name, file, path, base, stem = map(F.col, ("low_id", "low_name", "low_file", "path", "base", "stem"))
    own = F.col("type").isin(*FILE_TYPES)
    pascal, low = query.rlike(r"^[A-Z][A-Za-z0-9]+$"), F.lower(query)

    def step(v: Column) -> Column:
        text, want = v["low"], v["want"]
        hits = F.size(F.filter(v["words"], lambda w: id_.contains(w) | name.contains(w) | file.contains(w)))
        steps = [
            (F.col("id") == v["text"], 1500, "exact id"),
            (id_.endswith(F.concat(F.lit("\\"), text)) | (id_ == text), 1450, "exact qualified symbol"),
            (id_.endswith(F.concat(F.lit("::"), text)), 1425, "exact symbol suffix"),
            (name == text, 1400, "exact name"),
            (own & (path == want), 1380, "exact file path"),
            (own & want.contains("/") & path.endswith(F.concat(F.lit("/"), want)), 1360, "exact file path suffix"),
            (own & (base == text), 1340, "exact file name"),
            (own & (stem == text), 1320, "exact file stem"),
            (id_.contains(text), 900, "id contains query"),
            (name.contains(text), 850, "name contains query"),
            (file.contains(text), 800, "file path contains query"),
        ]
        found = F.transform(F.array(hits), lambda n: F.struct(F.when(n > 0, n * 50 + 250).otherwise(0).alias("score"), F.lit("words matched").alias("why")))[0]
        for test, value, reason in reversed(steps):
            found = F.when(test, F.struct(F.lit(value).alias("score"), F.lit(reason).alias("why"))).otherwise(found)
        return found

    def total(v: Column, k: Column, s: Column) -> Column:
        token = v["source"] == "token"
        suffix = lambda t: F.col("id").endswith(F.concat(F.lit("\\"), t)) | F.col("id").endswith(F.concat(F.lit("::"), t))
        only = token & pascal & (F.length(v["text"]) < F.length(query)) & suffix(v["text"]) & ~id_.endswith(F.concat(F.lit("\\"), low)) & ~id_.contains(F.concat(F.lit("\\"), low, F.lit("::")))
        score = F.when(token, F.least(s["score"], F.lit(TOKEN_CAP))).otherwise(s["score"]) + v["bonus"] - F.when(only, SUFFIX_MALUS).otherwise(0)
        return F.struct(F.when(s["score"] > 0, score).otherwise(0).alias("score"), (-k).alias("first"), s["why"].alias("why"), v["source"].alias("source"), v["text"].alias("text"))

    # the step of a spelling is found once, though its score is read more often
    return F.array_max(F.flatten(F.transform(variants, lambda v, k: F.transform(F.array(step(v)), lambda s: total(v, k, s)))))


def _route_score(asked: Column, query: Column) -> Column:
    """(score, first, reason) of a node for a request: its exact id, then its path as asked for, without the API version, its end, its terms."""
    verb, paths = F.col("own_verb"), F.col("paths")
    public, framework = F.lower(asked["requested"]), F.lower(asked["framework"])
    want = asked["verb"]
    same = F.coalesce(verb == want, F.lit(False))
    bare = lambda p: F.regexp_replace(p, "^/", "")
    exact = F.coalesce((F.substring_index("id", ":", 2) == F.concat(F.lit("api:"), want)) & bare(F.regexp_extract("id", "^api:[^:]*:(.*)$", 1)).isin(bare(asked["requested"]), bare(asked["framework"])), F.lit(False))
    explicit = query.rlike("(?i)^(api|http):") & (F.col("id") == query)
    parts = F.filter(F.split(framework, "/"), lambda s: s != "")
    longer = F.exists(paths, lambda p: (F.size(F.split(p, "/")) > F.size(parts)) & (F.size(parts) > 0) & F.concat(F.lit("/"), p).endswith(F.concat(F.lit("/"), F.array_join(parts, "/"))))
    best = F.coalesce(F.array_max(F.transform("held", F.length)), F.lit(-1))
    steps = [
        (explicit, EXPLICIT, "explicit endpoint id"),
        (exact, EXACT, "exact route id"),
        (same & F.array_contains(paths, public), PUBLIC_VERB, "verb and public path"),
        (F.array_contains(paths, public), PUBLIC, "public path"),
        (same & F.array_contains(paths, framework), FRAMEWORK_VERB, "verb and framework path"),
        (F.array_contains(paths, framework), FRAMEWORK, "framework path"),
        (longer, SUFFIX, "end of the path"),
    ]
    score, why = F.when(best >= 0, best * 10 + TERM).otherwise(0), F.lit("path term")
    for test, value, reason in reversed(steps):
        score, why = F.when(test, value).otherwise(score), F.when(test, reason).otherwise(why)
    by_verb = F.when(explicit | want.isNull() | verb.isNull(), 0).when(same, SAME_VERB).otherwise(OTHER_VERB)
    by_file = F.when(production_routes(F.col("file")), PRODUCTION_FILE).otherwise(0) + F.when(low_signal(F.col("file")), TEST_FILE).otherwise(0)
    return F.struct(F.when(score > 0, score + by_verb + by_file).otherwise(0).alias("score"), F.lit(0).alias("first"), why.alias("reason"))


def _terms(asked: Column, query: Column) -> Column:
    """The segments of a request that say something; a bare word counts whole."""
    word = F.when(~query.contains("/") & (F.length(query) >= 3) & asked["verb"].isNull(), F.array(query)).otherwise(F.array().cast("array<string>"))
    return F.array_union(F.array_union(path_terms(asked["requested"]), path_terms(asked["framework"])), word)


def find_many(graph: CodeGraph, queries: DataFrame, limit: int = 20, index: DataFrame | None = None) -> DataFrame:
    """(query, place, id, type, file, score, reason): the best matches of each of `queries` (query, and kind if wanted: symbol, route, field, config or all)."""
    asked = queries if "kind" in queries.columns else queries.withColumn("kind", F.lit(None).cast("string"))
    asked = asked.select(F.trim("query").alias("query"), F.when(F.col("kind") != "auto", F.col("kind")).alias("kind")).where("query <> ''")
    asked = cut(asked.withColumn("kind", F.coalesce("kind", kind_of(F.col("query")))).distinct())
    paths = F.concat(F.array(normalize_route_path(F.col("r.requested")), normalize_route_path(F.col("r.framework")), F.col("query")), F.col("terms"))
    routes = asked.where("kind = 'route'").withColumn("r", request(F.col("query"))).withColumn("terms", _terms(F.col("r"), F.col("query"))).select("*", _looked(F.transform(paths, F.lower)))
    texts, routes = cut(_spelled(asked.where("kind <> 'route'"))), cut(routes)
    n_texts, n_routes = (df.agg(F.coalesce(F.sum(F.size("looked")), F.lit(0))).first()[0] for df in (texts, routes))
    nodes = _read(graph.nodes)
    if index is None and n_texts + n_routes <= SCAN:
        named, ends = scan(nodes, texts, ["low_id", "low_name", "low_file"]), scan(nodes, routes, ["low_id"])
    else:
        terms = reduce(DataFrame.unionByName, [df.select("query", F.explode("looked").alias("term"), F.lit(in_id).alias("in_id")) for df, in_id in ((texts, False), (routes, True))])
        near = cut(holders(gram_index(graph) if index is None else index, nodes, terms)).join(nodes, "id")
        named, ends = near.where("NOT in_id").join(texts, "query"), near.where("in_id").join(routes, "query")
    types = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    own = F.coalesce(F.array_contains(types[F.col("kind")], F.col("type")), F.lit(True)) | (F.col("id") == F.col("query"))
    # a generator scores once what a condition would score again
    some = lambda s: F.explode(F.filter(F.array(s), lambda x: x["score"] > 0)).alias("s")
    scored = named.select("query", "kind", "id", "type", "file", own.alias("own"), some(_symbol_score(F.col("variants"), F.col("query"))))
    reason = F.concat("s.why", F.lit(" via "), "s.source", F.lit(":"), "s.text")
    scored = scored.withColumn("s", F.struct("s.score", "s.first", reason.alias("reason")))
    if n_routes:
        # what a score reads more than once is made once
        reached = cut(ends.where(own).withColumn("paths", F.transform(candidate_paths(F.col("id"), F.col("file")), F.lower)).withColumn("own_verb", F.upper(F.nullif(F.regexp_extract("id", r"^(?:api|http):([^:]+):", 1), F.lit("")))).withColumn("held", F.filter("terms", lambda t: F.col("low_id").contains(F.lower(t)))))
        scored = scored.unionByName(reached.select("query", "kind", "id", "type", "file", F.lit(True).alias("own"), some(_route_score(F.col("r"), F.col("query")))))
    # what is not of the kinds asked for counts where nothing of them matches; no more than the limit's of either meet
    best = cut(top_per_group(scored, ["query", "kind", "own"], [F.desc("s.score"), "id"], limit))
    best = best.withColumn("any", F.max("own").over(Window.partitionBy("query", "kind"))).where(F.col("own") | ~F.col("any"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("query", "kind").orderBy(F.desc("s.score"), "id")))
    return placed.select("query", "place", "id", "type", "file", F.col("s.score").alias("score"), F.col("s.reason").alias("reason"))
