"""Search over the n-gram index: routes, symbols, kinds, and every candidate against a scan."""

import random

import pytest

from pyspark.sql import functions as F

from tests.joins import most_rows
from weftgraph.functions.text import divergent_terms, jaccard
from weftgraph.model import CodeGraph
from weftgraph.operators import analyzers, grams, search

ROUTES = {
    "api:GET:config/settings": "apps/front/routes/api.v3.php", "api:GET:contents/{param}/multiview": "apps/front/routes/api.v3.php", "api:GET:contents/{param}/multiview/metadata": "apps/front/routes/api.v3.php",
    "api:POST:users/{param}/settings": "routes/api.php", "api:DELETE:events/{param}": "routes/web.php", "api:DELETE:events/{param}/archive": "routes/web.php", "api:APIRESOURCE:/contents": "routes/api.php",
    "api:GET:internal/api/v1/reports": "routes/api.php", "api:POST:{param}/api/v3/contents/{param}/check-access": "k6/helpers.js", "api:GET:contents/helpers": "apps/front/helpers.js",
    "api:GET:/contents/{param}": "apps/api/routes/api.v3.php", "api:GET:/baseConfigEventContents/{param}": "apps/admin/routes/api.php", "http:GET:/api/v3/contents/{param}": "packages/sdk/useContent.ts",
}


@pytest.fixture(scope="module")
def routes(spark):
    rows = [(i, "http_endpoint" if i.startswith("http") else "api_endpoint", None, f) for i, f in ROUTES.items()]
    return CodeGraph.of(spark.createDataFrame(rows, "id string, type string, name string, file string"), spark.createDataFrame([], "from_id string, to_id string, type string"))


def asked(spark, graph, queries, kind=None, limit=20):
    df = spark.createDataFrame([(q, kind) for q in queries], "query string, kind string")
    out = {}
    for r in grams.find_many(graph, df, limit).orderBy("query", "place").collect():
        out.setdefault(r.query, []).append(r)
    return out


def test_routes(spark, routes):
    want = {
        "GET /api/v3/config/settings": "api:GET:config/settings", "api:GET:/api/v3/config/settings": "api:GET:config/settings", "GET /api/v3/contents/{contentId}": "api:GET:/contents/{param}",
        "http:GET:/api/v3/contents/{param}": "http:GET:/api/v3/contents/{param}", "GET /api/v3/contents/{contentId}/multiview": "api:GET:contents/{param}/multiview",
        "POST /api/v2/users/{userId}/settings": "api:POST:users/{param}/settings", "DELETE /api/v1/events/{eventId}": "api:DELETE:events/{param}", "api:DELETE:events/{param}": "api:DELETE:events/{param}",
        "GET /internal/api/v1/reports": "api:GET:internal/api/v1/reports", "GET contents/helpers": "api:GET:contents/helpers",
    }
    got = asked(spark, routes, [*want, "GET /api/v1/contents"], "route")
    assert {q: got[q][0].id for q in want} == want
    content = [r.id for r in got["GET /api/v3/contents/{contentId}"]]
    assert "api:GET:/baseConfigEventContents/{param}" not in content or content.index("api:GET:/baseConfigEventContents/{param}") > 0
    multi = got["GET /api/v3/contents/{contentId}/multiview"]
    assert multi[0].score > multi[1].score
    plain = [(r.id, r.file) for r in got["GET /api/v1/contents"]]
    assert ("api:APIRESOURCE:/contents", "routes/api.php") in plain and all(f != "k6/helpers.js" for _, f in plain)


def symbols(spark):
    c = r"Front\Http\Controllers\Api\V"
    rows = [
        (r"App\Http\Controllers\Controller", "class", "Controller", "app/Http/Controllers/Controller.php"), (rf"{c}2\Content\RelatedContentController", "class", "RelatedContentController", "a/V2/RelatedContentController.php"),
        (rf"{c}3\Content\RelatedContentController", "class", "RelatedContentController", "a/V3/RelatedContentController.php"), (rf"{c}3\Multiview\MultiviewController", "class", "MultiviewController", "a/V3/MultiviewController.php"),
        (rf"{c}3\Content\RelatedContentController::index", "method", "index", "a/V3/RelatedContentController.php"), ("js:composition/module/useModule.ts", "js_module", "composition/module/useModule.ts", "composition/module/useModule.ts"),
        ("js:services/useModule.js", "js_module", "services/useModule.js", "services/useModule.js"), ("js:types/moduleTemplates.ts", "js_module", "types/moduleTemplates.ts", "types/moduleTemplates.ts"),
    ]
    rows += [(f"model_field:Noise{i}:module", "model_field", "module", "app/Noise.php") for i in range(350)]
    return CodeGraph.of(spark.createDataFrame(rows, "id string, type string, name string, file string"), spark.createDataFrame([], "from_id string, to_id string, type string"))


def test_symbols(spark):
    g = symbols(spark)
    got = asked(spark, g, ["RelatedContentController", "MultiviewController", "RelatedContentController::index", "Noise77"], limit=5)
    assert got["RelatedContentController"][0].id.endswith(r"V2\Content\RelatedContentController") and got["MultiviewController"][0].id.endswith("MultiviewController")
    assert got["RelatedContentController::index"][0].id.endswith("::index")
    assert [r.type for r in got["Noise77"]] == ["model_field"]  # no symbol: all kinds
    wide = asked(spark, g, ["useModule", "moduleTemplates", "module templates", "nowhere"], "all", 5)
    assert all(r.id.endswith(("useModule.ts", "useModule.js")) and "exact file stem" in r.reason for r in wide["useModule"][:2])
    assert wide["moduleTemplates"][0].file == wide["module templates"][0].file == "types/moduleTemplates.ts" and "nowhere" not in wide


def test_candidates_against_a_scan(spark):
    """All matches of random queries, scored as one query at a time over all nodes."""
    rng = random.Random(4)
    syllables = ["ab", "Order", "_x", "item", "Ü", "9", "load", "Data", "::", "\\", "a"]
    rows = [("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 7))) + str(i), rng.choice(["class", "js_module", "x"]), rng.choice([None, "Item", "loadData"]), rng.choice([None, "a/load_data.ts", "Order/item.php"])) for i in range(150)]
    g = CodeGraph.of(spark.createDataFrame(rows, "id string, type string, name string, file string"), spark.createDataFrame([], "from_id string, to_id string, type string"))
    queries = ["order item", "loadData", "a", "Ü", "9", "x\\ab", "load_data.ts", "zzz", "OrderItem", "item.php", "ab::Data"]
    got = {q: {(r.id, r.score) for r in rs} for q, rs in asked(spark, g, queries, "all", 10**6).items()}
    want = {q: s for q in queries if (s := {(r.id, r.score) for r in search.find(g, q, None).collect()})}
    assert got == want


def test_few_terms_take_one_pass_and_equal_the_index(spark, monkeypatch):
    g = symbols(spark)
    rows = [("RelatedContentController", "symbol"), ("useModule", "all"), ("nowhere", "symbol"), ("Noise77", "symbol"), ("module", "symbol"), ("module", "route"), ("GET /module/{id}", "route")]
    df = spark.createDataFrame(rows, "query string, kind string")
    key = lambda found: sorted(map(repr, found.collect()))
    want = key(grams.find_many(g, df, 10, grams.gram_index(g)))
    monkeypatch.setattr(grams, "gram_index", None)
    assert key(grams.find_many(g, df, 10)) == want and len(want) > 15


def test_similar_files_equal_all_pairs_and_meet_by_shape(spark):
    r = random.Random(4)
    kinds, words = ["class", "method", "interface"], ["Order", "Item", "Cart", "Price", "User"]
    nodes = [(f"n{i}", r.choice(kinds), "".join(r.sample(words, 2)), "/".join(["app", r.choice(["Domain", "domain", "http"]), *r.sample(["cart", "user"], r.randrange(3)), r.choice(words) + str(i % 7) + r.choice([".php", ".ts"])])) for i in range(90)]
    nodes += [(f"m{i}", "method", "fulfil", f"app/services/order{i}.php") for i in range(300)]
    edges = [(f"n{r.randrange(90)}", f"n{r.randrange(90)}", "CALLS") for _ in range(40)] + [("n1", f"m{i}", "CALLS") for i in range(3)]
    g = CodeGraph.of(spark.createDataFrame(nodes, "id string, type string, name string, file string"), spark.createDataFrame(edges, "from_id string, to_id string, type string"))
    seeds = spark.createDataFrame([(nodes[i][3],) for i in range(12)], "file string").distinct()
    p, file_of = analyzers.file_profiles(g), {n[0]: n[3] for n in nodes}
    pairs = {(file_of[a], file_of[b]) for a, b, _ in edges} | {(file_of[b], file_of[a]) for a, b, _ in edges}
    linked = spark.createDataFrame(list(pairs), "seed string, file string").withColumn("linked", F.lit(True))
    s = p.join(seeds, "file").select(*[F.col(c).alias("seed" if c == "file" else f"s_{c}") for c in p.columns])
    a, b = divergent_terms(F.col("seed"), F.col("file"))
    ext = lambda c: F.regexp_extract(c, r"(\.[^./]*)$", 1)
    score = jaccard(F.col("s_types"), F.col("types")) * 10 + jaccard(a, b) * 35 + jaccard(F.col("s_terms"), F.col("terms")) * 25 + F.when((F.col("role") == F.col("s_role")) & (F.col("role") != "other"), 8).otherwise(0) + 6 + F.when(ext("seed") == ext("file"), 2).otherwise(0) + F.when(F.col("linked"), 20).otherwise(0)
    want = s.crossJoin(p).where("seed <> file").join(linked, ["seed", "file"], "left").select("seed", "file", score.alias("score")).where("score >= 30").collect()
    found = analyzers.similar_files(g, seeds, 1000)
    key = lambda rows: sorted((x.seed, x.file, round(x.score, 9)) for x in rows)
    assert key(found.collect()) == key(want) and len(want) > 20
    assert most_rows(found) < 12 * 300
