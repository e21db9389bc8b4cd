"""Routes of route files: nested groups, modifiers, imports, and what must count for nothing."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.text import normalize_route_path
from weftgraph.operators import route_files
from weftgraph.plans import routing  # noqa: F401  registers its queries

from tests.joins import most_rows
from tests.oracle import compared

HEAD = "<?php\nuse App\\Http\\PostController;\nuse App\\Guards\\Tenant as T;\nuse function strlen;\n"


def of(spark, text, mount=None):
    rows = route_files.routes(spark.createDataFrame([("routes/a.php", text, mount)], "file string, text string, mount string")).orderBy("at", "verb", "path").collect()
    return [(r.verb, r.path, f"{r.controller}::{r.action}", r.middleware) for r in rows]


def test_group_of_resource(spark):
    """Prefix and middleware of a group reach all rows of a resource inside it."""
    got = of(spark, HEAD + "Route::middleware(['auth:x', T::class])\n ->prefix('admin')\n ->group(function (): void {\n Route::resource('posts', PostController::class);\n });")
    assert len(got) == 8 and {m for *_, w in got for m in w} == {"auth:x", "App\\Guards\\Tenant"}
    assert ("GET", "admin/posts/{param}/edit", "App\\Http\\PostController::edit", ["auth:x", "App\\Guards\\Tenant"]) in got


def test_nested_groups_and_modifiers(spark):
    text = HEAD + """
    Route::group(['prefix' => 'a/', 'middleware' => 'one'], function () {
        // Route::get('/commented', PostController::class); {
        # {
        $s = "} Route::";
        Route::prefix('b')->middleware(['two', 'one'])->group(function () {
            Route::get('/x', [PostController::class, 'show'])->middleware(T::class)->name('x');
            Route::apiResource('users.posts', '\\\\Deep\\\\C')->only(['index']);
            Route::apiResource('users.posts', \\Deep\\C::class)->except(['index', 'show', 'store'])->middleware('m(1');
        });
        Route::put('y', Plain::class);
    });
    Route::get('/z', function () { return 1; });
    Route::delete('/{id}', [PostController::class, 'gone']);
    """
    post = "App\\Http\\PostController"
    assert of(spark, text) == [
        ("GET", "a/b/x".replace("a/b", "a//b").replace("//", "/"), f"{post}::show", ["one", "two", "App\\Guards\\Tenant"]),
        ("DELETE", "a/b/users/{param}/posts/{param}", "Deep\\C::destroy", ["one", "two", "m(1"]),
        ("PATCH", "a/b/users/{param}/posts/{param}", "Deep\\C::update", ["one", "two", "m(1"]),
        ("PUT", "a/b/users/{param}/posts/{param}", "Deep\\C::update", ["one", "two", "m(1"]),
        ("PUT", "a/y", "Plain::__invoke", ["one"]),
        ("DELETE", "/{id}", f"{post}::gone", []),
    ]
    assert of(spark, text, "/api/")[0][1] == "/api/a/b/x"


@pytest.mark.parametrize("text", [None, "", "Route::", "Route::get(", "Route::get('/x', A::class", "Route::group(function () { ", "'Route::get(\"/x\", A::class);", "}}}{{{ )))((( /*", "x" * 300_000])
def test_nothing_to_find(spark, text):
    assert of(spark, text) == []


def test_unclosed_group_and_repeated_rows(spark):
    """A block without an end gives its routes nothing; a repeated file counts once; extra columns don't matter."""
    rows = [("routes/a.php", "Route::prefix('p')->group(function () { Route::get('/x', A::class);", 1)] * 3 + [(None, "Route::get('/x', A::class);", 2)]
    got = route_files.routes(spark.createDataFrame(rows, "file string, text string, at int")).collect()
    assert [(r.path, r.action) for r in got] == [("/x", "__invoke")]
    assert route_files.routes(spark.createDataFrame([], "file string, text string")).count() == 0


def test_graph_of_routes(spark):
    """An endpoint of two files is that of the first; ids are normalised, names are not."""
    rows = [("b.php", "Route::get('/x/{id}', A::class)->middleware('m');"), ("a.php", "Route::get('x/{key}/', B::class);")]
    g = route_files.route_graph(route_files.routes(spark.createDataFrame(rows, "file string, text string")))
    assert sorted((r.id, r.type, r.name, r.file) for r in g.nodes.collect()) == [("api:GET:x/{param}", "api_endpoint", "GET /x/{key}/", "a.php"), ("middleware:m", "middleware", "m", "b.php")]
    assert sorted((r.from_id, r.to_id, r.via) for r in g.edges.collect()) == [("api:GET:x/{param}", "A::__invoke", "__invoke"), ("api:GET:x/{param}", "B::__invoke", "__invoke"), ("api:GET:x/{param}", "middleware:m", "m")]


def test_routes_are_not_joined(spark):
    """A file meets what its groups give once; its routes and their tokens do not."""
    text = HEAD + "Route::prefix('p')->group(function () {" + "".join(f"Route::get('/x{i}', A::class);" for i in range(200)) + "});Route::get('/y', [A::class, 'b'], function () { return f((((((1)))))); })->middleware('m');"
    found = route_files.routes(spark.createDataFrame([("a.php", text), ("b.php", text)], "file string, text string"))
    rows = found.collect()
    assert sorted(r.path for r in rows if r.file == "a.php") == sorted([f"p/x{i}" for i in range(200)] + ["/y"]) and len(rows) == 402
    assert most_rows(found) == 2


@pytest.mark.parametrize("name", ["p31_file_routes", "p35_route_graph"])
def test_sql(spark, sf_dir, name):
    got, want = compared(spark, sf_dir, name)
    assert got == want and got


def test_routes_are_read_in_one_pass(spark):
    """No pattern is tried on rows of statements once files have met their groups, and a path is normalised by one expression of each kind."""
    files = spark.createDataFrame([("a.php", HEAD + "Route::get('/x', A::class);")], "file string, text string")
    plan = route_files.routes(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.split("Join LeftOuter")[0] and "Join LeftOuter" in plan
    path = files.select(normalize_route_path(F.col("file")).alias("path"))._jdf.queryExecution().optimizedPlan().toString()
    assert path.count("regexp_replace") <= 3
