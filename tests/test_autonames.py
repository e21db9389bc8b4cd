"""Names of components, what claims a file, who wins, and what tags mean."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import autonames
from weftgraph.plans import autonames as _queries  # noqa: F401  registers its queries

from tests.oracle import compared

DIRS = "root string, place int, path string, prefix string, path_prefix boolean, priority int"


def registry(spark, files, dirs):
    rows = autonames.registry(spark.createDataFrame([(f,) for f in files], "file string"), spark.createDataFrame(dirs, DIRS)).collect()
    return {(r.root, r.name, r.mode): (r.file, r.duplicate) for r in rows}


def test_names(spark):
    """Words of directories that the file's own name repeats are said once."""
    cases = {
        "c/base/foo/Button.vue": "BaseFooButton", "c/base/foo/BaseFooButton.vue": "BaseFooButton", "c/base/foo/FooButton.vue": "BaseFooButton", "c/icon/Icon.vue": "Icon", "c/icon/iconBox.vue": "IconBox",
        "c/user-card/index.vue": "UserCard", "c/HTMLView.client.vue": "HTMLView", "c/x/y_z.global.vue": "XYZ", "c/some/some/Index.vue": "SomeSome", "c/a.island.vue": "A", "c/index.vue": "",
    }
    rows = spark.createDataFrame([(f, "c/", None, True, False) for f in cases], "file string, path string, prefix string, path_prefix boolean, island boolean")
    got = {r.file: (r.name, r.mode) for r in autonames.component_names(rows).collect()}
    assert {f: got[f][0] for f in got} == {f: n for f, n in cases.items() if n}
    assert got["c/HTMLView.client.vue"][1] == "client" and got["c/a.island.vue"][1] == "server"
    words = spark.createDataFrame([("fooBarBAZQux",), ("foo--x.y",), ("a1Bc",), ("",)], "w string").select(F.col("w"), autonames.split_by_case(F.col("w")).alias("p"))
    assert {r.w: r.p for r in words.collect()} == {"fooBarBAZQux": ["foo", "Bar", "BAZ", "Qux"], "foo--x.y": ["foo", "", "x", "y"], "a1Bc": ["a1", "Bc"], "": []}


def test_registry(spark):
    files = ["c/in/A.vue", "c/B.vue", "c/b.vue", "c/M.client.vue", "c/M.server.vue", "c/M.vue", "c/N.client.vue", "c/n.vue", "d/B.vue", "d/In/A.vue", "c/T.spec.ts", "c/-x.vue", "c/s.css", "c/in/x.txt", "out/Z.vue", None, "c/B.vue"]
    dirs = [("r", 1, "c/in", None, True, 2), ("r", 2, "/c/", None, True, 2), ("r", 3, "d", None, True, 3), ("q", 1, "d/", "Big", False, 1), ("r", 9, "c", "Never", True, 9)]
    got = registry(spark, files, dirs)
    assert got[("r", "A", "all")] == ("c/in/A.vue", False)  # the inner directory claims it
    assert got[("r", "B", "all")] == ("d/B.vue", True)  # two files of one directory, then a directory of higher priority
    assert got[("r", "M", "client")] == ("c/M.client.vue", False) and got[("r", "M", "server")][0] == "c/M.server.vue" and got[("r", "M", "all")][0] == "c/M.vue"
    assert got[("r", "N", "client")][0] == "c/N.client.vue" and got[("r", "N", "all")][0] == "c/n.vue"
    assert got[("q", "BigB", "all")] == ("d/B.vue", False) and got[("q", "BigA", "all")] == ("d/In/A.vue", False)
    assert got[("r", "InA", "all")] == ("d/In/A.vue", False) and len(got) == 10
    assert registry(spark, [], dirs) == {} and registry(spark, files, []) == {}


def test_tags(spark):
    found = spark.createDataFrame([("r", "A", "all", "c/A.vue", 1, False), ("q", "A", "all", "d/A.vue", 1, False), ("r", "Two", "client", "c/T.client.vue", 1, False), ("r", "Two", "server", "c/T.server.vue", 1, False), ("r", "Dup", "all", "c/D.vue", 1, True), ("r", "LazyDog", "all", "c/Dog.vue", 1, False)], "root string, name string, mode string, file string, priority int, duplicate boolean")
    layers = spark.createDataFrame([("r", "c"), ("q", "d/"), ("r", "both"), ("q", "both"), ("q", "both/inner")], "root string, layer string")
    asked = [("c/p.vue", t) for t in ("A", "LazyA", "LazyIfA", "Two", "Dup", "LazyDog", "Nope")] + [("both/p.vue", "A"), ("both/inner/p.vue", "A"), ("x/p.vue", "A"), ("c/p.vue", None), ("c/p.vue", "A")]
    rows = autonames.resolve_tags(spark.createDataFrame(asked, "file string, tag string"), layers, found)
    got = {(r.file, r.tag): (r.kind, r.target, r.files, r.roots) for r in rows.collect()}
    assert got[("c/p.vue", "A")] == got[("c/p.vue", "LazyA")] == got[("c/p.vue", "LazyIfA")] == ("resolved", "c/A.vue", ["c/A.vue"], ["r"])
    assert got[("c/p.vue", "Two")][0] == "ambiguous" and len(got[("c/p.vue", "Two")][2]) == 2 and got[("c/p.vue", "Dup")] == ("ambiguous", None, [], ["r"])
    assert got[("c/p.vue", "LazyDog")][1] == "c/Dog.vue" and got[("c/p.vue", "Nope")] == got[("x/p.vue", "A")] == ("unresolved", None, [], [])
    assert got[("both/p.vue", "A")] == ("ambiguous", None, ["c/A.vue", "d/A.vue"], ["q", "r"]) and got[("both/inner/p.vue", "A")][1] == "d/A.vue"
    assert len(got) == 10 and autonames.rendered_edges(rows).count() == 5


@pytest.mark.parametrize("name", ["n6_component_registry", "n7_component_tags"])
def test_sql(spark, sf_dir, name):
    got, want = compared(spark, sf_dir, name)
    assert got == want and got
