"""Imports and inherited types."""

import math
import random

from tests.joins import most_rows
from weftgraph.operators import budget, imports, properties


def test_imports(spark):
    files = ["src/a.ts", "src/b.vue", "src/dir/index.js", "src/dir.ts", "src/both.js", "src/both.ts", "lib/x.jsx", "a.js", "src/s.css"]
    aliases = [(None, "@", "./src"), (None, "@/deep", "lib"), ("src", "#", "lib/"), ("src/in", "#", "src"), ("", "lib", "lib")]
    cases = {
        ("src/in/m.ts", "../a"): ("src/a.ts", "found"), ("src/in/m.ts", "'../dir'"): ("src/dir.ts", "found"), ("src/in/m.ts", "../dir/"): ("src/dir.ts", "found"), ("m.ts", "./a"): ("a.js", "found"), ("m.ts", "../a"): ("../a.js", "missing"),
        ("src/in/m.ts", "@/both"): ("src/both.ts", "found"), ("src/in/m.ts", "@/b.vue"): ("src/b.vue", "found"), ("src/in/m.ts", "@/deep/x"): ("lib/x.jsx", "found"), ("src/in/m.ts", "@deep"): ("@deep.js", "package"),
        ("src/in/m.ts", "#/a"): ("src/a.ts", "found"), ("src/m.ts", "#/x"): ("lib/x.jsx", "found"), ("m.ts", "#/x"): ("#/x.js", "package"), ("m.ts", "lib/x"): ("lib/x.jsx", "found"), ("m.ts", "lodash"): ("lodash.js", "package"),
        ("src/m.ts", "./s.css"): ("src/s.css", "found"), ("src/m.ts", "./nope.vue"): ("src/nope.vue", "missing"), ("src/m.ts", "@/no/../a"): ("src/a.ts", "found"),
    }
    asked = spark.createDataFrame([*cases, *list(cases)[:2], (None, "x"), ("m.ts", None)], "file string, source string")
    got = {(r.file, r.source): (r.path, r.how) for r in imports.resolve_imports(asked, spark.createDataFrame([(f,) for f in files], "file string"), spark.createDataFrame(aliases, "directory string, alias string, target string")).collect()}
    assert got == {(f, s.strip("'")): v for (f, s), v in cases.items()}
    none = imports.resolve_imports(asked, spark.createDataFrame([], "file string"), spark.createDataFrame([], "directory string, alias string, target string")).collect()
    assert len(none) == len(cases) and {r.how for r in none} == {"missing", "package"}


def test_inherited_types(spark):
    """A chain of twelve, a loop, and a class with two parents, against rounds over plain dictionaries."""
    own = {(f"c{i}", "p"): f"T{i}" for i in (0, 3, 7)} | {("c5", "q"): "Q", ("l1", "p"): "L1", ("l2", "p"): "L2", ("x", "p"): "X", ("y", "p"): "Y", ("y", "q"): "YQ"}
    parents = [(f"c{i + 1}", f"c{i}", i) for i in range(12)] + [("l1", "l2", 0), ("l2", "l1", 0), ("z", "x", 5), ("z", "y", 2), ("c9", "y", 100), ("x", "x", 1)]
    for rounds in (1, 3, 8):
        now = dict(own)
        for _ in range(rounds):
            new = dict(now)
            for c, p, _ in sorted((e for e in parents if e[0] != e[1]), key=lambda e: (e[2], e[1])):
                new |= {(c, k): v for (o, k), v in now.items() if o == p}
            now = new
        got = properties.inherited_types(spark.createDataFrame([(*k, v) for k, v in own.items()], "class string, property string, type string"), spark.createDataFrame(parents, "class string, parent string, ord long"), rounds)
        assert {(r["class"], r.property): r.type for r in got.collect()} == now, rounds


def test_budgets_against_a_loop(spark):
    rng = random.Random(7)
    tasks = {t: [(["x" * rng.randrange(0, 400) for _ in range(rng.randrange(0, 7))], rng.randrange(0, 4), rng.random() < 0.6) for _ in range(rng.randrange(1, 5))] for t in range(60)}
    tokens = {t: rng.randrange(100, 600) for t in tasks if t % 7}
    want = {}
    for t, sections in tasks.items():
        own, trimmed = {k: list(lines) for k, (lines, _, _) in enumerate(sections) if lines}, False
        while t in tokens and own and math.ceil((sum(len(x) + 1 for s in own.values() for x in s) - 1) / 3.5) > max(200, tokens[t]):
            long = next((k for k in reversed(own) if len(own[k]) >= sections[k][1] + 2), None)
            gone = next((k for k in reversed(own) if sections[k][2]), None)
            if long is not None:
                own[long].pop()
            elif gone is not None:
                del own[gone]
            else:
                break
            trimmed = True
        for k, s in own.items():
            want |= {(t, k, i): trimmed for i in range(len(s))}
    rows = [(t, k, i, x, keep, may) for t, sections in tasks.items() for k, (lines, keep, may) in enumerate(sections) for i, x in enumerate(lines)]
    got = budget.trim(spark.createDataFrame(rows, "task int, section int, place int, line string, keep int, may_go boolean"), spark.createDataFrame(list(tokens.items()), "task int, tokens int"))
    assert {(r.task, r.section, r.place): r.trimmed for r in got.collect()} == want


def test_imports_meet_one_row_each(spark):
    asked = spark.range(4000).selectExpr("concat('src/a', id % 40, '.ts') AS file", "concat('./m', id) AS source")
    files = spark.range(4000).selectExpr("concat('src/m', id, '/index.ts') AS file")
    got = imports.resolve_imports(asked, files, spark.createDataFrame([], "directory string, alias string, target string"))
    assert "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert most_rows(got) <= 4000 and {r.how for r in got.collect()} == {"found"}
