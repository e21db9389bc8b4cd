"""Spark queries against their DuckDB SQL."""

import duckdb

from weftgraph.plans import registry
from weftgraph.plans.fixtures import TABLES


def compared(spark, sf_dir, name):
    """Rows of a registered query and of its SQL, sorted alike."""
    got = registry.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    cols = sorted(c[0] for c in want.description)
    assert sorted(got.columns) == cols
    names = [c[0] for c in want.description]
    rows = [tuple(dict(zip(names, r, strict=True))[c] for c in cols) for r in want.fetchall()]
    return sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))), sorted(map(repr, rows))
