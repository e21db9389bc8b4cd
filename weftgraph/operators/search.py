"""Search for nodes by text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.model import CodeGraph

# What each spelling of a query adds to a score, how much a single word may score, and node types that stand for their file.
BONUS = {"raw": 30, "pascal": 25, "camel": 20, "kebab": 15, "snake": 10, "spaced": 5, "token": 0}
TOKEN_CAP, SUFFIX_MALUS, MOST = 650, 250, 12
FILE_TYPES = ("js_module", "vue_component", "blade_view")


def split_camel(value: str) -> list[str]:
    """Words of a name in mixed case."""
    return re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", value)).split()


def split_parts(value: str) -> list[str]:
    """Words between delimiters."""
    return [w for w in re.split(r"[\s/:.\\_-]+", value) if len(w) >= 2]


def query_variants(query: str) -> list[tuple[str, str]]:
    """(text, source) of the query, its usual spellings and its words, each once whatever its case, twelve at most."""
    query = query.strip()
    parts = split_parts(query)
    mixed = split_camel(query) if re.search("[a-z][A-Z]|[A-Z][a-z]", query) else []
    words = parts if len(parts) >= 2 else mixed
    low = [w.lower() for w in words]
    forms = [(query, "raw")]
    if len(words) >= 2:
        pascal = "".join(w.capitalize() for w in low)
        forms += [(pascal, "pascal"), (pascal[:1].lower() + pascal[1:], "camel"), ("-".join(low), "kebab"), ("_".join(low), "snake"), (" ".join(low), "spaced")]
        forms += [(w, "token") for w in words]
    else:
        forms += [(w, "token") for w in parts or words]
    seen: dict[str, tuple[str, str]] = {}
    for text, source in forms:
        if text:
            seen.setdefault(text.lower(), (text, source))
    return list(seen.values())[:MOST]


def _ladder(text: str) -> tuple[Column, Column]:
    """How well a node fits one spelling, and why."""
    v = text.lower()
    id_, name, file = F.lower("id"), F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("file", F.lit("")))
    path, own = F.translate(file, "\\", "/"), F.col("type").isin(*FILE_TYPES)
    base = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(base, r"\.(php|vue|tsx?|jsx?|mjs|cjs)$", "")
    want = v.replace("\\", "/")
    words = [w for w in split_parts(v)]
    hits = sum((F.when(id_.contains(w) | name.contains(w) | file.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    steps = [
        (F.col("id") == text, 1500, "exact id"),
        (id_.endswith("\\" + v) | (id_ == v), 1450, "exact qualified symbol"),
        (id_.endswith("::" + v), 1425, "exact symbol suffix"),
        (name == v, 1400, "exact name"),
        (own & (path == want), 1380, "exact file path"),
        (own & F.lit("/" in want) & path.endswith("/" + want), 1360, "exact file path suffix"),
        (own & (base == v), 1340, "exact file name"),
        (own & (stem == v), 1320, "exact file stem"),
        (id_.contains(v), 900, "id contains query"),
        (name.contains(v), 850, "name contains query"),
        (file.contains(v), 800, "file path contains query"),
    ]
    score, why = F.when(hits > 0, hits * 50 + 250).otherwise(0), F.when(hits > 0, "words matched").otherwise("weak match")
    for test, value, reason in reversed(steps):
        score, why = F.when(test, value).otherwise(score), F.when(test, reason).otherwise(why)
    return score, why


def find(graph: CodeGraph, query: str, limit: int | None = 20) -> DataFrame:
    """(id, type, file, score, reason): the best matches of any spelling, all of them in no order without a limit.

    Of equal ones the first spelling names the reason. All nodes are scored where they are read.
    """
    found = []
    pascal = re.fullmatch(r"[A-Z][A-Za-z0-9]*[a-z][A-Za-z0-9]*", query.strip()) is not None
    for k, (text, source) in enumerate(query_variants(query)):
        score, why = _ladder(text)
        if source == "token":
            score = F.least(score, F.lit(TOKEN_CAP))
        total = score + BONUS[source]
        if source == "token" and pascal and len(text) < len(query):
            only = (F.col("id").endswith("\\" + text) | F.col("id").endswith("::" + text)) & ~F.lower("id").endswith("\\" + query.lower()) & ~F.lower("id").contains("\\" + query.lower() + "::")
            total = total - F.when(only, SUFFIX_MALUS).otherwise(0)
        found.append(F.struct(F.when(score > 0, total).otherwise(0).alias("score"), F.lit(-k).alias("first"), F.concat(why, F.lit(f" via {source}:{text}")).alias("reason")))
    best = F.greatest(*found) if len(found) > 1 else found[0]
    rows = graph.nodes.select("id", "type", "file", best.alias("b")).where("b.score > 0").select("id", "type", "file", F.col("b.score").alias("score"), F.col("b.reason").alias("reason"))
    return rows if limit is None else rows.orderBy(F.desc("score"), "id").limit(limit)
