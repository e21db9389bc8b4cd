"""Approximate nearest neighbours: balanced posting lists, boundary replication, a graph over centroids, distance-ratio pruning.

A bounded sample of distinct vectors is cut into balanced clusters by repeated halving; their means are the centroids of posting
lists, and a navigable graph joins each centroid to its nearest ones and to some far ones. Every vector looks up its centroids
by best-first search in that graph and goes to the nearest list, and also to others almost as near (boundary vectors are thus
found from either side). A query searches the lists whose centroids are at most `PROBE_RATIO` times as far as the nearest, at most
`PROBES` of them, and compares with every vector in them, in double precision.

The number of lists grows with the vectors, so that a query's work doesn't, up to a quarter of the sample, which `SAMPLE_BYTES`
bounds (with 64 components a list for each 256 vectors up to some 30 million of them; beyond that lists get longer, and a query's
work with them). The centroids and their graph are the only thing broadcast: a quarter of SAMPLE_BYTES and DEGREE + FAR
numbers for each. Lists are split into blocks of about `BLOCK` vectors by hash, and the queries of a list into blocks of
`QUERIES`, so a list that many equal vectors or very many queries fall into is shared out among tasks; each block of
queries visits all blocks of vectors. Equal queries are searched once. A query whose lists hold too few vectors is compared with all
vectors, in the same blocks, so none gets fewer results than there are (but where other vectors have the query's own id: each takes a place).

Vectors that are null, zero, hold null or non-finite components, or have another length than most, take no part; neither do null ids. Repeated rows count once; other rows with the same
id are separate candidates for others, but no row is a candidate for its own id. Ties go to the smaller id. With no
valid vector or no query the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import checkpointed, written

#: Bytes of distinct vectors that clustering sees at most; vectors for each list; sampled vectors for each list at least.
SAMPLE_BYTES, LIST, SAMPLED = 128 << 20, 256, 4
#: A vector also goes to lists at most this many times as far as its nearest, COPIES in all at most.
CLOSURE, COPIES = 1.12, 4
#: A query searches lists at most this many times as far as the nearest, PROBES at most.
PROBE_RATIO, PROBES = 1.6, 48
#: Neighbours of a centroid in the graph, far links, and the width of the search.
DEGREE, FAR, WIDTH = 24, 8, 64
BLOCK, QUERIES, QUERY_EVERY, K = 2048, 4096, 100, 10


@dataclass
class Graph:
    """Centroids, and for each the numbers of those that it is joined to."""

    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray

    def nearest(self, v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, squared distances) of about `width` nearest centroids for each row of v, nearest first; best-first search for many rows at once."""
        n, width = len(v), min(width, len(self.centroids))
        rows = np.arange(n)
        ids = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        ids, dist, fresh = self._best(ids, self._far(v, ids), np.ones(ids.shape, bool), width)
        for _ in range(2 * width):
            pick = np.where(fresh, dist, np.inf).argmin(1)
            open_ = fresh[rows, pick]
            if not open_.any():
                break
            fresh[rows, pick] = False
            new = self.links[ids[rows, pick]]
            # what is in the row's list already, or stands twice, counts once; what has fallen out of it does not come back, as lists only get better
            known = (new[:, :, None] == ids[:, None, :]).any(2) | ~open_[:, None]
            for k in range(1, new.shape[1]):
                known[:, k] |= (new[:, k : k + 1] == new[:, :k]).any(1)
            d = np.where(known, np.inf, self._far(v, new))
            ids, dist, fresh = self._best(np.hstack([ids, new]), np.hstack([dist, d]), np.hstack([fresh, ~known]), width)
        return ids, dist

    def _far(self, v: np.ndarray, ids: np.ndarray) -> np.ndarray:
        c = self.centroids[ids]
        return np.einsum("nkd,nkd->nk", c, c) - 2 * np.einsum("nkd,nd->nk", c, v) + np.einsum("nd,nd->n", v, v)[:, None]

    @staticmethod
    def _best(ids: np.ndarray, dist: np.ndarray, fresh: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        take = lambda x: np.take_along_axis(x, order, 1)
        return take(ids), take(dist), take(fresh) & np.isfinite(take(dist))


def balanced(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids of clusters of about equal size: each is halved along the line between two means."""
    rng = np.random.default_rng(3)
    todo, done = [np.arange(len(sample))], []
    size = max(1, -(-len(sample) // max(1, lists)))
    while todo:
        own = todo.pop()
        if len(own) <= size:
            done.append(sample[own].mean(0, dtype=np.float64))
            continue
        x = sample[own].astype(np.float64)
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(6):
            side = ((x - a) ** 2).sum(1) - ((x - b) ** 2).sum(1)
            left = side <= np.median(side)
            if left.all() or not left.any():
                break
            a, b = x[left].mean(0), x[~left].mean(0)
        order = np.argsort(((x - a) ** 2).sum(1) - ((x - b) ** 2).sum(1), kind="stable")
        half = len(own) // 2
        todo += [own[order[:half]], own[order[half:]]]
    return np.array(done)


def graph_of(centroids: np.ndarray) -> Graph:
    """Join each centroid to its nearest ones and to some random ones."""
    rng, k = np.random.default_rng(4), len(centroids)
    centroids = centroids.astype(np.float64)
    near = np.empty((k, min(DEGREE, k)), np.int64)
    norms = (centroids**2).sum(1)
    for lo in range(0, k, 256):
        d = norms[None, :] - 2 * centroids[lo : lo + 256] @ centroids.T
        near[lo : lo + 256] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    links = np.hstack([near, rng.integers(0, k, (k, FAR))])
    return Graph(centroids, links, rng.permutation(k)[: min(k, 16)])


def valid(v: Column, size: int) -> Column:
    """Whether a vector takes part."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & good & F.exists(v, lambda x: x != 0), F.lit(False))


def fit(rows: DataFrame, count: int, size: int) -> Graph:
    """Centroids and graph from a bounded sample of distinct vectors: those with the smallest hashes."""
    lists = max(1, round(count / LIST))
    most = min(16 * lists + 1000, max(1, SAMPLE_BYTES // (4 * size)))
    # single precision is enough to learn from, and halves what the driver holds
    batches = rows.select(F.xxhash64("v").alias("h"), F.col("v").cast("array<float>").alias("v")).orderBy("h").limit(most).select("v").toArrow()
    vectors = np.nan_to_num(np.unique(batches["v"].combine_chunks().flatten().to_numpy().reshape(-1, size), axis=0))
    return graph_of(balanced(vectors, min(lists, max(1, len(vectors) // SAMPLED))))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)


def _lists(rows: DataFrame, graph: Graph, ratio: float, most: int) -> DataFrame:
    """(id, v, list): each row with the lists that are at most `ratio` times as far as the nearest."""
    shared = rows.sparkSession.sparkContext.broadcast(graph)  # centroids of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, dist = shared.value.nearest(_matrix(part.column(1)), max(WIDTH, most))
                dist = np.sqrt(np.maximum(dist, 0))
                take = dist <= ratio * dist[:, :1] + 1e-12
                take[:, most:] = False
                row, col = np.nonzero(take)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(ids[row, col].astype(np.int32))], names=["id", "v", "list"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, list int")


def _compare(vectors: pd.DataFrame, queries: pd.DataFrame, most: int) -> pd.DataFrame:
    """The `most` nearest vectors of a block for each query."""
    out = []
    if len(vectors) and len(queries):
        ids, v = vectors["id"].to_numpy(), np.stack(vectors["v"].to_numpy())
        if len(np.unique(ids)) < len(ids):  # repeated rows, which are always in one block, count once
            _, first = np.unique(np.column_stack([ids.view(np.float64), v + 0.0]).view(f"V{8 * (v.shape[1] + 1)}"), return_index=True)
            ids, v = ids[first], v[first]
        for q, w in zip(queries["id"], queries["v"], strict=True):
            d = np.sqrt(((v - w) ** 2).sum(1))
            # every row at least as near as the last one wanted, then ties by id
            near = np.flatnonzero(d <= np.partition(d, min(len(d), most) - 1)[min(len(d), most) - 1])
            near = near[np.lexsort((ids[near], d[near]))][:most]
            out.append(pd.DataFrame({"query": q, "id": ids[near], "score": d[near]}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "score": []})


def _nearest(filed: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(query, id, score): for each of `asked` the `most` nearest vectors of its lists. Lists are dealt in blocks of vectors and of queries."""
    # a row for each list, of which there are no more than centroids
    sizes = filed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("turns")), "list")
    sizes = checkpointed(sizes)
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    placed = filed.join(F.broadcast(sizes), "list").select("id", "v", "list", dealt("blocks").alias("block"), every_of("turns").alias("turn"))
    asked = asked.join(F.broadcast(sizes), "list").select("id", "v", "list", dealt("turns").alias("turn"), every_of("blocks").alias("block"))
    keys = ["list", "block", "turn"]
    found = placed.groupBy(keys).cogroup(asked.groupBy(keys)).applyInPandas(lambda a, b: _compare(a, b, most), "query long, id long, score double")
    near = Window.partitionBy("query").orderBy("score", "id")
    return found.distinct().withColumn("n", F.row_number().over(near)).where(F.col("n") <= most).drop("n")


def search(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    all_rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL")
    size = all_rows.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return table.sparkSession.createDataFrame([], empty)
    rows = all_rows.where(valid(F.col("v"), size["n"]))
    count = rows.count()
    if not count:
        return table.sparkSession.createDataFrame([], empty)
    graph = fit(rows, count, size["n"])
    queries = rows.where(F.col("id") % every == 0)
    # equal queries are one: found once, for the smallest of their ids
    distinct = checkpointed(queries.groupBy("v").agg(F.min("id").alias("id")))
    filed = written(_lists(rows, graph, CLOSURE, COPIES))
    asked = written(_lists(distinct, graph, PROBE_RATIO, PROBES))
    best = written(_nearest(filed, asked, k + 1))  # one more, as the query itself may be among them
    # where the lists that a query searches hold too few vectors, all of them are compared, in blocks
    short = best.groupBy(F.col("query").alias("id")).count().where(F.col("count") >= min(k + 1, count))
    short = checkpointed(distinct.join(short, "id", "left_anti"))
    if not short.isEmpty():
        whole = _nearest(rows.select("id", "v", F.lit(0).alias("list")), short.select("id", "v", F.lit(0).alias("list")), k + 1)
        best = best.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(whole)
    own = queries.alias("q").join(distinct.select(F.col("v").alias("w"), F.col("id").alias("query")), F.col("v") == F.col("w")).select(F.col("q.id").alias("query_id"), "query").distinct()
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = own.join(best.select("query", F.col("id").alias("vec_id"), "score"), "query").where("vec_id <> query_id")
    return pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
