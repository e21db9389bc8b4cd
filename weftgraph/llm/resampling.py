"""Importance resampling towards a target distribution, on hashed n-grams that suffix arrays over word ids enumerate.

Texts are cut into words (A-Z lower-cased; runs of digits, letters and all that is not ASCII). Features of a text are all runs of 1 to `most`
consecutive words, repeats included; a feature's bucket is the CRC-32 of its words, joined by one space, modulo `buckets`. The counts of
all documents and of all target texts give each bucket a gain: floor(1000 ln) of the ratio of its two shares, each smoothed by one. A
document weighs as much as its features' gains together. Gumbel noise from a keyed hash of the id is added, and the highest `percent` of 100 of
those documents that have `least` words are drawn: a sample without replacement in proportion to the weights.

Within a task, the words of some texts are numbered and put end to end with a 0 after each text. Suffixes are sorted by doubling as deep
as the longest feature; their common prefixes, cut at that length, show each n-gram as one run of the suffix array. It is hashed once for
each run, and its bucket goes back to all places of the run. Texts never travel: a task sends at most `buckets` counts in the first pass and
a slim row for each document in the second. Gains are the only thing broadcast, `buckets` whole numbers.

Ranks follow from a range partition by (score, id, row) and the number of rows in each part, so equal scores and ids are dealt too, and no task sees
all rows. A null text has no words, weighs 0 and is not drawn; a null id counts as the empty text in the noise and comes last among ties.
Repeated rows are judged one by one (each may be drawn). An empty target counts as zeros; no documents give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, parts_for, slices, written

#: Longest feature in words, number of buckets, words that a drawn document has at least, how many of 100 are drawn, key of the noise.
MOST, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes of text under one suffix array; a longer text stands alone.
ARRAY_BYTES = 1 << 20
#: Upper case to lower case, all else below 0x80 that is no digit or letter to a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def suffix_order(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first `most` numbers, common prefix of each with the one before, `most` at most and never across a 0)."""
    n, rank, depth = len(ids), ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while depth < most and n:
        key = rank * (rank.max() + 1) + np.append(rank[depth:], np.zeros(min(depth, n), np.int64))[:n]
        order = np.argsort(key, kind="stable")
        steps = key[order]
        rank[order] = np.append(0, np.cumsum(steps[1:] != steps[:-1])) + 1
        depth *= 2
    padded = np.append(ids, np.zeros(most, ids.dtype))
    common, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    for k in range(most if n else 0):
        here = padded[order + k]
        same &= (here[1:] == here[:-1]) & (here[1:] > 0)
        common[1:] += same
    return order, common


def feature_buckets(texts: list[bytes], most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of features from 1: (number of the text, bucket) of every feature of that length; first of all come single words, whose order is that of the texts."""
    split = [t.translate(_WORDS).split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    codes, names = pd.factorize(np.array([w for words in split for w in words], object))
    ends = np.cumsum(sizes + 1) - 1  # a 0 after each text
    ids = np.zeros(int(sizes.sum()) + len(texts), np.int64)
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    is_word = np.ones(len(ids), bool)
    is_word[ends] = False
    ids[is_word] = codes + 1
    room = ends[of] - np.arange(len(ids))  # words from here to the end of the text
    order, common = suffix_order(ids, most)
    for n in range(1, most + 1):
        fits = room[order] >= n
        places, new = order[fits], (common < n)[fits]  # suffixes with equal n-grams stand together, and those that don't fit aren't among them
        heads = places[new]
        words = [names[ids[heads + k] - 1].tolist() for k in range(n)]
        grams = words[0] if n == 1 else map(b" ".join, zip(*words, strict=True))
        hashed = np.fromiter(map(zlib.crc32, grams), np.int64, len(heads)) % buckets
        out = np.empty(len(ids), np.int64)
        out[places] = hashed[np.cumsum(new) - 1]
        where = room >= n
        yield of[where], out[where]


def counts(df: DataFrame, most: int = MOST, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for lo, hi in slices(np.array([len(t) for t in texts], np.int64), ARRAY_BYTES):
                for _, own in feature_buckets(texts[lo:hi], most, buckets):
                    total += np.bincount(own, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for row in rows.collect():  # a row for each bucket
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature in each bucket adds to a weight."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    ratio = [(float(b + 1) * float(s + n)) / (float(a + 1) * float(t + n)) for a, b in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, most: int = MOST, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of each document."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gain), len(gain)  # a number for each bucket
    ids = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in slices(np.array([len(t) for t in texts], np.int64), ARRAY_BYTES):
                words, features, weight = (np.zeros(hi - lo, np.int64) for _ in range(3))
                for n, (of, own) in enumerate(feature_buckets(texts[lo:hi], most, buckets)):
                    number = np.bincount(of, minlength=hi - lo)
                    words = number if n == 0 else words
                    features += number
                    sums = np.append(0, np.cumsum(shared.value[own]))  # places are in the order of texts
                    ends = np.cumsum(number)
                    weight += sums[ends] - sums[ends - number]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(words), pa.array(features), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, f"id {ids}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: int = SEED) -> Column:
    """floor(1000 Gumbel) from the id."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("", F.lit(f"{seed}:"), id_.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, count: int) -> DataFrame:
    """`rows` (id, score, row and more; `count` of them) with rank from 1: highest score first, then smallest id, then `row`."""
    first = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    dealt = rows.repartitionByRange(parts_for(rows.sparkSession, count), *first).sortWithinPartitions(*first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at + 1, at + n + 1))], names=[*batch.schema.names, "part", "at"])
            at += n

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    numbered = written(dealt.mapInArrow(run, f"{fields}, part int, at long"))
    # a row for each part, of which there is one for some two million rows
    sizes = sorted((r.part, r["count"]) for r in numbered.groupBy("part").count().collect())
    before, starts = 0, []
    for part, size in sizes:
        starts.append((part, before))
        before += size
    starts = rows.sparkSession.createDataFrame(starts, "part int, before long")
    return numbered.join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, most: int = MOST, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """id, n_words, n_features, weight, score and rank (null: not drawn) of every document."""
    gain = gains(counts(docs, most, buckets), counts(target, most, buckets))
    scored = weights(docs, gain, most, id_col).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = written(scored.withColumn("row", F.monotonically_increasing_id()))
    able = scored.where(F.col("n_words") >= least)
    count = able.count()
    drawn = ranked(able, count).withColumn("rank", F.when(F.col("rank") <= percent * count // 100, F.col("rank")))
    return drawn.unionByName(scored.where(F.col("n_words") < least), allowMissingColumns=True).drop("row")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, drawn towards the benchmark's texts."""
    return resample(docs, benchmark).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
