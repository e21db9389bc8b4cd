"""SimHash near-duplicates: fingerprints that differ in few bits are linked, and linked documents form components.

A fingerprint has a bit set where more than half of the hashed word shingles have it set. To find fingerprints that differ in
at most `d` bits, each is cut into d // 2 + 1 segments: one of them then differs by at most one bit. Each segment is
indexed once for every bit with that bit deleted; equal signatures meet in an equality grouping, and the whole
fingerprints are compared there. Only distinct fingerprints take part, so exact copies cost nothing.

Hot segments, whose value more than `HOT` fingerprints share, would make large groups. Fingerprints that have such a
value or are one bit away from it are linked by another exact way: signatures of the whole fingerprint with every d
bits deleted, where equal signatures prove the distance and all rows of a group link to its smallest, with no pairs.

Components come from alternating large-star and small-star rounds over the links, as Spark joins with a checkpoint
after each round. Links, fingerprints and components stay in Spark.

Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows share fingerprint and component. Rows
with a null id keep their fingerprint; they never name a component unless all of its ids are null. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import as_bytes, checkpointed, parts_for, written

BITS, SEED = 64, 42
#: Fingerprints that may share a segment's value before it counts as hot.
HOT = 1024
#: Names that input columns give way to.
RESERVED = ("fp", "component_id", "least", "root", "node", "_text")
#: Shingles whose bits are counted at once.
STEP = 1 << 15
_SPACES = bytes([32, *range(9, 14)])
_TO_SPACE = bytes(32 if b in _SPACES else (b + 32 if 65 <= b <= 90 else b) for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return [w for w in text.translate(_TO_SPACE).split(b" ") if w]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    words = words_of(text)
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (starts[shingle:] - 1).tolist(), strict=True)]
    h = np.array(hashes, "<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), STEP):
        part = h[at : at + STEP]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], shingle: int = 3) -> DataFrame:
    """Columns `keep` of `docs` and the fingerprint `fp` as a signed long."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(batch.num_columns - 1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=schema.names)

    return source.mapInArrow(run, schema)


def _segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    n = distance // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _value(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _bits(x: np.ndarray) -> np.ndarray:
    """Set bits of 64-bit values; signed ones are taken as they lie in memory."""
    return np.bitwise_count(x.view(np.uint64))


def _linked(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints of equal signatures that differ in at most `distance` bits; larger groups give a forest."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(first, len(keys)))
    left, right = [], []
    small = np.repeat(sizes, sizes) <= 4
    for off in (1, 2, 3):
        i = np.flatnonzero(small[:-off] & (keys[off:] == keys[:-off]))
        near = i[_bits(fps[i] ^ fps[i + off]) <= distance]
        left.append(fps[near])
        right.append(fps[near + off])
    for at, n in zip(first[sizes > 4].tolist(), sizes[sizes > 4].tolist(), strict=True):
        own = fps[at : at + n]
        near = _bits(own[:, None] ^ own[None, :]) <= distance
        label = np.arange(n)
        while True:  # smallest label within reach
            new = np.where(near, label[None, :], n).min(1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(n)
        left.append(own[label[moved]])
        right.append(own[moved])
    return np.concatenate(left), np.concatenate(right)


def _by_segment(fps: DataFrame, hot: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between fingerprints that share a one-bit-deleted segment, hot values left out."""
    parts = _segments(distance)
    fp = F.col("fp")
    values = fps.select("fp", F.posexplode(F.array(*[_value(fp, s, w) for s, w in parts])).alias("segment", "value"))
    cold = values.join(hot, ["segment", "value"], "left_anti")
    # One signature for each bit of the segment: the value with that bit set to nought, and the bit's number.
    widths = F.element_at(F.array(*[F.lit(w) for _, w in parts]), F.col("segment") + 1)
    variants = cold.select("fp", "segment", "value", F.explode(F.sequence(F.lit(0), widths - 1)).alias("bit"))
    key = F.xxhash64("segment", "bit", F.expr("value & ~shiftleft(1L, bit)"))
    n = parts_for(fps.sparkSession, fps.count() * BITS)

    def run(table: pa.Table) -> pa.Table:
        a, b = _linked(table["key"].to_numpy(), table["fp"].to_numpy(), distance)
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    spread = variants.select(key.alias("key"), "fp").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n * 4)))
    return spread.repartition(n, "part").groupBy("part").applyInArrow(run, "a long, b long")


def _by_deletion(fps: DataFrame, hot: DataFrame, distance: int) -> DataFrame:
    """Links among fingerprints at or next to hot values: equal whole fingerprints with `distance` bits deleted."""
    parts = _segments(distance)
    fp = F.col("fp")
    widths = F.element_at(F.array(*[F.lit(w) for _, w in parts]), F.col("segment") + 1)
    near = hot.select("segment", F.explode(F.concat(F.array("value"), F.transform(F.sequence(F.lit(0), widths - 1), lambda b: F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))).alias("value")).distinct()
    values = fps.select("fp", F.posexplode(F.array(*[_value(fp, s, w) for s, w in parts])).alias("segment", "value"))
    touched = values.join(near, ["segment", "value"], "left_semi").select("fp").distinct()
    masks = np.array([sum(1 << i for i in some) for some in combinations(range(BITS), distance)], np.uint64)
    assert len(masks) == comb(BITS, distance)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(fps), 256):
                some = fps[lo : lo + 256]
                keys = (some[:, None] & ~masks[None, :]).ravel().view(np.int64)
                which = np.tile(np.arange(len(masks), dtype=np.int32), len(some))
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(keys), pa.array(np.repeat(some, len(masks)).view(np.int64))], names=["mask", "key", "fp"])

    rows = touched.mapInArrow(expand, "mask int, key long, fp long")
    least = rows.groupBy("mask", "key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(least, ["mask", "key"]).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints `fp` which differ in at most `distance` bits."""
    parts = _segments(distance)
    fp = F.col("fp")
    values = fps.select(F.posexplode(F.array(*[_value(fp, s, w) for s, w in parts])).alias("segment", "value"))
    hot = checkpointed(values.groupBy("segment", "value").count().where(F.col("count") > HOT).drop("count"))
    found = _by_segment(fps, hot, distance)
    if not hot.isEmpty():
        found = found.unionByName(_by_deletion(fps, hot, distance))
    return found


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for every node of an edge; large-star and small-star rounds."""
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    before = mark(now)
    while before["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the smallest of the neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the node and its smaller neighbours move to the smallest
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
        now = checkpointed(small.distinct())
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(docs: DataFrame, keep: list[str], shingle: int = 3, distance: int = 2) -> DataFrame:
    """Columns `keep` of `docs` (doc_id among them; none of RESERVED), fp, and component_id: the smallest doc_id of the component."""
    keep = [c for c in keep if c not in RESERVED]
    rows = written(fingerprints(docs, keep, shingle))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    distinct = checkpointed(distinct)
    roots = connected(links(distinct.select("fp"), distance))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "root").select("fp", "component_id"), "fp")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    return components(docs, ["doc_id"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
