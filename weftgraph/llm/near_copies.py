"""Near copies by SimHash at a similarity of 0.8: wide fingerprints, one-bit-deleted segments, exact verification, exact rest.

At a Jaccard similarity of 0.8 over word shingles two SimHashes differ in about 15 % of their bits, far more than 64-bit
fingerprints can be searched for by segments. So the fingerprint has `BANDS` segments of 20 bits: a segment of such a pair
differs in at most one bit with a probability of about 0.17, and of sixteen segments one does in 95 cases of 100 (and in
more than 99.9 at 0.9). Segments are longer where there are more texts (`width_for`), so that unrelated texts don't fill their
buckets; the exact part below then finds more of the links, and the result is the same. Segments meet by their exact half
and are compared with each bit of the other half deleted; fingerprints that are near enough become candidates, and
candidates are verified on their exact sets of shingles.

Exact copies are one document throughout. In a bucket of many near copies each text is compared with leaders only (a text
that no leader is near becomes one), in another order in each segment, so that a large group gives no pairs. Verified links
are joined to components.

Fingerprints only find most links cheaply; what they miss is found exactly. Two sets of a similarity of 0.8 share one of the
first fifth of their shingles in any common order, so the texts of different components that share one there, and that
sizes and sketches (parities of the shingles by hash, which bound how many two sets share) leave possible, are verified too. Few
texts that share a token are paired at once; of many, only who they are leaves the task, each distinct group once, and they are
compared on whole sketches in blocks, two blocks to a task, so that what cannot be a link never becomes a row.
Common shingles come last in that order; which are common is taken from a sample and decides the speed only. Of each
component over all links the document with the smallest id stays.

Null and empty texts are copies of each other. Documents with a null id stay only if no copy has an id. An empty table gives an
empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, mixed, parts_for, written
from weftgraph.llm.simhash import connected, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Segments of a fingerprint, and their bits at least and at most.
BANDS, WIDTHS = 16, (20, 24, 28, 32)
#: Share of bits in which two texts of SIMILARITY differ.
APART = 0.1515
STEP = 1 << 13
#: Texts of the sample (or one of as many, if more) that tells common shingles, and how many of those come last in the order.
SAMPLE, ONE_OF, COMMON = 4000, 50, 100_000
#: 64-bit words of the short sketch, which is also the least sketch; members of a token's group that are paired at once, and of a larger one's blocks.
FOLDED, GROUP, BLOCK = 2, 16, 2048


def width_for(texts: int) -> int:
    """Bits of a segment, so that few unrelated ones of so many texts share one."""
    return next((w for w in WIDTHS if texts <= 1 << w), WIDTHS[-1])


def far_for(width: int) -> int:
    """Bits that candidates may differ in: what SIMILARITY gives, and three standard deviations."""
    n = BANDS * width
    return int(APART * n + 3 * (APART * (1 - APART) * n) ** 0.5)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles (fewer words: the whole sequence)."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    ends = starts[min(size, len(words)) :] - 1
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b]) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)], np.uint64))


def wide_fingerprint(hashes: np.ndarray, words: int = BANDS * WIDTHS[0] // 64) -> np.ndarray:
    """64-bit words of SimHash over a set of hashes."""
    counts = np.zeros(64 * words, np.int64)
    for lo in range(0, len(hashes), STEP):
        part = np.stack([mixed(hashes[lo : lo + STEP] + np.uint64(k * 0x9E3779B9)) for k in range(words)], 1)
        counts += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of a set's hashes, common ones last: sets of SIMILARITY share one of them. An empty set has 0."""
    n = len(hashes)
    if not n:
        return np.zeros(1, np.uint64)
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    often = common[at] == hashes if len(common) else np.zeros(n, bool)
    ordered = np.concatenate([hashes[~often], hashes[often][np.argsort(rank[at[often]])]]) if often.any() else hashes
    return ordered[: n - least_shared(n) + 1]


def least_shared(n: int) -> int:
    """How many of n hashes a set of SIMILARITY has at least (one less where that is not sure in floating point)."""
    return max(1, int(np.ceil(SIMILARITY * n - 1e-9)))


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of how many hashes fall on each bit: two sets differ in at least as many hashes as their sketches in bits.

    There are as many bits as hashes, rounded up to a power of two, so that sketches of long texts tell as much as those of short ones.
    """
    bits = max(64 * FOLDED, 1 << (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((mixed(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded, so that its parities are those of fewer bits."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        half = len(x) // 2
        x = (int.from_bytes(x[:half]) ^ int.from_bytes(x[half:])).to_bytes(half)
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def _fingerprints(common: np.ndarray, rank: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in as_bytes(batch.column(2))]
            cols = [pa.array([wide_fingerprint(s, BANDS * width // 64).tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())]
            cols += [pa.array([prefix(s, common, rank).tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["id", "same", "fp", "size", "first", "sketch"])

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in as_bytes(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["token"])


def _common(texts: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most texts of a sample have, sorted, and the place of each in the order (rarer first)."""
    one = max(1, min(ONE_OF, count // SAMPLE))
    some = texts.where(F.pmod(F.xxhash64("same"), F.lit(one)) == 0).select("_row.text")
    counts = some.mapInArrow(_hashes, "token long").groupBy("token").count().where("count > 1")
    rows = counts.orderBy(F.desc("count"), "token").limit(COMMON).toArrow()
    token, n = rows["token"].to_numpy().view(np.uint64), rows["count"].to_numpy()
    order = np.argsort(token)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, n))] = np.arange(len(token))
    return token[order], rank[order]


def _spread(width: int):
    """For each text and segment two rows, by either half of the segment: key, the other half."""
    half, words = width // 2, BANDS * width // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, words)
            bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little").reshape(-1, BANDS, 2, half)
            values = (bits.astype(np.int64) << np.arange(half)).sum(3)  # row, band, half
            keys = (np.arange(BANDS)[:, None] * 2 + np.arange(2))[None] * (1 << half) + values
            n = BANDS * 2
            at = pa.array(np.repeat(np.arange(len(fps)), n))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(values[:, :, ::-1].ravel().astype(np.int32)), batch.column(0).take(at), batch.column(1).take(at)], names=["key", "other", "same", "fp"])

    return run


def _near(width: int):
    """Candidate links of one part: its rows share a segment's half where their keys are equal."""
    half, words, far = width // 2, BANDS * width // 64, far_for(width)

    def run(table: pa.Table) -> pa.Table:
        key, other, same = (table[c].to_numpy() for c in ("key", "other", "same"))
        fps = np.frombuffer(b"".join(table["fp"].to_pylist()), "<u8").reshape(-1, words)
        turn = mixed(same.view(np.uint64) ^ (key.astype(np.uint64) << np.uint64(32)))  # another order in each segment
        left, right = [], []

        def link(i: np.ndarray, j: np.ndarray) -> None:
            near = np.bitwise_count(fps[i] ^ fps[j]).sum(1) <= far
            left.append(same[i[near]])
            right.append(same[j[near]])

        for bit in range(half):
            code = (key << half) | (other & ~(1 << bit))
            order = np.lexsort((turn, code))
            c = code[order]
            first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            sizes = np.diff(np.append(first, len(c)))
            small = np.repeat(sizes, sizes) <= 8
            for off in range(1, 8):
                i = np.flatnonzero(small[:-off] & (c[off:] == c[:-off]))
                link(order[i], order[i + off])
            for at, n in zip(first[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
                rest = order[at : at + n]
                while len(rest) > 1:
                    near = np.bitwise_count(fps[rest[1:]] ^ fps[rest[0]]).sum(1) <= far
                    left.append(np.full(near.sum(), same[rest[0]]))
                    right.append(same[rest[1:][near]])
                    rest = rest[1:][~near]
        a, b = np.concatenate(left), np.concatenate(right)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each hash of each text's prefix, with a short sketch of its set: the long one folded, so that it bounds the same."""
    for batch in batches:
        blobs = batch.column(3).to_pylist()
        folded = np.array([np.bitwise_xor.reduce(np.frombuffer(s, "<i8").reshape(-1, FOLDED)) for s in batch.column(4).to_pylist()], np.int64).reshape(-1, FOLDED)
        which = np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs])
        at = pa.array(which)
        cols = [pa.array(np.frombuffer(b"".join(blobs), np.int64)), *(batch.column(k).take(at) for k in range(3)), *(pa.array(folded[which, k]) for k in range(FOLDED))]
        yield pa.RecordBatch.from_arrays(cols, names=["token", "same", "root", "size", "s0", "s1"])


def _across(table: pa.Table) -> pa.Table:
    """Of one part: pairs (a, b) of small groups whose texts share a token, are of different components, and of near enough sizes and short sketches;
    members (group, same) of larger groups, which are not paired here. Groups of the same members are one."""
    token, same, root, size, s0, s1 = (table[c].to_numpy() for c in ("token", "same", "root", "size", "s0", "s1"))
    order = np.lexsort((same, root, token))
    token, same, root, size = token[order], same[order], root[order], size[order].astype(np.int64)
    short = np.stack([s0, s1], 1).view(np.uint64)[order]
    first = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(token)))
    several = root[first] != root[first + counts - 1]  # sorted by component: others than one
    found = [np.zeros((0, 2), np.int64)]
    small = np.repeat(several & (counts <= GROUP), counts)
    for off in range(1, GROUP):
        i = np.flatnonzero(small[:-off] & (token[off:] == token[:-off]))
        j = i + off
        fits = (root[i] != root[j]) & (np.minimum(size[i], size[j]) >= SIMILARITY * np.maximum(size[i], size[j]) - 1e-9)
        i, j = i[fits], j[fits]
        # sets of SIMILARITY differ in this share of their members at most, and sketches in no more bits
        near = np.bitwise_count(short[i] ^ short[j]).sum(1, dtype=np.int64) * (1 + SIMILARITY) <= (1 - SIMILARITY) * (size[i] + size[j]) + 1e-6
        a, b = same[i[near]], same[j[near]]
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
    pairs = np.unique(np.concatenate(found), axis=0)
    members: dict[int, np.ndarray] = {}
    for at, n in zip(first[several & (counts > GROUP)].tolist(), counts[several & (counts > GROUP)].tolist(), strict=True):
        own = np.sort(same[at : at + n])
        key = xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)
        members[key] = own if key not in members else np.union1d(members[key], own)  # unlike groups of equal hash are one larger group
    rows = np.concatenate([np.zeros(0, np.int64), *members.values()])
    groups = np.repeat(np.array(list(members), np.int64), [len(m) for m in members.values()])
    none = pa.nulls(len(pairs), pa.int64())
    cols = [pa.chunked_array([x, y], pa.int64()) for x, y in ((pa.array(pairs[:, 0]), pa.nulls(len(rows), pa.int64())), (pa.array(pairs[:, 1]), pa.nulls(len(rows), pa.int64())), (none, pa.array(groups)), (none, pa.array(rows)))]
    return pa.table(cols, names=["a", "b", "group", "same"])


def _block(table: pa.Table) -> pa.Table:
    """Pairs of one block of a large group that are of different components and that sizes and whole sketches allow: nothing else leaves the task."""
    size = table["size"].to_numpy().astype(np.int64)
    order = np.argsort(size, kind="stable")
    size, same, root = size[order], table["same"].to_numpy()[order], table["root"].to_numpy()[order]
    sketches = table["sketch"].to_pylist()
    sketches = [np.frombuffer(sketches[k], np.uint8) for k in order.tolist()]
    widths = np.array([len(x) for x in sketches])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for width in np.unique(widths).tolist():
        # a larger set within SIMILARITY has a sketch as wide, or one twice as wide, which is folded
        of = np.flatnonzero((widths == width) | (widths == 2 * width))
        bits = np.stack([x if len(x) == width else x[:width] ^ x[width:] for x in (sketches[k] for k in of.tolist())]).view(np.uint64)
        own, n = of[widths[of] == width], size[of]
        place = np.searchsorted(of, own)
        for i, at in zip(own.tolist(), place.tolist(), strict=True):
            end = int(np.searchsorted(n, size[i] / SIMILARITY + 1e-6, "right"))
            for lo in range(at + 1, end, 4096):
                j = np.arange(lo, min(end, lo + 4096))
                total = size[i] + n[j]
                both = (total - np.bitwise_count(bits[j] ^ bits[at]).sum(1, dtype=np.int64)) // 2  # at most
                j = j[(both >= SIMILARITY * (total - both) - 1e-9) & (root[of[j]] != root[i])]
                left.append(np.full(len(j), same[i]))
                right.append(same[of[j]])
    a, b = np.concatenate(left), np.concatenate(right)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _large(members: DataFrame, prints: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, b) of the large groups (group, same), each group in blocks of about BLOCK members; each two blocks meet in a task."""
    blocks = members.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("same", F.lit(1)), F.col("blocks")).cast("int")
    each = members.join(blocks, "group").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("group", "same", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = each.join(prints.select("same", "size", "sketch"), "same").join(roots.select("same", "root"), "same")
    return rows.repartition(parts, "group", "i", "j").groupBy("group", "i", "j").applyInArrow(_block, "a long, b long")


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches and sizes allow SIMILARITY."""
    for batch in batches:
        total = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
        differ = np.array([apart(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], np.int64)
        both = (total - differ) // 2  # at most
        yield batch.select(["a", "b"]).filter(pa.array(both >= SIMILARITY * (total - both) - 1e-9))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [shingles(t).tobytes() for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["same", "set"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) whose sets are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both >= SIMILARITY * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _merged(docs: DataFrame) -> DataFrame:
    """One row for each text, `same` (its hash), `id` (the smallest, null last) and `_row` (all columns), as a table bucketed by hash.

    Copies are merged before they travel, so a text that a third of all rows hold is one row from each task.
    """
    spark = docs.sparkSession
    own = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"), F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    first = own.groupBy("same").agg(F.min_by(F.struct("id", "_row"), F.struct(F.col("id").isNull(), "id")).alias("first")).select("same", "first.id", "first._row")
    name = f"weft_{uuid.uuid4().hex}"
    # as many buckets as shuffle partitions: what grouping dealt out is written as it is
    first.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "same").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def _verified(texts: DataFrame, links: DataFrame) -> DataFrame:
    """Those of the distinct links (a, b) whose texts are similar enough."""
    # each text that some link names, once
    asked = links.select(F.col("a").alias("same")).unionByName(links.select(F.col("b").alias("same"))).distinct()
    named = texts.join(asked, "same", "left_semi").select("same", "_row.text")
    sets = written(named.mapInArrow(_sets, "same long, set binary"))
    pairs = links.join(sets.select(F.col("same").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("same").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return pairs.mapInArrow(_verify, "a long, b long")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest id; all columns."""
    spark = docs.sparkSession
    texts = _merged(docs)
    count = texts.count()
    width = width_for(count)
    common, rank = _common(texts, count)
    prints = written(texts.select("id", "same", "_row.text").mapInArrow(_fingerprints(common, rank, width), "id long, same long, fp binary, size int, first binary, sketch binary"))
    parts = parts_for(spark, 4 * 2 * BANDS * count) * 2
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    spread = prints.select("same", "fp").mapInArrow(_spread(width), "key long, other int, same long, fp binary").withColumn("part", part)
    links = written(_verified(texts, written(spread.repartition(parts // 2, "part").groupBy("part").applyInArrow(_near(width), "a long, b long").distinct())))
    # the rest, exactly: texts of different components that share a token of their prefixes
    placed = prints.select("same", "size", "first", "sketch").join(connected(links), F.col("same") == F.col("node"), "left").select("same", F.coalesce("root", "same").alias("root"), "size", "first", "sketch")
    tokens = placed.mapInArrow(_tokens, "token long, same long, root long, size int, s0 long, s1 long").withColumn("part", F.pmod(F.xxhash64("token"), F.lit(parts)))
    met = written(tokens.repartition(parts // 2, "part").groupBy("part").applyInArrow(_across, "a long, b long, group long, same long"))
    across = met.where("group IS NULL").select("a", "b").distinct()
    large = _large(met.where("group IS NOT NULL").select("group", "same").distinct(), prints, placed, parts // 2)
    of = lambda end, blob, size: prints.select(F.col("same").alias(end), F.col("sketch").alias(blob), F.col("size").alias(size))
    possible = across.join(of("a", "x", "p"), "a").join(of("b", "y", "q"), "b").select("a", "b", "x", "y", "p", "q").mapInArrow(_possible, "a long, b long")
    roots = connected(links.unionByName(_verified(texts, written(possible.unionByName(large).distinct()))))
    grouped = prints.select("same", "id").join(roots, F.col("same") == F.col("node"), "left").select("same", "id", F.coalesce("root", "same").alias("root"))
    # one text of each component: that of the smallest id, null last
    stays = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "same")).alias("least")).select(F.col("least.same").alias("same"))
    return texts.join(stays, "same", "left_semi").select("_row.*")
