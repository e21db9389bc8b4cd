"""Substring deduplication on words, by fixed-block anchors.

Every document's non-overlapping blocks of `BLOCK` words are indexed, and every rolling window of `BLOCK` words probes that
index: a passage of `WIDTH` words holds a whole block wherever it begins, so each of its copies has a hit. A window of WIDTH words
that is repeated holds nothing but repeated strings of BLOCK words; of those inside it that are hits, the smallest is its anchor.
Windows with equal anchors meet and are compared, and neighbouring repeated windows together are the maximal exact
repeats. The hits are only a screen (hashes of 32 bits within each part): a false one costs a comparison and changes nothing.
Windows of a hot anchor meet by a hash of the whole window instead. Windows are told apart by two polynomial hashes of 64
bits (different bases and codes) and then by their text.

Each word covered by a window that also starts earlier (smaller id, or same document and earlier start) is removed; windows are judged
on the input. Null and empty texts have no words. Rows with a null id come before all others; equal
ids are ordered by a hash of their text, and equal rows count as separate documents, of which the first in the input
stays. An empty table gives an empty result. Input columns named like results give way to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import byte_codes, mixed, range_hashes
from weftgraph.llm.repeats import BLOB, PARTS, Chunk, Gathered, Known, blobs, chunked, counted, removed, repeated_values, resolved, runs_of, settled

#: Words in a window, and in a block.
WIDTH, BLOCK = 20, 10
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_CODES = (byte_codes(11), byte_codes(12))
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_NEXT = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
RESULTS = ("n_words", "n_removed", "spans", "kept")


def normal(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, each followed by one space: the bytes, starts and ends of words, and each word's text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    data = np.where(space, np.uint8(32), raw)[keep]
    ends = np.flatnonzero(data == 32)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    # where each word's last byte stood in the raw buffer
    last = np.flatnonzero(~space[:-1] & space[1:])
    return data, starts, ends, np.searchsorted(begins, last, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word."""
    return range_hashes(data, starts, ends, _CODES[which], _BASE[which])


def grams(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of n consecutive words, from each word on; the last n - 1 are of no use."""
    out = np.zeros(len(words), np.uint64)
    for k in range(min(n, len(words))):
        out[: len(words) - k] += words[k:] * np.uint64(pow(_NEXT[which], k, 1 << 64))
    return mixed(out)


def _places(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n words of one document start, as indexes of words; and for each word its number in the document."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    number = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    return (np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)), number


def _anchors(parts: int):
    """Each chunk's rolling windows of BLOCK words, with counts, and marks for indexed blocks."""

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk.of(table)
        found, blocks = [], []
        for _, texts in chunk.slices():
            data, starts, ends, doc = normal(texts)
            at, number = _places(doc, BLOCK)
            found.append(grams(word_hashes(data, starts, ends), BLOCK)[at])
            blocks.append(number[at] % BLOCK == 0)
        return blobs([(p, chunk.chunk, b) for p, b in counted(np.concatenate(found), parts, np.concatenate(blocks))])

    return run


def _segments(anchor_parts: int, parts: int):
    """Each chunk's windows of WIDTH words that may be repeated, as segments with one anchor each; those of hot anchors one by one."""
    spread, none = WIDTH - BLOCK + 1, np.uint64(2**64 - 1)

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        chunk = Chunk.of(table)
        known, out = Known.of(back), Gathered(chunk, parts)
        for lo, texts in chunk.slices() if len(known.codes) else ():
            data, starts, ends, doc = normal(texts)
            at, number = _places(doc, WIDTH)
            if not len(at):
                continue
            words = word_hashes(data, starts, ends)
            f = grams(words, BLOCK)
            again, flags = known.look_up(f, anchor_parts)
            f = np.where(flags & 1, f, none)
            single = np.concatenate([np.zeros(1, np.int64), np.cumsum(~again)])
            least, hot = f[at], (flags & 2)[at] > 0
            for k in range(1, spread):
                smaller = f[at + k] < least
                least, hot = np.where(smaller, f[at + k], least), np.where(smaller, (flags & 2)[at + k] > 0, hot)
            some = (least != none) & (single[at + spread] == single[at])
            at, least, hot = at[some], least[some], hot[some]
            if not len(at):
                continue
            key = np.where(hot, grams(words, WIDTH)[at], least)
            first, count = runs_of(least, at, hot)
            raw = data.tobytes()
            begin, end = starts[at[first]], ends[at[first + count - 1] + WIDTH - 1]
            for a, d, s, c, b, e in zip(key[first].tolist(), (doc[at[first]] + lo).tolist(), number[at[first]].tolist(), count.tolist(), begin.tolist(), end.tolist(), strict=True):
                out.add(a, d, s, c, raw[b:e])
        return out.table()

    return run


def repeated(segments: list[bytes], windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) of each window of WIDTH words that an equal one stands before."""
    data, starts, ends, doc = normal(segments)
    at, number = _places(doc, WIDTH)
    a, b = (grams(word_hashes(data, starts, ends, k), WIDTH, k)[at] for k in (0, 1))
    order = np.lexsort((b, a))
    new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    earliest = np.repeat(np.minimum.reduceat(order, first), np.diff(np.append(first, len(order)))) if len(order) else order
    again = order != earliest
    order, earliest, raw = order[again], earliest[again], data.tobytes()
    begin, end = starts[at], ends[at + WIDTH - 1] if len(at) else starts[at]
    of = lambda i: raw[begin[i] : end[i]]
    same = [of(i) == of(j) for i, j in zip(order.tolist(), earliest.tolist(), strict=True)]
    if not all(same):  # different windows of equal hashes: told apart by text
        return _by_text([of(i) for i in range(len(at))], doc[at], number[at])
    later = np.sort(order)
    return doc[at[later]], number[at[later]]


def _by_text(texts: list[bytes], segment: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen: set[bytes] = set()
    again = [t in seen or bool(seen.add(t)) for t in texts]
    return segment[again], window[again]


def dedup(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of `docs` (all but text, if not given), with n_words, n_removed, spans (runs of removed words: at, end) and kept."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*RESULTS, "text")]
    name, result = _dedup(docs, keep)
    return settled(result, name)


def _dedup(docs: DataFrame, keep: list[str]) -> tuple[str, DataFrame]:
    """The result of `dedup`, and the table that it is read from."""
    name, chunks = chunked(docs, keep)
    table, parts = docs.sparkSession.table(name), chunks * PARTS
    back = table.groupBy("chunk").applyInArrow(_anchors(chunks), BLOB).repartition(chunks, "part").groupBy("part").applyInArrow(repeated_values(True), BLOB)
    segments = table.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_segments(chunks, parts), BLOB)
    gone = segments.repartition(chunks, "part").groupBy("part").applyInArrow(lambda t: resolved(t, repeated), "chunk int, blob binary")
    more = T._parse_datatype_string("n_words long, n_removed long, spans array<struct<at:long,end:long>>, kept string").fields
    schema = T.StructType([*table.schema["_keep"].dataType.fields, *more])

    def finish(own: pa.Table, blobs: pa.Table) -> pa.Table:
        chunk = Chunk.of(own)
        spans = removed(chunk, blobs, WIDTH)
        kept, total = [], []
        for text, some in zip(chunk.texts, spans, strict=True):
            words = [w for w in text.translate(_TO_SPACE).split(b" ") if w]
            total.append(len(words))
            for a, b in reversed(some):
                del words[a:b]
            kept.append(b" ".join(words))
        lost = [sum(b - a for a, b in some) for some in spans]
        of = pa.list_(pa.struct([("at", pa.int64()), ("end", pa.int64())]))
        cols = dict(zip(keep, chunk.table["_keep"].combine_chunks().flatten(), strict=True))
        return pa.table(cols | {"n_words": pa.array(total, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "spans": pa.array([[{"at": a, "end": b} for a, b in some] for some in spans], of), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return name, table.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(finish, schema)


_TO_SPACE = bytes(32 if _SPACE[b] else b for b in range(256))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    name, result = _dedup(docs, ["doc_id"])
    return settled(result.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), name)
