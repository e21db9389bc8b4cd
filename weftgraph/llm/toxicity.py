"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its byte n-grams (with a mark at either end), so a misspelling or
inflection that training never saw shares most vectors with the word it comes from. A passage of
`WINDOW` words is the average of its words, and a linear softmax turns it into a probability. A document is
as toxic as its worst passage: one insult in a long text is not averaged away. Embeddings and softmax weights
are learnt together from document labels; the gradient flows through each document's worst passage.

Only a bounded sample of labelled rows is used for training: `MAX_PER_CLASS` documents of each class, those with
the smallest hash of their id. Scoring covers every whole text; it needs no shuffle.

Null, empty and wordless texts get the score of an empty passage (the bias alone). Rows with a null id are scored
too, and count as not held out. Labels that are null or whose document is missing are ignored; a document that
is labelled twice counts as toxic if any label says so. Without both classes every score is the share of
toxic labels (0 without labels). Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import as_bytes, byte_codes, mixed, slices

#: Labelled documents of each class that training sees at most.
MAX_PER_CLASS = 1500
#: Lengths of the byte n-grams, hashed into 2 ** BITS vectors of DIM numbers.
GRAMS, BITS, DIM = (3, 4, 5, 6), 17, 8
#: Words in a passage.
WINDOW = 8
#: UTF-8 bytes of text that are cut into n-grams at once.
PART = 1 << 17
EPOCHS, BATCH, RATE, SEED = 10, 64, 0.3, 7
#: Documents score toxic from here on.
THRESHOLD = 0.3

_CODES = byte_codes(101)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Passages:
    """Words and passages of a few texts, joined into one buffer."""

    grams: list[np.ndarray]  # vector numbers of the n-grams that start at each byte, by length
    starts: np.ndarray  # of words
    ends: np.ndarray
    first: np.ndarray  # first word of each passage
    doc: np.ndarray  # document of each passage


def passages(texts: list[bytes]) -> Passages:
    """Cut texts into passages of WINDOW words."""
    data = _FOLD[np.frombuffer(b" " + b" ".join(texts) + b" " * max(GRAMS), np.uint8)]
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8)))
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    data = np.where(word, data, 32)
    codes, h, grams = _CODES[data], None, []
    n = len(data) - max(GRAMS) + 1
    for k in range(max(GRAMS)):
        part = codes[k : k + n] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
        h = part if h is None else h + part
        if k + 1 in GRAMS:
            grams.append((mixed(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int32))
    begins = np.cumsum([1, *(len(t) + 1 for t in texts)])[: len(texts)]
    of = np.searchsorted(begins, starts, "right") - 1  # document of each word
    change = np.flatnonzero(np.diff(of, prepend=-1))
    place = np.arange(len(of)) - np.repeat(change, np.diff(np.append(change, len(of))))
    first = np.flatnonzero(place % WINDOW == 0)
    return Passages(grams, starts, ends, first, of[first])


def _logits(p: Passages, by_gram: np.ndarray, bias: float) -> np.ndarray:
    """Of each passage; by_gram: what each n-gram vector adds."""
    total, count = np.zeros(len(p.starts)), np.zeros(len(p.starts))
    for n, g in zip(GRAMS, p.grams, strict=True):
        sums = np.concatenate([[0.0], np.cumsum(by_gram[g], dtype=np.float64)])
        lo, hi = p.starts - 1, np.maximum(p.ends - n + 2, p.starts - 1)
        total += sums[hi] - sums[lo]
        count += hi - lo
    words = total / np.maximum(count, 1)
    sizes = np.diff(np.append(p.first, len(words)))
    return np.add.reduceat(words, p.first) / sizes + bias if len(p.first) else np.zeros(0)


def _grams_of(p: Passages, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The vector numbers in passage k and their shares of the average."""
    last = p.first[k + 1] if k + 1 < len(p.first) else len(p.starts)
    ids, shares = [], []
    for w in range(p.first[k], last):
        own = np.concatenate([g[p.starts[w] - 1 : max(p.ends[w] - n + 2, p.starts[w] - 1)] for n, g in zip(GRAMS, p.grams, strict=True)])
        ids.append(own)
        shares.append(np.full(len(own), 1 / max(1, len(own)) / (last - p.first[k])))
    return np.concatenate(ids), np.concatenate(shares)


@dataclass
class Model:
    """by_gram: embedding times softmax weights, for each n-gram vector; scale and shift: calibration."""

    by_gram: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of the toxic class for each text."""
        worst = np.full(len(texts), -np.inf)
        for lo, hi in slices(np.array([len(t) for t in texts]), PART):
            p = passages(texts[lo:hi])
            np.maximum.at(worst, p.doc + lo, _logits(p, self.by_gram, self.bias))
        worst = np.where(np.isfinite(worst), worst, self.bias)
        return 1 / (1 + np.exp(-np.clip(self.scale * worst + self.shift, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, share: float) -> Model:
    """Learn embeddings and softmax weights together; share: of toxic documents among all labelled ones."""
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.1, (1 << BITS, DIM))
    weights = rng.normal(0, 1, (DIM, 2))
    bias = np.zeros(2)
    squares, w_squares, b_squares = np.full(1 << BITS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    lengths = np.array([len(t) for t in texts])
    for _ in range(EPOCHS):
        for some in np.array_split(order := rng.permutation(len(texts)), max(1, len(order) // BATCH)):
            gap = weights[:, 1] - weights[:, 0]
            by_gram = table @ gap
            ids, shares, errors, sizes = [], [], [], []
            # cut anew each time: n-grams of all texts at once would take twenty times the memory of the texts
            for lo, hi in slices(lengths[some], PART):
                p = passages([texts[d] for d in some[lo:hi]])
                z = _logits(p, by_gram, bias[1] - bias[0])
                first = np.flatnonzero(np.diff(p.doc, prepend=-1))
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(z)], strict=True):
                    k = a + int(np.argmax(z[a:b]))
                    g, s = _grams_of(p, k)
                    ids.append(g)
                    shares.append(s)
                    errors.append(1 / (1 + np.exp(-np.clip(z[k], -30, 30))) - labels[some[lo + p.doc[a]]])
                    sizes.append(len(g))
            if not ids:
                continue
            g, s, e = np.concatenate(ids), np.concatenate(shares), np.repeat(errors, sizes)
            unique, place = np.unique(g, return_inverse=True)
            slope = np.bincount(place, s * e)  # of the loss by the logit gap, for each vector
            d_weights = (table[unique] * slope[:, None]).sum(0)
            d_weights = np.stack([-d_weights, d_weights], 1)
            d_table = slope[:, None] * gap
            squares[unique] += (d_table**2).mean(1)
            w_squares += d_weights**2
            b = np.sum(errors)
            b_squares += b * b
            table[unique] -= RATE * d_table / np.sqrt(squares[unique])[:, None]
            weights -= RATE * d_weights / np.sqrt(w_squares)
            bias -= RATE * np.array([-b, b]) / np.sqrt(b_squares)
    model = Model((table @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0]))
    return _calibrated(model, texts, labels, share)


def _calibrated(model: Model, texts: list[bytes], labels: np.ndarray, share: float) -> Model:
    """Fit scale and shift so that scores are probabilities at the true share of toxic documents."""
    s = model.scores(texts)
    z = np.log(np.maximum(s, 1e-13) / np.maximum(1 - s, 1e-13))
    have = max(labels.mean(), 1e-6)
    weight = np.where(labels == 1, share / have, (1 - share) / max(1 - have, 1e-6))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, held back so that a perfect split keeps a finite slope
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, v = weight * (p - labels), weight * p * (1 - p)
        grad = np.array([(r * z).sum() + 1.0 * (a - 1), r.sum() + 0.01 * b])
        hess = np.array([[(v * z * z).sum() + 1.0, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    model.scale, model.shift = float(max(a, 0.05)), float(b)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on at most MAX_PER_CLASS labelled documents of each class that are not held out."""
    known = (
        labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = known.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("pos")).first()
    share = counts["pos"] / counts["n"] if counts["n"] else 0.0
    rank = F.xxhash64("doc_id")
    picked = None
    for cls in (0, 1):
        some = known.where((F.col("toxic") == 1) == bool(cls)).orderBy(rank, "doc_id").limit(MAX_PER_CLASS)
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * MAX_PER_CLASS rows of two numbers.
    table = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toArrow()
    table = table.sort_by("doc_id")
    y = np.array(table["toxic"].to_pylist(), dtype=np.float64)
    y = (y == 1).astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        odds = np.log(max(share, 1e-13) / max(1 - share, 1e-13))
        return Model(np.zeros(1 << BITS, np.float32), float(odds))
    return train(as_bytes(table["text"]), y, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs`, and `toxicity`: the probability that the text is toxic (an input column of that name gives way)."""
    docs = docs.drop("toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.scores(as_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels and score every document: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
