"""Quality by co-training: a text view and a page-metadata view teach each other, and calibrated scores are combined.

The text view sees only the text: rates of letters, digits, marks and repeats, and hashed byte trigrams. The metadata view sees only
language, source and length. Each is a logistic regression. In each round both views score all unlabelled rows on Spark; the
`TAKE` rows that a view is most sure of, in the classes' proportions, join the other view's training rows. After `ROUNDS` rounds
both are calibrated on labelled rows set aside, and a logistic regression on the two calibrated logits gives the score.

Labelled rows are a bounded sample, at most MAX_PER_CLASS of each class by smallest hash of the id; of the unlabelled
ones all take part in every round, and only those chosen reach the driver. Scoring covers every whole text where it is
read, without a shuffle.

Null texts count as empty; null metadata are a value of their own. A document labelled twice is good only if all labels say so; of
several texts of one labelled id the one with the smallest features counts. Null labels and ids are ignored in training;
rows with a null id are scored. Without both classes every score is the share of
good labels (0.5 without labels). Repeated rows are scored alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import as_bytes, mixed, written
from weftgraph.llm.toxicity import held_out

#: Labelled rows of each class at most; rounds; rows that a view chooses in each.
MAX_PER_CLASS, ROUNDS, TAKE = 3000, 4, 400
TRIGRAMS, SOURCES, LANGS, SIZES = 256, 64, 16, 24
THRESHOLD = 0.5
_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 space, 5 mark, 6 not ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5


def text_features(text: bytes) -> np.ndarray:
    """The text view of one text."""
    out = np.zeros(12 + TRIGRAMS)
    out[0] = 1
    data = np.frombuffer(text, np.uint8)
    if len(data):
        words = text.split()
        share = np.bincount(_KIND[data], minlength=7) / len(data)
        out[1:8] = share
        out[8] = np.log1p(len(words)) / 8
        out[9] = len(set(words)) / max(1, len(words))
        out[10] = min(2.0, len(data) / max(1, len(words)) / 10)
        out[11] = text.count(b"\n") / max(1, len(words))
        if len(data) > 2:
            d = data.astype(np.uint64)
            grams = mixed(d[:-2] | (d[1:-1] << np.uint64(8)) | (d[2:] << np.uint64(16))) % np.uint64(TRIGRAMS)
            out[12:] = np.sqrt(np.bincount(grams.astype(np.int64), minlength=TRIGRAMS) / len(grams))
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view of one row."""
    out = np.zeros(1 + LANGS + SOURCES + SIZES)
    out[0] = 1
    out[1 + zlib.crc32(repr(lang).encode()) % LANGS] = 1
    out[1 + LANGS + zlib.crc32(repr(source).encode()) % SOURCES] = 1
    out[1 + LANGS + SOURCES + (0 if n_chars is None else min(SIZES - 1, 1 + int(np.log2(1 + max(0, n_chars)))))] = 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """Weights of both views, their calibrations (scale, shift), and the weights of the combination."""

    text: np.ndarray
    meta: np.ndarray
    calibrations: tuple[np.ndarray, np.ndarray]
    combined: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: calibrated text view, calibrated metadata view, combination."""
        logits = [_scaled(c, x @ w) for c, x, w in zip(self.calibrations, (text, meta), (self.text, self.meta), strict=True)]
        both = np.stack([*logits, np.ones(len(text))], 1) @ self.combined
        return 1 / (1 + np.exp(-np.clip(np.stack([*logits, both], 1), -30, 30)))


def _scaled(c: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.clip(c[0] * z + c[1], -30, 30)


#: From both views' weights and how many bad and good rows are wanted: for each view (text features, metadata features, labels) of the rows it is sure of.
Choose = Callable[[list[np.ndarray], int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, choose: Choose) -> Model:
    """Rounds of pseudo-labels between the views; every fourth labelled row is set aside for calibration."""
    aside = np.arange(len(y)) % 4 == 3
    views, targets = [text[~aside], meta[~aside]], [y[~aside], y[~aside]]
    good = int(round(TAKE * y.mean()))
    for _ in range(ROUNDS):
        sure = choose([_logistic(x, t) for x, t in zip(views, targets, strict=True)], TAKE - good, good)
        for k in (0, 1):  # what one view is sure of teaches the other
            views[k] = np.vstack([views[k], sure[1 - k][k]])
            targets[k] = np.append(targets[k], sure[1 - k][2])
    weights = [_logistic(x, t) for x, t in zip(views, targets, strict=True)]
    calibrations, logits = [], []
    for x, w in zip((text, meta), weights, strict=True):
        z = x[aside] @ w
        c = _logistic(np.stack([z, np.ones(len(z))], 1), y[aside], 0.01)
        calibrations.append(c)
        logits.append(_scaled(c, z))
    combined = _logistic(np.stack([*logits, np.ones(aside.sum())], 1), y[aside], 0.1)
    return Model(*weights, tuple(calibrations), combined)


VIEW = ["text", "lang", "source", "n_chars"]


def _features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_features(t) for t in as_bytes(batch.column("text"))]).reshape(-1, 12 + TRIGRAMS)
    meta = np.array([meta_features(*r) for r in zip(*(batch.column(c).to_pylist() for c in VIEW[1:]), strict=True)]).reshape(-1, 1 + LANGS + SOURCES + SIZES)
    return text, meta


def _with_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` and x: the features of both views, as half-precision numbers."""
    source = docs.select(*dict.fromkeys([*keep, *VIEW]))
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.hstack(_features(batch)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([r.tobytes() for r in x], pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def _unpacked(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the text view and of the metadata view."""
    x = np.frombuffer(b"".join(blobs), np.float16).reshape(len(blobs), -1).astype(float)
    return x[:, : 12 + TRIGRAMS], x[:, 12 + TRIGRAMS :]


def _chooser(pool: DataFrame) -> Choose:
    """Pseudo-labels from all rows (key, x) of `pool`: in each round a pass over it, of which the surest few rows come back."""
    taken: set[int] = set()

    def choose(weights: list[np.ndarray], bad: int, good: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = [x @ w for x, w in zip(_unpacked(batch.column(1).to_pylist()), weights, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, z)], names=["key", "x", "z0", "z1"])

        # 4 * ROUNDS * TAKE keys at most
        left = pool.where(~F.col("key").isin(list(taken))) if taken else pool
        scored = left.mapInArrow(run, "key long, x binary, z0 double, z1 double")
        lists = [scored.where(F.col(f"z{k}") * sign > 0).orderBy(F.col(f"z{k}") * -sign, "key").limit(n).select(F.lit(k).alias("view"), F.lit(float(sign > 0)).alias("label"), "key", "x") for k in (0, 1) for sign, n in ((-1, bad), (1, good))]
        rows = lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[3]).collect()  # 2 * TAKE rows
        taken.update(r.key for r in rows)
        own = [[r for r in rows if r.view == k] for k in (0, 1)]
        return [(*(_unpacked([bytes(r.x) for r in some]) if some else (np.zeros((0, len(w))) for w in weights)), np.array([r.label for r in some])) for some in own]

    return choose


def pool(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(key, x): the features of all rows open to training whose id is not in `known`.

    They are made where texts are read, so that the shuffle by id carries features and never texts, at every size.
    """
    open_ = docs.where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).withColumn("key", F.xxhash64("doc_id", "text"))
    return _with_features(open_, ["doc_id", "key"]).join(known.select("doc_id").hint("merge"), "doc_id", "left_anti").select("key", "x")


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """Train on a bounded sample of labelled rows and all unlabelled ones; the share of good labels if there is only one class."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    counts = known.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good")).first()
    if not 0 < counts["good"] < counts["n"]:
        return counts["good"] / counts["n"] if counts["n"] else 0.5
    rank = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("quality = 1").orderBy(*rank).limit(MAX_PER_CLASS).unionByName(known.where("quality <> 1").orderBy(*rank).limit(MAX_PER_CLASS))
    # 2 * MAX_PER_CLASS rows of two numbers; one row for each id comes back, however many texts it has
    chosen = _with_features(docs.select("doc_id", *VIEW).join(F.broadcast(picked), "doc_id"), ["doc_id", "quality"])
    rows = chosen.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x")).toPandas().sort_values("doc_id")
    if rows["quality"].nunique() < 2:
        return counts["good"] / counts["n"]
    text, meta = _unpacked([bytes(b) for b in rows["x"]])
    # mixed order, so that the rows set aside are like the others
    shuffled = np.random.default_rng(5).permutation(len(rows))
    y = rows["quality"].to_numpy()[shuffled] == 1
    return co_train(text[shuffled], meta[shuffled], y.astype(float), _chooser(written(pool(docs, known))))


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """All columns of `docs`, with text_score, metadata_score and score: probabilities of good quality."""
    names = ["text_score", "metadata_score", "score"]
    kept = [c for c in docs.columns if c not in names]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    shared = source.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shared.value
            found = np.full((batch.num_rows, 3), m) if isinstance(m, float) else m.scores(*_features(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, k]) for k in range(3))], names=[*batch.schema.names, *names])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, text_score, metadata_score, score, predicted (1: good) for every document."""
    scored = score(docs.select("doc_id", *VIEW), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text_score", "metadata_score", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
