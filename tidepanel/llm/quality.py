"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of features x is ``sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))``,
the pairwise interactions of low rank in time linear in the number of features.  Words are hashed into
``WORD_PLACES`` places with damped, length-normalised counts.  Structure statistics and the recorded
number of characters are cut into ``BINS`` steps, one place for each.

The machine is fitted by AdaGrad on at most ``MAX_TRAIN`` labelled documents, the first in the order of
a hash of their ids, so a refit sees the same rows.  The rows left out for evaluation are never in it.
The model is ``(WORD_PLACES + STATISTICS * BINS) * (RANK + 1)`` floats, 2.4 MB, and goes to all workers.

Edge cases: null and empty texts are scored from their statistics; null labels and labels of unknown
documents are not used; of repeated labels and documents one is used (the smaller label, the smaller
text); without labels of both classes every score is the prior; a null id is not held out; an empty
table gives an empty result; columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.lines import repeated_words
from tidepanel.llm.texts import LOWER, WordHashes, as_bytes, bound_batches, word_hashes

WORD_PLACES = 1 << 16
BINS = 12
STATISTICS = 12
RANK = 8
MAX_TRAIN = 4_000
EPOCHS = 6
RATE = 0.1
DECAY = 1e-5
SYMBOLS, DIGITS, STOPS = b"#*$%&|<>", b"0123456789", b".,;:?"
UPPER = bytes(range(65, 91))


def statistics(data: bytes, n_words: int, distinct: int, repeated: int, n_chars: int | None) -> list[float]:
    """Numbers between 0 and 1 that describe how a text is built."""
    size, words = max(1, len(data)), max(1, n_words)
    lines = data.split(b"\n")

    def share(of: bytes) -> float:
        return (len(data) - len(data.translate(None, of))) / size

    return [
        10 * share(SYMBOLS), 2 * share(UPPER), 5 * share(DIGITS), 10 * share(STOPS), 20 * share(b"!"),
        distinct / words, repeated / words, size / words / 16, np.log1p(n_words) / 12, 1 - len(set(lines)) / len(lines),
        len(lines) * 10 / words, np.log1p(n_chars or 0) / 14,
    ]


def features(data: bytes, n_chars: int | None, memo: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    words = word_hashes(data.translate(LOWER), memo)
    places, counts = np.unique((words >> np.uint64(20)).astype(np.int64) & (WORD_PLACES - 1), return_counts=True)
    values = np.log1p(counts)
    norm = np.sqrt((values * values).sum()) or 1.0
    numbers = np.array(statistics(data, len(words), len(places), repeated_words(words), n_chars))
    steps = np.clip((numbers * BINS).astype(np.int64), 0, BINS - 1) + WORD_PLACES + np.arange(STATISTICS) * BINS
    return (np.concatenate([places, steps]).astype(np.int32),
            np.concatenate([values / norm, np.full(STATISTICS, 0.5)]).astype(np.float32))


@dataclass
class Machine:
    """Weights of a fitted factorisation machine."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, places: np.ndarray, values: np.ndarray) -> float:
        parts = self.factors[places] * values[:, None]
        total = parts.sum(axis=0)
        pairs = 0.5 * float((total * total).sum() - (parts * parts).sum())
        z = self.bias + float(self.weights[places] @ values) + pairs
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Fit by AdaGrad over small batches of sparse rows."""
    size = WORD_PLACES + STATISTICS * BINS
    random = np.random.default_rng(seed)
    prior = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    machine = Machine(float(np.log(prior / (1 - prior))), np.zeros(size, np.float32),
                      random.normal(0, 0.02, (size, RANK)).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        machine.factors[:] = 0
        return machine
    w, v = machine.weights, machine.factors
    sum_w, sum_v, sum_b = np.full(size, 1e-3, np.float32), np.full((size, RANK), 1e-3, np.float32), 1e-3
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(rows) // 32)):
            places = np.concatenate([rows[i][0] for i in batch])
            x = np.concatenate([rows[i][1] for i in batch])
            sizes = np.array([len(rows[i][0]) for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            row = np.repeat(np.arange(len(batch)), sizes)
            used, back = np.unique(places, return_inverse=True)
            parts = v[places] * x[:, None]
            total = np.add.reduceat(parts, starts, axis=0)
            z = machine.bias + np.add.reduceat(w[places] * x, starts) + 0.5 * (
                (total * total).sum(axis=1) - np.add.reduceat((parts * parts).sum(axis=1), starts))
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]).astype(np.float32) / len(batch)
            pull = slope[row] * x
            grad_w = np.bincount(back, pull, len(used)).astype(np.float32) + DECAY * w[used]
            step_v = pull[:, None] * (total[row] - parts)
            grad_v = np.stack([np.bincount(back, step_v[:, f], len(used)) for f in range(RANK)], axis=1)
            grad_v = grad_v.astype(np.float32) + DECAY * v[used]
            grad_b = float(slope.sum())
            sum_w[used] += grad_w**2
            sum_v[used] += grad_v**2
            sum_b += grad_b**2
            w[used] -= RATE * grad_w / np.sqrt(sum_w[used])
            v[used] -= RATE * grad_v / np.sqrt(sum_v[used])
            machine.bias -= RATE * grad_b / np.sqrt(sum_b)
    return machine


def held_out(doc_id: Column) -> Column:
    """The third of all ids whose labels are kept for evaluation."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_TRAIN) -> list:
    """At most ``most`` labelled documents as features; collected, since the model is fitted at one place."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = (
        docs.select("doc_id", "text", "n_chars").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("d"))
        .select("doc_id", "label", "d.text", "d.n_chars")
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            found = [features(t or b"", n, memo)
                     for t, n in zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array([a.tobytes() for a, _ in found], pa.binary()),
                 pa.array([b.tobytes() for _, b in found], pa.binary())],
                ["doc_id", "label", "places", "values"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.mapInArrow(extract, f"doc_id {kind}, label int, places binary, values binary").collect()
    return sorted(rows, key=lambda r: r["doc_id"])


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Per row: id, whether its label is held out, the score of label 1 and the class it predicts."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = training_rows(docs, labels, label)
    machine = fit(
        [(np.frombuffer(r["places"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows],
        np.array([r["label"] for r in rows], np.float32),
    )
    shared = spark.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = Machine(*shared.value), WordHashes()
        for batch in batches:
            scores = [model.score(*features(t or b"", n, memo))
                      for t, n in zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "score"])

    read = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "n_chars")
    kind = read.schema["doc_id"].dataType.simpleString()
    scored = read.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
