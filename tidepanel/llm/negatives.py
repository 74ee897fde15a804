"""Hard negatives by exact integer inner products of anchors with all rows.

*Vectors.*  Components become ``floor(256 x)`` as longs.  Where an id is divisible by 7 the label moves
on by one of ten (planted noise); anchors are the rows whose id is divisible by 50.

*Tiles.*  Anchors are a stated query set.  They go to all workers in groups of at most ``GROUP`` rows (a
bound on what is sent), and the rows stay where they are: a task multiplies the group by each tile of
its rows.  No row is shuffled, so a label or a copy group that holds a third of all rows is no skew.

*Multiplication.*  Tiles are multiplied by Strassen's recursion: seven products of half-size blocks,
joined by sums and differences of longs.  Odd sizes are padded with zeros at each level; blocks below
``LEAF`` are multiplied directly.  Sums of longs are exact; when a step runs over, it runs over in
the ring of 64-bit numbers, in which the result is still right if it fits a long itself.

*Heaps.*  The first scan keeps each anchor's best rows of its own label.  Its scores set the windows, and
the second scan keeps the best rows of other labels within each positive's window.  A heap is the k best
(score, id) so far, so two heaps merge by keeping the k best of both: blocks merge into the task's heap,
and tasks' heaps merge per (anchor, salt) and then per anchor, never all in one group.

Edge cases: null labels, null vectors and vectors with a null or non-finite component take no part; an
empty vector is a vector of zeros; shorter vectors are filled up with zeros; a component whose 256-fold
does not fit a long is cut to it, and products beyond a long wrap as Spark's do.  Ties are ordered by
ascending id, null last.  A null id is never an anchor but can be an answer.  Rows with the anchor's own
id are the anchor and no other row; other repeated rows count each.  An anchor without rows of its label,
or a positive without rows in its window, gives no row; a negative positive score has an empty window.
An empty table gives an empty result.  Columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.texts import bound_batches
from tidepanel.session import cut_lineage

NOISE, LABELS, ANCHORS = 7, 10, 50
POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score, in hundredths of the positive's score.
LOWEST, HIGHEST = 50, 95
GROUP = 16_384
TILE = 1024
LEAF = 16
SALTS = 64
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two matrices of longs."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    odd = (m & 1, k & 1, n & 1)
    if any(odd):
        a, b = np.pad(a, ((0, odd[0]), (0, odd[1]))), np.pad(b, ((0, odd[1]), (0, odd[2])))
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * r, 2 * t), np.int64)
    c[:r, :t] = p1 + p4 - p5 + p7
    c[:r, t:] = p3 + p5
    c[r:, :t] = p2 + p4
    c[r:, t:] = p1 - p2 + p3 + p6
    return c[:m, :n]


class Heap:
    """The k best (score, id) of each of ``n`` owners; ``_NONE`` marks a free place."""

    def __init__(self, n: int, k: int):
        self.score, self.name = np.full((n, k), _NONE), np.zeros((n, k), np.int64)
        self.known = np.zeros((n, k), bool)

    def add(self, scores: np.ndarray, names: np.ndarray, known: np.ndarray) -> None:
        """Merge a tile's scores; its columns are in the order of ids, so the first of equals is the best."""
        k = self.score.shape[1]
        owners = np.flatnonzero((scores > _NONE).any(axis=1) & (scores.max(axis=1, initial=_NONE) >= self.score[:, -1]))
        if not len(owners):
            return
        scores = scores[owners]
        best, column = [], []
        for _ in range(min(k, scores.shape[1])):
            at = scores.argmax(axis=1)
            best.append(scores[np.arange(len(owners)), at])
            column.append(at)
            scores[np.arange(len(owners)), at] = _NONE
        best, column = np.stack(best, axis=1), np.stack(column, axis=1)
        score = np.concatenate([self.score[owners], best], axis=1)
        name = np.concatenate([self.name[owners], names[column]], axis=1)
        have = np.concatenate([self.known[owners], known[column]], axis=1)
        order = _order(score, name, have)[:, :k]
        self.score[owners] = np.take_along_axis(score, order, axis=1)
        self.name[owners] = np.take_along_axis(name, order, axis=1)
        self.known[owners] = np.take_along_axis(have, order, axis=1)


def _order(score: np.ndarray, name: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Columns of each row, highest score first, then known ids ascending."""
    return np.lexsort((name, ~known, ~score), axis=1)


def prepared(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """``vec_id, label, x`` of the rows that take part."""
    read = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                          F.col(vector).cast("array<double>").alias("x"))
    usable = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    moved = F.when(F.col("vec_id") % NOISE == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return read.where(F.col("label").isNotNull() & F.col("x").isNotNull() & usable).select(
        "vec_id", moved.alias("label"), F.transform("x", lambda v: F.floor(v * 256).cast("long")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, filled up or cut to ``width``: a component without partner adds nothing."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    for i, row in enumerate(np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else ()):
        out[i, : min(len(row), width)] = row[:width]
    return out


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Tiles of at most ``TILE`` rows: ids, which are known, labels, vectors; in the order of ids."""
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            names = part.column(0).fill_null(0).to_numpy()
            order = np.lexsort((names, ~known))
            x = _matrix(part.column(2), width)
            yield names[order], known[order], part.column(1).to_numpy()[order], x[order]


def _scan(rows: DataFrame, group, heaps: Callable, feed: Callable, schema: str) -> DataFrame:
    """Each task's heaps over its rows, ``feed`` merging a tile's products into them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = group.value
        kept = heaps(anchors)
        for names, known, labels, x in _tiles(batches, anchors["x"].shape[1]):
            feed(anchors, kept, names, known, labels, x)
        for part in kept:
            owner, place = np.nonzero(part.score > _NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.owner[owner]), pa.array(part.name[owner, place], pa.int64(), mask=~part.known[owner, place]),
                 pa.array(part.score[owner, place])], ["owner", "found", "score"])

    return rows.mapInArrow(scan, schema)


def _positive_heaps(anchors: dict) -> list[Heap]:
    heap = Heap(len(anchors["name"]), POSITIVES)
    heap.owner = np.arange(len(anchors["name"]), dtype=np.int64)
    return [heap]


def _feed_positives(anchors, kept, names, known, labels, x) -> None:
    """Products of the anchors and rows of each label; anchors are in the order of labels."""
    heap = kept[0]
    for value in np.unique(labels):
        first, last = (int(np.searchsorted(anchors["label"], value, side=s)) for s in ("left", "right"))
        at = np.flatnonzero(labels == value)
        for start in range(first, last, TILE):
            stop = min(start + TILE, last)
            scores = strassen(anchors["x"][start:stop], x[at].T)
            scores[(anchors["name"][start:stop, None] == names[None, at]) & known[None, at]] = _NONE
            view = _part(heap, start, stop)
            view.add(scores, names[at], known[at])


def _part(heap: Heap, start: int, stop: int) -> Heap:
    """A view of some owners' heaps."""
    view = Heap.__new__(Heap)
    view.score, view.name, view.known = heap.score[start:stop], heap.name[start:stop], heap.known[start:stop]
    return view


def _window_heaps(anchors: dict) -> list[Heap]:
    n, places = anchors["least"].shape
    kept = []
    for p in range(places):
        heap = Heap(n, NEGATIVES)
        heap.owner = np.arange(n, dtype=np.int64) * POSITIVES + p
        kept.append(heap)
    return kept


def _feed_negatives(anchors, kept, names, known, labels, x) -> None:
    """Products of the anchors and rows of other labels, for the window of each positive."""
    for start in range(0, len(anchors["name"]), TILE):
        stop = min(start + TILE, len(anchors["name"]))
        scores = strassen(anchors["x"][start:stop], x.T)
        scores[anchors["label"][start:stop, None] == labels[None, :]] = _NONE
        for p, heap in enumerate(kept):
            least, most = anchors["least"][start:stop, p, None], anchors["most"][start:stop, p, None]
            inside = np.where((scores >= least) & (scores <= most), scores, _NONE)
            _part(heap, start, stop).add(inside, names, known)


def _merged(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each owner over all tasks, in two steps."""

    def best(df: DataFrame, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("found"))
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    few = best(rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), "owner", "salt")
    return best(few, "owner").drop("salt")


def _group(rows: list) -> dict:
    """A group of anchors as arrays in the order of labels."""
    width = max([1, *(len(r["x"]) for r in rows)])
    x = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r["x"])] = r["x"]
    label = np.array([r["label"] for r in rows], np.int64)
    order = np.argsort(label, kind="stable")
    return {"name": np.array([r["vec_id"] for r in rows], np.int64)[order], "label": label[order], "x": x[order]}


def hard_negatives(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = prepared(vectors, vec_id, vector, label)
    anchors = cut_lineage(rows.where(F.col("vec_id") % ANCHORS == 0).withColumn("at", F.monotonically_increasing_id()))
    groups = max(1, -(-anchors.count() // GROUP))
    parts = []
    for g in range(groups):
        own = _group(anchors.where(F.pmod(F.xxhash64("at"), F.lit(groups)) == g).orderBy("vec_id", "at").collect())
        schema = "owner long, found long, score long"
        first = cut_lineage(_merged(
            _scan(rows, spark.sparkContext.broadcast(own), _positive_heaps, _feed_positives, schema), POSITIVES))
        n = len(own["name"])
        least, most = np.ones((n, POSITIVES), np.int64), np.zeros((n, POSITIVES), np.int64)
        for r in first.select("owner", "rank", "score").toLocalIterator():
            # 100 s >= LOWEST p and 100 s <= HIGHEST p, for whole numbers s
            least[r["owner"], r["rank"] - 1] = -(-LOWEST * r["score"] // 100)
            most[r["owner"], r["rank"] - 1] = HIGHEST * r["score"] // 100
        asked = spark.sparkContext.broadcast(own | {"least": least, "most": most})
        second = _merged(_scan(rows, asked, _window_heaps, _feed_negatives, schema), NEGATIVES)
        positives = first.select(
            (F.col("owner") * POSITIVES + F.col("rank") - 1).alias("owner"), F.col("found").alias("positive_id"),
            F.col("score").alias("positive_score"), F.col("owner").alias("anchor"))
        names = spark.createDataFrame(
            [(i, int(v)) for i, v in enumerate(own["name"])], "anchor long, anchor_id long")
        parts.append(
            second.join(positives, "owner").join(names, "anchor").select(
                "anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
