"""Near-duplicate vectors through product quantisation and inverted lists, with exact cosines at the end.

*Distinct vectors.*  Rows of one label with equal components are one vector with a count, made before
anything else, so a group of exact copies is one vector in every later step.

*Index.*  Vectors are scaled to length one.  Coarse centroids and, for each of ``PARTS`` subspaces, 256
code words of the residuals are fitted on at most ``SAMPLE`` vectors (chosen by hash); all vectors are
indexed.  A vector lies in the list of its nearest centroid, with the codes of its residual and the
distance from its reconstruction, which the codes leave out.

*Probes.*  A vector y within the angle of the limit lies in list b only if it is nearer to b than to the
vector's own centroid a.  The step from x to y has length tan(angle) across x; a random direction has a
component of about ``|b - a| / sqrt(d - 1)`` of it along b - a.  A vector probes every list that ``SAFETY``
such deviations reach; with sqrt(d - 1) deviations the bound holds for every direction.  A pair is
looked up once, by the vector in the lower list.

*Table look-up.*  The distance of a vector from a reconstruction is summed from its table of distances to
the code words.  By the triangle inequality the true distance is at least that less the distance from
the reconstruction; pairs that this keeps within the limit are compared by exact cosine in doubles.  The
look-up therefore loses no pair of a probed list.

*Tasks.*  A list is dealt into pieces of about ``PIECE`` vectors by hash, its probing vectors likewise, and one
Python group compares one piece with one piece.  No label, list or group of near copies meets in one
task.  A group of vectors returns link counts per vector and the edges of a spanning forest, never its
pairs.

Results: links are counted exactly among the pairs found; a component is what links reach.  Edge cases:
null labels, null vectors, vectors of zeros and vectors with a null or non-finite component link with
nothing; vectors of different lengths do not link; repeated rows link with each other; a null id is the
smallest of a component only if all ids are null; an empty table gives an empty result; columns besides
the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.graph import components
from tidepanel.llm.texts import bound_batches
from tidepanel.session import cut_lineage

LIMIT = 0.93
SAMPLE = 1 << 16
MOST_LISTS = 1 << 12
PARTS, WORDS = 16, 256
SAFETY = 4.0
PIECE = 2048
ROUNDS = 8
SLACK = 1e-5


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ centres.T).argmin(axis=1) for i in range(0, len(x), 4096)])


def fit_centres(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """At most ``k`` centres of the rows by Lloyd's rounds from random distinct rows."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(ROUNDS if len(distinct) > k else 0):
        at = _nearest(x, centres)
        counts = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Index:
    """Coarse centroids and residual code words for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.width = sample.shape[1]
        self.coarse = fit_centres(sample, lists)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.cuts = np.linspace(0, self.width, min(PARTS, self.width) + 1).astype(int)
        self.words = [fit_centres(rest[:, a:b], WORDS) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def parts(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b, words in zip(self.cuts, self.cuts[1:], self.words, strict=False):
            yield x[:, a:b], words

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and distance from the reconstruction of each row."""
        at = _nearest(x, self.coarse)
        rest = x - self.coarse[at]
        codes = np.stack([_nearest(part, words) for part, words in self.parts(rest)], axis=1)
        apart = sum(((part - words[c]) ** 2).sum(axis=1) for (part, words), c in zip(self.parts(rest), codes.T, strict=True))
        return at, codes.astype(np.uint8), np.sqrt(apart)

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of each row's residual to the code words of list ``at``, by part."""
        out = np.zeros((len(self.words), len(x), WORDS))
        for p, (part, words) in enumerate(self.parts(x - self.coarse[at])):
            out[p, :, : len(words)] = (part * part).sum(axis=1)[:, None] - 2 * part @ words.T + (words * words).sum(axis=1)
        return out

    def probes(self, x: np.ndarray, at: np.ndarray, limit: float, safety: float) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each probe; a row probes its own list and later ones."""
        tangent = np.sqrt(1 / limit**2 - 1)
        reach = tangent * min(safety / np.sqrt(max(self.width - 1, 1)), 1.0)
        half = (self.coarse * self.coarse).sum(axis=1) / 2
        near = x @ self.coarse.T
        # y is nearer to b than to a when y (b - a) > (|b|^2 - |a|^2) / 2, with y = limit (x + step)
        need = half[None, :] / limit - near - (half[at] / limit - near[np.arange(len(x)), at])[:, None]
        apart = 2 * (half[None, :] + half[at][:, None] - self.coarse[at] @ self.coarse.T)
        ok = need <= reach * np.sqrt(np.maximum(apart, 0)) + SLACK
        ok[np.arange(len(x)), at] = True
        ok &= np.arange(len(self.coarse))[None, :] >= at[:, None]
        return np.nonzero(ok)


def distinct_vectors(vectors: DataFrame, vec_id: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows with the number of their vector (null: links with nothing), and the distinct vectors."""
    read = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                          F.col(vector).cast("array<double>").alias("x"))
    usable = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(
        "x", lambda v: v != 0)
    rows = cut_lineage(read.select(
        "vec_id", F.when(F.col("label").isNotNull() & F.col("x").isNotNull() & usable,
                         F.xxhash64("label", F.size("x"), F.transform("x", lambda v: v + 0.0))).alias("vector"), "label", "x"))
    held = rows.where("vector is not null").groupBy("vector").agg(
        F.first("label").alias("label"), F.first("x").alias("x"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    return rows.select("vec_id", "vector"), cut_lineage(held)


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of one length and their forms of length one; large components are scaled down first."""
    x = column.flatten().to_numpy().reshape(len(column), -1)
    scaled = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x, scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _fit(held: DataFrame, total: int) -> Index:
    """The index of vectors of one length, fitted on at most about ``SAMPLE`` of them."""
    share = min(1.0, SAMPLE / max(total, 1))
    line = int(share * 2**30)
    sample = held.where(F.pmod(F.xxhash64("vector"), F.lit(2**30)) < line).select("vector", "x").orderBy("vector").toArrow()
    if not sample.num_rows:
        sample = held.orderBy("vector").limit(1).select("vector", "x").toArrow()
    _, units = _units(sample.column("x").combine_chunks())
    lists = int(min(MOST_LISTS, max(1, np.sqrt(total)), max(1, len(units) // 4)))
    return Index(units, lists)


def entries(held: DataFrame, index, limit: float, safety: float) -> DataFrame:
    """``vector, label, x, copies, list, codes, apart, probes`` of each distinct vector."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                _, units = _units(part.column(2))
                which, codes, apart = known.encode(units)
                row, probe = known.probes(units, which, limit, safety)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(units)))])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(which, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(apart, pa.float64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(probe, pa.int32()))],
                    ["vector", "label", "x", "copies", "list", "codes", "apart", "probes"])

    return held.select("vector", "label", "x", "copies").mapInArrow(
        scan, "vector long, label long, x array<double>, copies long, list int, codes binary, apart double, probes array<int>")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the given links between n vectors."""
    parent = np.arange(n)
    while True:
        a, b = parent[left], parent[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    at = np.flatnonzero(parent != np.arange(n))
    return at, parent[at]


def compare(index: Index, at: int, posted: pa.Table, probing: pa.Table, limit: float) -> pa.Table:
    """Link counts and a spanning forest of the links between two pieces of one list's vectors."""
    y, y_unit = _units(posted.column("x").combine_chunks())
    x, x_unit = _units(probing.column("x").combine_chunks())
    names = (probing.column("vector").to_numpy(), posted.column("vector").to_numpy())
    copies = (probing.column("copies").to_numpy(), posted.column("copies").to_numpy())
    home = probing.column("list").to_numpy()
    codes = np.frombuffer(b"".join(posted.column("codes").to_pylist()), np.uint8).reshape(len(y), -1)
    apart = posted.column("apart").to_numpy()
    furthest = np.sqrt(2 - 2 * limit) + apart + SLACK
    links = (np.zeros(len(x), np.int64), np.zeros(len(y), np.int64))
    left, right = [], []
    for s in range(0, len(x), 128):
        part = slice(s, s + 128)
        tables = index.tables(x_unit[part], at)
        squared = sum(table[:, codes[:, p]] for p, table in enumerate(tables))
        i, j = np.nonzero(squared <= furthest[None, :] ** 2)
        i += s
        once = (home[i] != at) | (names[0][i] < names[1][j])
        i, j = i[once], j[once]
        for c in range(0, len(i), 1 << 16):
            u, v = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
            close = np.einsum("ij,ij->i", x_unit[u], y_unit[v]) >= limit
            u, v = u[close], v[close]
            np.add.at(links[0], u, copies[1][v])
            np.add.at(links[1], v, copies[0][u])
            if len(u):
                a, b = _forest(len(x) + len(y), u, v + len(x))
                left.append(a)
                right.append(b)
    both = np.concatenate(names)
    counted = [(names[k][links[k] > 0], links[k][links[k] > 0]) for k in (0, 1)]
    a, b = _forest(len(both), np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int),) * 2
    # a vector in both pieces of its own list is one vector
    return pa.table({
        "a": np.concatenate([counted[0][0], counted[1][0], both[a]]),
        "b": pa.array(np.concatenate([np.zeros(sum(len(c[0]) for c in counted), np.int64), both[b]]), pa.int64(),
                      mask=np.arange(sum(len(c[0]) for c in counted) + len(a)) < sum(len(c[0]) for c in counted)),
        "n": np.concatenate([counted[0][1], counted[1][1], np.zeros(len(a), np.int64)]),
    })


def _pieces(rows: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """Rows with their own piece of a list, once for each piece of the other side."""
    joined = rows.join(sizes, ["label", "list_no"])
    mine = F.pmod(F.xxhash64("vector", F.lit(own)), F.col(own)).cast("int")
    return joined.withColumn(f"{own}_piece", mine).withColumn(f"{other}_piece", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))


def link_vectors(held: DataFrame, limit: float, safety: float, index: Index) -> DataFrame:
    """``a, n`` link counts and ``a, b`` edges (n = 0) of the distinct vectors of one length."""
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast(index)
    indexed = cut_lineage(entries(held, shared, limit, safety))
    probing = indexed.select("vector", "label", "x", "copies", "list", F.explode("probes").alias("list_no"))
    posted = indexed.select("vector", "label", "x", "copies", "codes", "apart", F.col("list").alias("list_no"))
    sizes = posted.groupBy("label", "list_no").count().withColumnRenamed("count", "mine").join(
        probing.groupBy("label", "list_no").count(), ["label", "list_no"])
    sizes = cut_lineage(sizes.select(
        "label", "list_no", F.ceil(F.col("mine") / PIECE).cast("int").alias("posted"),
        F.ceil(F.col("count") / PIECE).cast("int").alias("probing")))
    both = _pieces(posted.withColumn("list", F.lit(None).cast("int")), sizes, "posted", "probing").unionByName(
        _pieces(probing, sizes, "probing", "posted"), allowMissingColumns=True)

    def task(rows: pa.Table) -> pa.Table:
        probes = rows.column("list").is_valid()
        left, right = rows.filter(pc.invert(probes)), rows.filter(probes)
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        return compare(shared.value, left.column("list_no")[0].as_py(), left, right, limit)

    return both.groupBy("label", "list_no", "posted_piece", "probing_piece").applyInArrow(task, "a long, b long, n long")


def similar_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    limit: float = LIMIT, safety: float = SAFETY) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row."""
    bound_batches(vectors.sparkSession)
    rows, held = distinct_vectors(vectors, vec_id, vector, label)
    found = None
    for width, total in sorted(tuple(r) for r in held.groupBy(F.size("x")).count().collect()):
        alike = held.where(F.size("x") == width)
        part = link_vectors(alike, limit, safety, _fit(alike, total))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.lit(True).alias("kept"))
    found = cut_lineage(found)
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "vector")
    roots = components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "vector")
    named = cut_lineage(held.select("vector", "copies", "least").join(links, "vector", "left").join(roots, "vector", "left").select(
        "vector", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("root", "vector").alias("root")))
    smallest = named.groupBy("root").agg(F.min("least").alias("smallest"))
    labels = named.join(smallest, "root").select("vector", "n_links", "smallest")
    joined = rows.join(labels, "vector", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("smallest").isNotNull(), F.col("smallest")).otherwise(F.col("vec_id")).alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
