"""Ranked lexical search, term at a time, with a limit on new accumulators.

*Scores* are integers: a term has a weight from its document frequency, and a document adds
``weight * ((10^9 tf) div (1000 tf + 20 m))`` for each term of the query, m being its length measure.

*Statistics.*  One scan counts the documents with terms, all terms and the document frequency of each
query term, as one row a task and term.

*Term at a time.*  A second scan deals with documents in blocks (an Arrow batch).  A block's postings of
the query terms are sorted by term.  For each query the terms are taken rarest first.  A posting opens
an accumulator for its document or adds to it.  The largest contribution of each term in the block
bounds what the remaining terms can still add; once their sum is below the kth best partial score, a
document without an accumulator cannot enter the answer, so none is opened any more.  The accumulators
that exist are updated to their exact scores.  A task carries each query's k best results from block to
block, so the kth score rises and later blocks close their accumulators sooner.

*Merging.*  A task returns at most k rows a query; they are merged per (query, salt) and then per query,
so no group grows with the number of tasks.

*Bounds.*  Queries are dealt into blocks of about ``BLOCK_TERMS`` terms and ``BLOCK_QUERIES`` queries; a block's terms
and weights go to all workers, and each block is one pair of scans over all documents.  A worker holds
one Arrow batch (bounded in bytes) and k results for each query of the block.  A common term is no
skew, because documents stay where they are.

Edge cases: null and empty texts have no terms and are in no result; a query without terms has none
either; a very long text is split in slices and counted whole; equal scores are ordered by ascending id
(null last), and repeated rows are ranked one by one; repeated query rows are answered one by one; an
empty table of documents or queries gives an empty result; columns besides the named ones are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.texts import as_bytes, bound_batches, pieces
from tidepanel.session import cut_lineage

TOP = 50
BLOCK_TERMS = 1 << 20
BLOCK_QUERIES = 4096
SALTS = 64
#: Rows of the statistics that are not terms.
DOCUMENTS, LENGTH = -1, -2

_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(data: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice."""
    if data:
        for part in pieces(data.translate(_TERMS)):
            yield part.split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id, terms`` of each query with its distinct terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({w for part in words(data) for w in part}) for data in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item_id", "terms"])

    bound_batches(items.sparkSession)
    read = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return read.mapInArrow(scan, "item_id long, terms array<binary>")


def statistics(docs: DataFrame, text: str, vocabulary) -> dict[int, int]:
    """Documents holding each term of the vocabulary, all documents with terms, and all terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: i for i, term in enumerate(vocabulary.value)}
        wanted, seen, total = frozenset(number), Counter(), Counter()
        for batch in batches:
            for data in as_bytes(batch.column(0)):
                held, n = set(), 0
                for part in words(data):
                    n += len(part)
                    held |= wanted.intersection(part)
                seen.update(held)
                total[LENGTH] += n
                total[DOCUMENTS] += n > 0
        counts = {number[t]: c for t, c in seen.items()} | dict(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    read = docs.select(F.col(text).alias("text")).where("text is not null")
    rows = read.mapInArrow(scan, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist(), strict=True))


class Best:
    """The k best (score, id) of one query, best first; a null id comes last among equals."""

    def __init__(self, k: int):
        self.k, self.score, self.name, self.missing = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def kth(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, name: np.ndarray, missing: np.ndarray) -> None:
        score, name = np.concatenate([self.score, score]), np.concatenate([self.name, name])
        missing = np.concatenate([self.missing, missing])
        order = np.lexsort((name, missing, -score))[: self.k]
        self.score, self.name, self.missing = score[order], name[order], missing[order]


def accumulate(postings: list[tuple[np.ndarray, np.ndarray]], size: int, best: Best) -> np.ndarray:
    """Scores of a block's documents for one query; its terms' postings come rarest first.

    Scores that can enter the answer are exact.  Other documents have a partial score below the kth
    best one, or none.
    """
    scores = np.zeros(size, np.int64)
    remaining = np.cumsum([int(added.max()) for _, added in postings][::-1])[::-1] if postings else []
    least, survivors = best.kth(), None
    for (where, added), bound in zip(postings, remaining, strict=True):
        if survivors is None:
            if size >= best.k and bound < scores.max():
                least = max(least, int(np.partition(scores, size - best.k)[size - best.k]))
            if bound < least:
                survivors = np.flatnonzero(scores)
        if survivors is None:
            scores[where] += added
        else:
            at = np.minimum(np.searchsorted(where, survivors), len(where) - 1)
            known = where[at] == survivors
            scores[survivors[known]] += added[at[known]]
    return scores


def answer(docs: DataFrame, doc_id: str, text: str, block) -> DataFrame:
    """``place, item_id, doc_id, score``: each task's best documents for each query of the block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, weights, queries, documents, length, k = block.value
        number = {term: i for i, term in enumerate(vocabulary)}
        best = [Best(k) for _ in queries]
        for batch in batches:
            names = batch.column(0).fill_null(0).to_numpy()
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            term, where, often, measure = [], [], [], []
            for i, data in enumerate(as_bytes(batch.column(1))):
                counts, n = Counter(), 0
                for part in words(data):
                    n += len(part)
                    counts.update(map(number.get, part))
                counts.pop(None, None)
                measure.append(50 + 50 * n * documents // length)
                term.extend(counts)
                often.extend(counts.values())
                where.extend([i] * len(counts))
            if not term:
                continue
            term, where = np.array(term, np.int64), np.array(where, np.int64)
            tf, m = np.array(often, np.int64), np.array(measure, np.int64)[where]
            order = np.lexsort((where, term))
            term, where, tf, m = term[order], where[order], tf[order], m[order]
            added = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            starts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            ends = np.append(starts[1:], len(term))
            lists = {int(term[s]): (where[s:e], added[s:e]) for s, e in zip(starts, ends, strict=True)}
            for (_, wanted), kept in zip(queries, best, strict=True):
                scores = accumulate([lists[t] for t in wanted if t in lists], len(names), kept)
                found = np.flatnonzero(scores >= max(kept.kth(), 1))
                if len(found):
                    kept.add(scores[found], names[found], missing[found])
        for place, ((item, _), kept) in enumerate(zip(queries, best, strict=True)):
            n = len(kept.score)
            yield pa.RecordBatch.from_arrays(
                [pa.array([place] * n, pa.int32()), pa.array([item] * n, pa.int64()),
                 pa.array(kept.name, pa.int64(), mask=kept.missing), pa.array(kept.score, pa.int64())],
                ["place", "item_id", "doc_id", "score"])

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    return read.mapInArrow(scan, "place int, item_id long, doc_id long, score long")


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each query, best first."""
    spark = docs.sparkSession
    prepared = cut_lineage(query_terms(items, item_id, item_text).where(F.size("terms") > 0).withColumn(
        "at", F.monotonically_increasing_id()))
    size = prepared.agg(F.count("*").alias("queries"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    blocks = max(1, -(-size["terms"] // BLOCK_TERMS), -(-size["queries"] // BLOCK_QUERIES))
    parts = []
    for b in range(blocks):
        asked = prepared.where(F.pmod(F.xxhash64("at"), F.lit(blocks)) == b).orderBy("at").collect()
        vocabulary = sorted({bytes(t) for row in asked for t in row["terms"]})
        counts = statistics(docs, text, spark.sparkContext.broadcast(vocabulary))
        documents, length = counts.get(DOCUMENTS, 0), counts.get(LENGTH, 0)
        weights = np.array([weight(documents, counts.get(i, 0)) for i in range(len(vocabulary))], np.int64)
        number = {term: i for i, term in enumerate(vocabulary)}
        queries = []
        for row in asked:
            held = [t for t in (number[bytes(w)] for w in row["terms"]) if t in counts and weights[t] > 0]
            queries.append((row["item_id"], sorted(held, key=lambda t: (counts[t], t))))
        block = spark.sparkContext.broadcast((vocabulary, weights, queries, documents, max(length, 1), k))
        parts.append(answer(docs, doc_id, text, block).withColumn("block", F.lit(b)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    few = _ranked(rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), ["block", "place", "salt"], k)
    return _ranked(few, ["block", "place"], k).select("item_id", "rank", "doc_id", "score")
