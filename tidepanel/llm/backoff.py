"""Stupid-backoff language-model scores from count tables partitioned by hash.

The model is the corpus itself.  A word c after a, b scores ``f(abc)/f(ab)`` if the trigram was seen,
else ``0.4 * f(bc)/f(b)`` if the bigram was, else ``0.16 * f(c)/N``; f never counts the document that is
scored, so a document is not its own evidence.  A word seen nowhere else counts as half a word.

The relations are (n-gram, chunk, count), grouped by n-gram into the count table, joined back to the
n-grams of each chunk and summed per document.  A row for each n-gram would move several times the
corpus, so relations are stored by column: a chunk is a few thousand documents of one task, and for
each order and hash range it sends one value with its sorted distinct n-gram hashes and one with their
counts.  A range's task adds the counts of equal n-grams over all chunks, which is the count table of
that range, and joins it to each chunk's n-grams: the answer is a value with the table's count for each
n-gram of the chunk, in the same order.  Chunk and answers meet again, with the texts sent compressed
to the same place, and each document's words are looked up and summed there.

Hashes are uniform, so a frequent n-gram is one entry per chunk and ranges are even.  The number of
ranges grows with the corpus (``TOKENS_A_RANGE``), which bounds a task's memory.

Words are runs without ASCII white space, ASCII letters in lower case; n-grams are compared by 56-bit
hashes, of which a table of 1e9 n-grams shares about seven.  Edge
cases: null and empty texts have no words and a null score; the first words of a text start from the
orders they have; repeated documents are evidence for each other; an empty table gives an empty
result; columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.mixing import word_count
from tidepanel.llm.texts import KEY, LOWER, WordHashes, gram_hashes, keyed, word_hashes

ORDER = 3
BACKOFF = 0.4
UNSEEN = 0.5
CHUNK_BYTES = 6 << 20
CHUNK_ROWS = 4_000
ID_BITS = 56
TOKENS_A_RANGE = 1 << 20
LEAST_RANGES = 256


def planes(values: np.ndarray) -> bytes:
    """Numbers by byte planes, so that a general compressor sees runs of equal high bytes."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(kind).ravel()


def packed_hashes(sorted_values: np.ndarray) -> bytes:
    return planes(np.diff(sorted_values, prepend=np.uint64(0)))


def unpacked_hashes(blob: bytes) -> np.ndarray:
    return np.cumsum(from_planes(blob, np.uint64), dtype=np.uint64)


def gram_ids(words: np.ndarray, size: int) -> np.ndarray:
    """n-grams by the first ``ID_BITS`` of their hashes."""
    return gram_hashes(words, size) >> np.uint64(64 - ID_BITS)


def range_starts(ranges: int) -> np.ndarray:
    """The first id of each range; ``ranges`` is a power of two."""
    return np.arange(ranges, dtype=np.uint64) << np.uint64(ID_BITS - ranges.bit_length() + 1)


def chunk_grams(words: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of a chunk's documents, and their counts."""
    return np.unique(np.concatenate([gram_ids(w, order) for w in words]), return_counts=True)


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """Rows (key, id, text) in chunks that end at a number of bytes or rows.

    A chunk is named by the file and row of its first document.  Where it ends depends on its
    documents alone, so both scans and a repeated task cut the same chunks.
    """
    held, size, count = [], 0, 0

    def sealed() -> tuple[str, pa.Table]:
        table = pa.Table.from_batches(held)
        return f"{table.column(0)[0].as_py()}:{table.column(1)[0].as_py()}", table

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(3)), 0).to_pylist()
        start = 0
        for i, n in enumerate(sizes, 1):
            size += n
            count += 1
            if size >= CHUNK_BYTES or count >= CHUNK_ROWS:
                held.append(batch.slice(start, i - start))
                yield sealed()
                held, size, count, start = [], 0, 0, i
        if start < len(sizes):
            held.append(batch.slice(start))
    if held:
        yield sealed()


def bodies(rows: DataFrame) -> DataFrame:
    """``chunk, body``: the compressed rows of each chunk."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zipped = zstandard.ZstdCompressor(level=3)
        for name, table in chunk_rows(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([zipped.compress(sink.getvalue().to_pybytes())])], ["chunk", "body"])

    return rows.mapInArrow(scan, "chunk string, body binary")


def opened(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all()


def body_words(table: pa.Table, memo: WordHashes) -> list[np.ndarray]:
    texts = table.column(3).cast(pa.binary()).to_pylist()
    return [word_hashes((t or b"").translate(LOWER), memo) for t in texts]


def gram_counts(rows: DataFrame, ranges: int, order: int) -> DataFrame:
    """``place, size, chunk, grams, counts``: each chunk's n-grams of every order by hash range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, edges = WordHashes(), range_starts(ranges)
        for name, table in chunk_rows(batches):
            words = body_words(table, memo)
            for size in range(1, order + 1):
                grams, counts = chunk_grams(words, size)
                cuts = np.searchsorted(grams, edges[1:])
                parts = [(i, g, c) for i, (g, c) in enumerate(
                    zip(np.split(grams, cuts), np.split(counts.astype(np.uint32), cuts), strict=True)) if len(g)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _, _ in parts], pa.int64()), pa.array([size] * len(parts), pa.int32()),
                     pa.array([name] * len(parts), pa.string()),
                     pa.array([packed_hashes(g) for _, g, _ in parts], pa.binary()),
                     pa.array([planes(c) for _, _, c in parts], pa.binary())],
                    ["place", "size", "chunk", "grams", "counts"])

    return rows.mapInArrow(scan, "place long, size int, chunk string, grams binary, counts binary")


def joined_counts(counted: DataFrame) -> DataFrame:
    """``chunk, place, size, totals``: the count table of each range, joined to each chunk's n-grams."""

    def join(table: pa.Table) -> pa.Table:
        grams = [unpacked_hashes(b) for b in table.column("grams").to_pylist()]
        counts = [from_planes(b, np.uint32) for b in table.column("counts").to_pylist()]
        _, back = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(back, np.concatenate(counts))[back].astype(np.uint64)
        cuts = np.cumsum([len(g) for g in grams])[:-1]
        answers = [planes(t) for t in np.split(totals, cuts)]
        return pa.table({"chunk": table.column("chunk"), "place": table.column("place"), "size": table.column("size"),
                         "totals": pa.array(answers, pa.binary())})

    return counted.groupBy("place", "size").applyInArrow(
        join, "chunk string, place long, size int, totals binary")


def chunk_scores(words: list[np.ndarray], totals: list[np.ndarray], all_words: int) -> list[tuple[float | None, list[int]]]:
    """Per document: sum of log scores, and how many words each order answered, lowest order first.

    ``totals`` has the table's count of each distinct n-gram of the chunk, by order.
    """
    orders = len(totals)
    elsewhere: list[list[np.ndarray]] = []
    for size, total in enumerate(totals, 1):
        parts = [gram_ids(w, size) for w in words]
        lengths = np.array([len(p) for p in parts])
        distinct, back = np.unique(np.concatenate(parts), return_inverse=True)
        if len(distinct) != len(total):
            raise ValueError("a chunk differs between two scans of the documents")
        mine = back + np.repeat(np.arange(len(parts)) * max(1, len(distinct)), lengths)
        _, own, times = np.unique(mine, return_inverse=True, return_counts=True)
        elsewhere.append(np.split(total[back].astype(np.int64) - times[own], np.cumsum(lengths)[:-1]))
    out: list[tuple[float | None, list[int]]] = []
    for i, w in enumerate(words):
        n = len(w)
        if not n:
            out.append((None, [0] * orders))
            continue
        score = np.maximum(elsewhere[0][i], UNSEEN) / max(1, all_words - n) * BACKOFF ** (orders - 1)
        answered = np.ones(n, np.int64)
        for size in range(2, orders + 1):
            seen = elsewhere[size - 1][i]
            hit = np.flatnonzero(seen > 0)
            at = hit + size - 1
            score[at] = seen[hit] / elsewhere[size - 2][i][hit] * BACKOFF ** (orders - size)
            answered[at] = size
        out.append((float(np.log(score).sum()), np.bincount(answered, minlength=orders + 1)[1:].tolist()))
    return out


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Per row: key, id, words, log score, its mean, and the words that each order answered."""
    all_words = docs.agg(F.coalesce(F.sum(word_count(F.col(text))), F.lit(0))).first()[0]
    ranges = max(LEAST_RANGES, 1 << max(0, (all_words // TOKENS_A_RANGE) - 1).bit_length())
    rows = keyed(docs, F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    answers = joined_counts(gram_counts(rows, ranges, order))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {c: [] for c in (*KEY, "doc_id", "n_words", "log_score", "answered")}
        if left.num_rows:
            table, memo = opened(left.column("body")[0].as_py()), WordHashes()
            words = body_words(table, memo)
            by = {}
            for size, place, blob in zip(*(right.column(c).to_pylist() for c in ("size", "place", "totals")), strict=True):
                by[size, place] = from_planes(blob, np.uint64)
            totals = []
            for size in range(1, order + 1):
                parts = [by[k] for k in sorted(k for k in by if k[0] == size)]
                totals.append(np.concatenate(parts) if parts else np.empty(0, np.uint64))
            for w, (total, answered) in zip(words, chunk_scores(words, totals, all_words), strict=True):
                rows["n_words"].append(len(w))
                rows["log_score"].append(total)
                rows["answered"].append(answered)
            for c in (*KEY, "doc_id"):
                rows[c] = table.column(c).to_pylist()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int64())]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(rows.items(), kinds, strict=True)})

    scored = bodies(rows).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        score, f"{KEY[0]} long, {KEY[1]} long, doc_id string, n_words long, log_score double, answered array<long>")
    kind = docs.select(doc_id).schema[0].dataType
    return scored.select(
        *KEY, F.col("doc_id").cast(kind).alias("doc_id"), "n_words", "log_score",
        (F.col("log_score") / F.col("n_words")).alias("mean_log_score"),
        *[F.get("answered", F.lit(i)).alias(f"order_{i + 1}") for i in range(order)],
    )
