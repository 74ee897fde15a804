"""Benchmark decontamination by winnowing.

A fingerprint of a text is the smallest hash of its runs of ``GRAM`` words in each sliding window of
``WINDOW`` runs (the last one on ties).  ``GRAM + WINDOW - 1`` equal words in a row, 13 here, hold one
whole sliding window in both texts, which picks the same run at the same offset: every shared span of
13 words or more shares a fingerprint at the right alignment.  Fingerprints of documents and items are
joined on their hash and each hit is extended word by word.  A window that holds the run lies within
eight words of it, so a hit carries its run and eight words on either side and is extended from that
alone; what lies further belongs to another hit.  The words found are exactly those that some
occurrence of a 13-word window covers.

An item of fewer than 13 words is one window as a whole: its words are one run, looked for in every
document for each length that occurs (twelve lengths at most).

Documents look up their runs in a bitmap of fixed size of the items' hashes first, so only
documents that can have a hit are fingerprinted and only possible hits leave the scan.  A full bitmap
lets everything through; the join decides either way.

Words are compared by 64-bit hashes.  Edge cases: null and texts without words have no words and no
hits; null items are skipped, a null item id is written as an empty string; items with equal ids count
once; repeated documents are judged each; empty tables give no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.texts import (
    KEY, WordHashes, as_bytes, bound_batches, gram_hashes, keyed, mix, signed, word_hashes,
)
from tidepanel.session import cut_lineage

SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1
SIDE = SPAN - GRAM
AROUND = GRAM + 2 * SIDE
#: The bitmap has 2 to this power places, one byte each.
BITMAP_POWER = 22
NO_WORD = {"document": np.uint64(1), "item": np.uint64(2)}

# Words are runs of ASCII letters and digits and of all characters beyond ASCII.
TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def normalised(data: bytes | None) -> bytes:
    return b"" if data is None else data.translate(TO_WORDS)


def fingerprints(grams: np.ndarray) -> np.ndarray:
    """Places of the runs that winnowing keeps; the last smallest of each window."""
    if len(grams) < WINDOW:
        return np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams[::-1], WINDOW)
    last = len(grams) - 1 - (np.arange(len(windows)) + windows.argmin(axis=1))
    return np.unique(last)


def surroundings(words: np.ndarray, places: np.ndarray, who: str) -> np.ndarray:
    """The run at each place with the words on either side; beyond the text stands no word."""
    padded = np.full(len(words) + 2 * SIDE, NO_WORD[who])
    padded[SIDE : SIDE + len(words)] = words
    return padded[places[:, None] + np.arange(AROUND)]


def short_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, apart from those of other lengths."""
    return mix(gram_hashes(words, k) + np.uint64(k))


_HITS = pa.struct([("print", pa.int64()), ("place", pa.int32()), ("length", pa.int32()), ("around", pa.binary())])


def _hit_rows(found: list[tuple[np.ndarray, np.ndarray, int, np.ndarray | None]]) -> list[dict]:
    rows = []
    for prints, places, length, around in found:
        for i in range(len(places)):
            rows.append({
                "print": int(signed(prints)[i]), "place": int(places[i]), "length": length,
                "around": None if around is None else around[i].tobytes(),
            })
    return rows


def item_prints(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, print, length, around``: fingerprints of long items, whole runs of short ones."""
    bound_batches(benchmark.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            ids, rows = [], []
            for name, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = word_hashes(normalised(data), memo)
                if not len(words):
                    continue
                if len(words) < SPAN:
                    found = [(short_hash(words, len(words)), np.zeros(1, np.int64), len(words), None)]
                else:
                    grams = gram_hashes(words, GRAM)
                    at = fingerprints(grams)
                    found = [(grams[at], at, GRAM, surroundings(words, at, "item"))]
                new = _hit_rows(found)
                rows += new
                ids += [name] * len(new)
            hits = pa.array(rows, _HITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), *[hits.field(f) for f in ("print", "length", "around")]],
                ["item_id", "print", "length", "around"],
            )

    read = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text).alias("text"))
    return read.mapInArrow(scan, "item_id string, print long, length int, around binary").distinct()


def document_hits(docs: DataFrame, bitmap, lengths: list[int], doc_id: str, text: str) -> DataFrame:
    """Each row's key, id and number of words, with its possible hits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = WordHashes(), bitmap.value
        mask = np.uint64(len(known) - 1)
        for batch in batches:
            counts, hits = [], []
            for data in as_bytes(batch.column(3)):
                words = word_hashes(normalised(data), memo)
                counts.append(len(words))
                found = []
                grams = gram_hashes(words, GRAM)
                if known[grams & mask].any():
                    at = fingerprints(grams)
                    at = at[known[grams[at] & mask]]
                    found.append((grams[at], at, GRAM, surroundings(words, at, "document")))
                for k in lengths:
                    runs = short_hash(words, k)
                    at = np.flatnonzero(known[runs & mask])
                    found.append((runs[at], at, k, None))
                hits.append(_hit_rows(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(hits, pa.list_(_HITS))],
                [*KEY, "doc_id", "n_words", "hits"],
            )

    read = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(
        scan, f"{KEY[0]} long, {KEY[1]} long, doc_id {kind}, n_words long, "
        "hits array<struct<print: long, place: int, length: int, around: binary>>",
    )


def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grow joined hits in both directions; keep those that reach the length of a window."""
    for batch in batches:
        names = batch.schema.names
        length = batch.column(names.index("length")).to_numpy()
        place = batch.column(names.index("place")).to_numpy()
        start, end = place.astype(np.int64), place.astype(np.int64) + length
        keep = np.ones(len(length), bool)
        ours, theirs = batch.column(names.index("ours")), batch.column(names.index("theirs"))
        long = np.flatnonzero(ours.is_valid().to_numpy(zero_copy_only=False))
        if len(long):
            pick = pa.array(long)
            a, b = (
                np.frombuffer(b"".join(c.take(pick).to_pylist()), np.uint64).reshape(-1, AROUND) for c in (ours, theirs)
            )
            same = a == b
            left = np.logical_and.accumulate(same[:, SIDE - 1 :: -1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate(same[:, SIDE + GRAM :], axis=1).sum(axis=1)
            start[long] -= left
            end[long] += right
            keep[long] = same[:, SIDE : SIDE + GRAM].all(axis=1) & (left + right + GRAM >= SPAN)
        at = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(names.index(c)).take(at) for c in (*KEY, "item_id")],
             pa.array(start[keep]), pa.array(end[keep])],
            [*KEY, "item_id", "start", "end"],
        )


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                       item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All rows (key, id, words) and the spans of words that items cover in them."""
    spark = docs.sparkSession
    items = cut_lineage(item_prints(benchmark, item_id, item_text))
    size = 1 << BITMAP_POWER
    known = np.zeros(size, bool)  # at most as many places are collected as the bitmap has
    known[[r[0] for r in items.select(F.col("print").bitwiseAND(size - 1)).distinct().collect()]] = True
    lengths = [r[0] for r in items.where("around is null").select("length").distinct().collect()]
    rows = cut_lineage(document_hits(docs, spark.sparkContext.broadcast(known), sorted(lengths), doc_id, text))
    possible = rows.select(*KEY, F.explode("hits").alias("h")).select(
        *KEY, "h.print", "h.length", "h.place", F.col("h.around").alias("ours")
    )
    hits = possible.join(items.withColumnRenamed("around", "theirs"), ["print", "length"]).select(
        *KEY, "item_id", "place", "length", "ours", "theirs"
    )
    spans = hits.mapInArrow(extend, f"{KEY[0]} long, {KEY[1]} long, item_id string, start long, end long")
    return rows.drop("hits"), spans


def covered(spans: str):
    """Words under a set of (start, end) spans, each counted once."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"),
            F.greatest(a["reach"], s["end"]).alias("reach"),
        ),
    )
    return step["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, part: int = 20, **names: str) -> DataFrame:
    """Per row: its key, words, hit words, items found, and whether a ``part``-th of its words is hit."""
    rows, spans = contaminated_spans(docs, benchmark, **names)
    found = spans.groupBy(*KEY).agg(
        F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items")
    )
    n_hit = F.coalesce(covered("spans"), F.lit(0))
    return rows.join(found, list(KEY), "left").select(
        *KEY, "doc_id", "n_words", n_hit.cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (part * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
