"""Quality rules: cross-document line frequency.

Lines are normalised (ASCII lower case, digits as 0, white space folded) and hashed.  For each host
the documents that hold a line are counted; a line is boilerplate when it stands in at least
``min_documents`` documents of the host and in more than ``max_share`` of them.  Boilerplate lines are
removed, and a document is rejected as depleted when fewer than ``min_words`` words or less than
``min_left`` of its words remain.

Documents are rows, or with ``distinct`` the distinct texts of the host, so that exact copies count once
and a copy group of any size never makes boilerplate of its own lines.

Each document sends a line once, and counts are combined before the shuffle, so a line of a third of
all rows arrives as one row from each task.  The table of boilerplate lines is small by its
definition: a host has at most its mean number of lines over ``max_share``.

A separate set of base rules looks at one text alone (``base_measures``).

Lines, texts and five-word windows are compared by 64-bit hashes.  Edge cases: a null text has no words
and fails the base rules; null is a host; an empty or blank line is never removed; repeated documents
count each, unless ``distinct``; an empty table gives an empty result; columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.texts import KEY, WordHashes, gram_hashes, keyed, word_hashes
from tidepanel.session import cut_lineage

MIN_DOCUMENTS, MAX_SHARE = 20, 0.08
MIN_WORDS, MIN_LEFT = 10, 0.3
REPEAT_WINDOW = 5

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_SPACES = (" ", "\t", "\n", "\x0b", "\f", "\r")
_SYMBOLS = "#*$%&|<>"
_LINE = pa.struct([("line", pa.int64()), ("words", pa.int64())])
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def signed_hash(data: bytes) -> int:
    value = xxhash.xxh3_64_intdigest(data)
    return value - (1 << 64) if value >= 1 << 63 else value


def line_hash(line: bytes) -> tuple[int, int]:
    """Hash of a normalised line as a signed long, and its words."""
    words = line.translate(_FOLD).split()
    return signed_hash(b" ".join(words)), len(words)


def repeated_words(words: np.ndarray, k: int = REPEAT_WINDOW) -> int:
    """Words inside runs of k words that stand in the text twice or more."""
    grams = gram_hashes(words, k)
    if not len(grams):
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(grams)] += again
    edge[k : k + len(grams)] -= again
    return int((np.cumsum(edge) > 0).sum())


def base_measures(text: str, data: bytes, memo: WordHashes) -> tuple[list[int], list[dict]]:
    """The base rules' numbers for one text, and its normalised lines with the words they hold."""
    words = word_hashes(data, memo)
    seen, again, lines = set(), 0, {}
    for line in data.split(b"\n"):
        value, n = line_hash(line)
        if not n:
            continue
        if line in seen:
            again += 1
        seen.add(line)
        lines[value] = lines.get(value, 0) + n
    measures = [
        len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), again,
        repeated_words(words),
    ]
    return measures, [{"line": v, "words": n} for v, n in lines.items()]


def measured(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """Each row's key, id and host with its measures, lines and the hash of its text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            rows, hashes = [], []
            for value in batch.column(4).to_pylist():
                value = value or ""
                data = value.encode()
                rows.append(base_measures(value, data, memo))
                hashes.append(signed_hash(data))
            numbers = np.array([r[0] for r in rows], np.int64).reshape(-1, len(_MEASURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *[pa.array(numbers[:, i]) for i in range(len(_MEASURES))],
                 pa.array([r[1] for r in rows], pa.list_(_LINE)), pa.array(hashes, pa.int64())],
                [*KEY, "doc_id", "host", *_MEASURES, "lines", "text_hash"],
            )

    read = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    kinds = {n: read.schema[n].dataType.simpleString() for n in ("doc_id", "host")}
    return read.mapInArrow(
        scan, f"{KEY[0]} long, {KEY[1]} long, doc_id {kinds['doc_id']}, host {kinds['host']}, "
        + ", ".join(f"{m} long" for m in _MEASURES) + ", lines array<struct<line: long, words: long>>, text_hash long",
    )


def boilerplate(rows: DataFrame, min_documents: int, max_share: float, distinct: bool = False) -> DataFrame:
    """``host, line``: lines in too many documents of their host, or in too many of its distinct texts."""
    if distinct:
        rows = rows.select("host", "text_hash", "lines").dropDuplicates(["host", "text_hash"])
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_documents")).alias("h")
    lines = (
        rows.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line")
        .agg(F.count("*").alias("documents")).where(F.col("documents") >= min_documents).alias("l")
    )
    return lines.join(hosts, F.col("l.host").eqNullSafe(F.col("h.host"))).where(
        F.col("documents") > max_share * F.col("host_documents")
    ).select("l.host", "line")


def line_frequency(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                   min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE, min_words: int = MIN_WORDS,
                   min_left: float = MIN_LEFT, distinct: bool = False) -> DataFrame:
    """Per row: key, measures, removed words, and ``kept``, the verdict of both kinds of rules."""
    rows = cut_lineage(measured(docs, doc_id, text, host))
    common = cut_lineage(boilerplate(rows, min_documents, max_share, distinct)).alias("c")
    held = rows.select(*KEY, "host", F.explode("lines").alias("l")).select(*KEY, "host", "l.*").alias("d")
    removed = (
        held.join(common, (F.col("d.line") == F.col("c.line")) & F.col("d.host").eqNullSafe(F.col("c.host")))
        .groupBy(*KEY).agg(F.sum("words").alias("gone"))
    )
    gone = F.coalesce(F.col("gone"), F.lit(0))
    left = F.col("n_words") - gone
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (left < min_words) | (left < min_left * F.col("n_words"))
    return rows.drop("lines", "text_hash").join(removed, list(KEY), "left").select(
        *KEY, "doc_id", *_MEASURES, base.alias("base_failed"), (~base & ~depleted).alias("kept"),
        gone.alias("removed_words"),
    )


def strip_lines(docs: DataFrame, common: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The documents with the lines in ``common`` (host, line) taken out of their texts.

    Documents of hosts without such lines pass through; a host's lines travel with its documents, and
    are few by the definition of ``boilerplate``.
    """
    sets = common.groupBy("host").agg(F.collect_set("line").alias("__lines")).alias("c")
    joined = docs.alias("d").join(sets, F.col(f"d.{host}").eqNullSafe(F.col("c.host")), "left").select("d.*", "__lines")
    names, at = docs.columns, docs.columns.index(text)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value, lines in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if value and lines:
                    out = set(lines)
                    parts = value.encode().split(b"\n")
                    value = b"\n".join(p for p in parts if not p.split() or line_hash(p)[0] not in out).decode()
                texts.append(value)
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(strip, docs.schema)
