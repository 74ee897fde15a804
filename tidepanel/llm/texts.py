"""What the corpus operators share: row keys, word hashes and gram hashes.

Word hashes are 64 bits, so two different words of one document collide with a probability of
about 1e-19 per pair; operators that compare hashes say so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import cut_lineage

KEY = ("__file", "__row")
WORD = r"[^\x20\x09-\x0D]+"
#: Mark of the key columns, and what a column of the same name is called meanwhile.
OWN, ASIDE = "tidepanel.key", "__aside"
BATCH_BYTES = 16 << 20
PIECE = 4 << 20
#: Keys of 16 bytes that are sent to all executors at most.
BROADCAST_KEYS = 2_000_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
                dtype=np.uint64)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well as rows, so long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def with_keys(df: DataFrame) -> DataFrame:
    """All columns and a key for each row that stays the same when the rows are read again.

    Rows of files are keyed by file and place.  Other rows get a number and are written to the
    checkpoint folder, because a number given on the fly could differ after a lost executor.  A column
    that has the name of a key column by chance is kept under another name; ``original`` undoes that.
    """
    bound_batches(df.sparkSession)
    if all(name in df.columns and df.schema[name].metadata.get(OWN) for name in KEY):
        return df
    held = df.withColumnsRenamed({name: name + ASIDE for name in KEY})
    own = {OWN: True}
    try:
        return held.select("*", F.xxhash64("_metadata.file_path").alias(KEY[0], metadata=own),
                           F.col("_metadata.row_index").alias(KEY[1], metadata=own))
    except AnalysisException:
        numbered = cut_lineage(
            held.select("*", F.lit(0).cast("long").alias(KEY[0]), F.monotonically_increasing_id().alias(KEY[1])))
        return numbered.select(*held.columns, *(F.col(name).alias(name, metadata=own) for name in KEY))


def original(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns as they were before ``with_keys``."""
    return rows.select(*(F.col(c + ASIDE if c in KEY else c).alias(c) for c in columns))


def keyed(df: DataFrame, *columns: Column) -> DataFrame:
    """The key of each row and the named columns."""
    return with_keys(df).select(*KEY, *columns)


def without(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """The keyed rows that are not in ``rejected``.

    A short list of keys goes to all executors, so that texts stay where they are; a long one is
    joined by a shuffle.
    """
    keys = cut_lineage(rejected.select(*KEY))
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, list(KEY), "left_anti")


class WordHashes(dict):
    """Word to 64-bit hash; starts over when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 19:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def pieces(data: bytes) -> Iterator[bytes]:
    """Slices of a long text that end at white space, so its words are never all in memory."""
    start = 0
    while len(data) - start > PIECE:
        cut = _SPACE.search(data, start + PIECE)
        if cut is None:
            break
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:] if start else data


def word_hashes(data: bytes, memo: WordHashes) -> np.ndarray:
    """One hash for each word between ASCII white space."""
    found = []
    for part in pieces(data):
        words = part.split()
        found.append(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
    return found[0] if len(found) == 1 else np.concatenate(found)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; none when there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for j in range(k):
        part = words[j : j + n] * _ODD[j % len(_ODD)]
        total += part if j < len(_ODD) else mix(part + np.uint64(j))
    return mix(total)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
