"""Token counts of a byte-level BPE vocabulary by the whole-token shortcut.

Most pre-tokens of ordinary text are vocabulary entries, and an entry that encodes alone as one
token needs no merging.  Which entries do is proved offline, once for each vocabulary: every string
of the vocabulary is encoded by the library and kept if one token comes back and the pre-tokenizer
leaves it whole.  At run time a text is cut into pre-tokens; those in the proven set count one, and
only the rest go through the merges of the library.  Merged pre-tokens are remembered in a bounded
table, because rare words repeat.

The cut equals the library's byte-level pre-tokenizer; ``tests/llm`` compares code points and random
texts.  A text with characters that only newer Unicode versions assign goes to the library whole.  Special strings inside a text are one token each, as the library reads them by
default.

Edge cases: null counts as the empty text (0 bytes, 0 tokens); repeated rows are counted each; an
empty table gives an empty result; columns besides the named ones are not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepanel.llm.texts import bound_batches

# The byte-level pre-tokenizer's pattern.  White space is listed because the regex
# modules' own class has four control characters more than the library's.
_SPACES = r"\t\n\x0B\f\r\x20\x85\xA0"
_WIDE_SPACES = _SPACES + "  -     　"
_NARROW_LETTERS, _NARROW_NUMBERS = r"A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-ɏ", r"0-9\xB2\xB3\xB9\xBC-\xBE"


def pre_token_pattern(letters: str, numbers: str, spaces: str) -> str:
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+"
        rf"|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


#: For texts below U+0250 the standard module with listed letters is twice as fast.
NARROW = re.compile(pre_token_pattern(_NARROW_LETTERS, _NARROW_NUMBERS, _SPACES))
WIDE = regex.compile(pre_token_pattern(r"\p{L}", r"\p{N}", _WIDE_SPACES))
_BEYOND_NARROW = re.compile("[^\x00-ɏ]")


def pre_tokens(text: str) -> list[str] | None:
    """The text's pre-tokens; None if it has characters on whose class Unicode versions differ."""
    if not _BEYOND_NARROW.search(text):
        return NARROW.findall(text)
    if any(unicodedata.category(c) == "Cn" for c in set(text)):
        return None
    return WIDE.findall(text)


REMEMBERED = 1 << 19
REMEMBERED_LENGTH = 64


def byte_characters() -> dict[int, str]:
    """How a byte-level vocabulary writes each byte: itself where printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def prove_whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    back = {c: b for b, c in byte_characters().items()}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = []
    for entry in tokenizer.get_vocab():
        if entry in special or any(c not in back for c in entry):
            continue
        try:
            texts.append(bytes(back[c] for c in entry).decode("utf-8"))
        except UnicodeDecodeError:
            continue  # part of a character: never a whole pre-token
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, encoded, strict=True) if len(e.ids) == 1 and pre_tokens(t) == [t])


class Counter:
    """Counts the tokens of texts; one for each Python worker."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = prove_whole_tokens(self.tokenizer)
        self.written = byte_characters()
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.known = _Merged(self)

    def merge(self, pre_token: str) -> int:
        """Tokens of one pre-token by the library's merges."""
        return len(self.tokenizer.model.tokenize(pre_token.encode().decode("latin-1").translate(self.written)))

    def plain(self, text: str) -> int:
        cut = pre_tokens(text)
        if cut is None:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.known.__getitem__, cut))

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return sum(map(self.plain, parts)) + len(parts) - 1


class _Merged(dict):
    """Tokens of a pre-token: proven entries once and for all, merged ones until the table is full."""

    def __init__(self, counter: Counter):
        super().__init__(dict.fromkeys(counter.whole, 1))
        self.counter = counter
        self.room = REMEMBERED

    def __missing__(self, pre_token: str) -> int:
        n = self.counter.merge(pre_token)
        if len(pre_token) <= REMEMBERED_LENGTH:
            if not self.room:
                self.clear()
                self.update(dict.fromkeys(self.counter.whole, 1))
                self.room = REMEMBERED
            self[pre_token] = n
            self.room -= 1
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for each row; ``vocabulary`` is a tokenizers file all workers can read."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokens = counter(vocabulary).count
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [0 if t is None else tokens(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    read = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
