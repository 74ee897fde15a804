"""Exact join of documents by the Jaccard similarity of their word n-grams, with set-relation skipping.

A document is the set of its distinct ``GRAM``-word shingles.  Equal sets are one set from the start.

*Index.*  Shingles are ordered from rare to frequent; a set of size n is indexed under its first
``n - ceil(t n) + 1`` shingles, and two sets of similarity t or more share one of them.  Frequencies are
counted over all documents.  The order only needs to be the same everywhere, so the frequencies of the
``HOT`` most frequent shingles (a table of bounded size) are exact and all others count as rare.

*Block skipping.*  An index list is sorted by set size and, inside a block of equal sizes, by the place
of the shingle in its set.  If a shingle is the first one that two sets share, their overlap is at most
what follows it in either.  For each set this bounds the sizes a partner can have, and in a block of
one size it bounds the place, so the rest of the block is skipped.  Long lists are cut into pieces, and
pairs of pieces with compatible sizes are lists of their own.

*Answer skipping.*  Members of a list are compared by parity sketches first: two sets differ in at
least as many shingles as their sketches differ in places, so the filter loses nothing, and sketches
grow with their sets.  Each member is verified with its closest partner in the list.  What this
connects is an answer that the members of the component share: for a highly similar set, every further
partner in the component is known to be reachable and is skipped.  The next rounds try the closest
partner outside the component, until a round links little; untried pairs that are left between
components are then all verified.

Verification compares whole sets, fetched for the sets that passed the sketch.  Results are the
components of the link graph; every pair of linked sets is in one component and no other pair joins
two of them.

Shingles and sets are identified by 64-bit hashes.  Edge cases: null texts and texts without words have
empty sets, which link with nothing; with fewer words than a shingle the whole sequence is the one
shingle; repeated rows link with each other; a null id never is the smallest id unless all ids of a
component are null; an empty table gives an empty result; columns besides the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.graph import compact, components, tasks
from tidepanel.llm.texts import KEY, LOWER, WordHashes, as_bytes, gram_hashes, keyed, mix, signed, word_hashes
from tidepanel.session import cut_lineage

GRAM = 3
PERCENT = 90
#: Frequencies kept exactly: at most so many shingles, 12 bytes each, on every worker.
HOT = 1 << 20
LEAST_FREQUENT = 16
#: Shingles are counted by their first 42 bits, the first 10 of which name a range.
COUNT_BITS, RANGE_BITS = 42, 10
FLUSH = 4 << 20
SKETCH_BITS = 1024
PIECE = 1024
FILTER_POWER = 22
FAR = np.int32(1 << 30)
MEMBER_ROWS, PAIR_ROWS = 2048, 10_000
#: Rounds end when one links less than this part of what the most fruitful one did.
RARE = 16


def shingles(data: bytes | None, memo: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(b"" if data is None else data.translate(LOWER), memo)
    if 0 < len(words) < GRAM:
        return mix(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(gram_hashes(words, GRAM))


def set_id(values: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(values.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def sketch(values: np.ndarray) -> bytes:
    """For each place whether an odd number of shingles falls on it.

    The places are a power of two and at least as many as the shingles, so the sketches of unrelated sets
    differ in far more places than a similar pair may, whatever the size.
    """
    places = max(SKETCH_BITS, 1 << (len(values) - 1).bit_length())
    odd = np.bincount((values & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A sketch on fewer places: the places that fall together add up."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def least_overlap(total: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Shared shingles that two sets with ``total`` shingles together need."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Re-cut sorted batches so that all rows of a key are in one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(batch.schema.names.index(key)).to_numpy()
        last = int(np.searchsorted(values, values[-1]))
        if last or (held and held[-1].column(batch.schema.names.index(key))[-1].as_py() != values[0]):
            if held and held[-1].column(batch.schema.names.index(key))[-1].as_py() != values[0]:
                yield pa.Table.from_batches(held)
                held = []
            if last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.diff(np.append(starts, len(values)))


def _packed(values: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Sorted 42-bit numbers by range: differences of the rest, one plane for each byte."""
    values = np.sort(values)
    rest_bits = np.uint64(COUNT_BITS - RANGE_BITS)
    places, starts = np.unique(values >> rest_bits, return_index=True)
    blobs = []
    for part in np.split(values, starts[1:]):
        rest = (part & np.uint64((1 << int(rest_bits)) - 1)).astype(np.uint32)
        step = np.diff(rest, prepend=np.uint32(0))
        blobs.append(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes())
    return places.astype(np.int64).tolist(), blobs


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def document_sets(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Key, id, size, set and sketch of each row; and sorted runs of all shingles, a range in one value.

    One scan makes both, and one checkpoint holds them.  A run takes four bytes a shingle, instead of a row.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, held, size, kind = WordHashes(), [], 0, None

        def row(keys, sizes, ids, sketches, places, blobs):
            n = len(sizes)
            none = [pa.nulls(n, t) for t in kind] if keys is None else keys
            return pa.RecordBatch.from_arrays(
                [*none, pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary()),
                 pa.array(places, pa.int64()), pa.array(blobs, pa.binary())],
                [*KEY, "doc_id", "n", "set", "sketch", "place", "blob"])

        def flush():
            places, blobs = _packed(np.concatenate(held))
            free = [None] * len(places)
            return row(None, free, free, free, places, blobs)

        for batch in batches:
            kind = [batch.column(i).type for i in range(3)]
            sizes, ids, sketches = [], [], []
            for data in as_bytes(batch.column(3)):
                values = shingles(data, memo)
                sizes.append(len(values))
                ids.append(set_id(values) if len(values) else None)
                sketches.append(sketch(values) if len(values) else None)
                if len(values):
                    held.append(values >> np.uint64(64 - COUNT_BITS))
                    size += len(values)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
            free = [None] * len(sizes)
            yield row(batch.columns[:3], sizes, ids, sketches, free, free)
        if size:
            yield flush()

    read = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    both = cut_lineage(read.mapInArrow(
        scan, f"{KEY[0]} long, {KEY[1]} long, doc_id {kind}, n long, set long, sketch binary, place long, blob binary"))
    return both.where("place is null").drop("place", "blob"), both.where("place is not null").select("place", "blob")


def frequent_shingles(blobs: DataFrame) -> DataFrame:
    """``token, documents`` for shingles in more than ``LEAST_FREQUENT`` documents, from the runs of all shingles."""

    def count(table: pa.Table) -> pa.Table:
        place = table.column("place")[0].as_py()
        values = np.sort(np.concatenate([_unpacked(b) for b in table.column("blob").to_pylist()]))
        starts, lengths = runs(values)
        often = lengths > LEAST_FREQUENT
        token = (place << (COUNT_BITS - RANGE_BITS)) + values[starts[often]].astype(np.int64)
        return pa.table({"token": token, "documents": lengths[often].astype(np.int64)})

    return blobs.groupBy("place").applyInArrow(count, "token long, documents long")


def hot_order(blobs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and frequencies of the most frequent shingles, ``HOT`` of them at most."""
    often = cut_lineage(frequent_shingles(blobs))
    steps = often.groupBy(F.floor(F.log2("documents")).alias("power")).count().orderBy(F.desc("power")).collect()
    least, kept = 64, 0
    for step in steps:
        kept += step["count"]
        if kept > HOT:
            break
        least = step["power"]
    table = often.where(F.floor(F.log2("documents")) >= least).toPandas().sort_values("token")
    return table["token"].to_numpy(np.uint64), table["documents"].to_numpy(np.uint32)


def postings(docs: DataFrame, text: str, hot) -> DataFrame:
    """``token, n, place, set`` for the indexed shingles of each set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = WordHashes(), set()
        tokens, often = hot.value
        for batch in batches:
            found, sizes, ids = [], [], []
            for data in as_bytes(batch.column(0)):
                values = shingles(data, memo)
                n = len(values)
                if not n:
                    continue
                name = set_id(values)
                if name in seen:
                    continue
                if len(seen) >= 1 << 19:
                    seen.clear()
                seen.add(name)
                if len(tokens):
                    short = values >> np.uint64(64 - COUNT_BITS)
                    at = np.minimum(np.searchsorted(tokens, short), len(tokens) - 1)
                    is_hot = tokens[at] == short
                    if is_hot.any():
                        values = values[np.lexsort((values, np.where(is_hot, often[at], 0)))]
                values = values[: prefix_length(n)]
                found.append(values)
                sizes.append(n)
                ids.append(name)
            if found:
                lengths = np.array([len(v) for v in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(found))), pa.array(np.repeat(np.array(sizes, np.int32), lengths)),
                     pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])),
                     pa.array(np.repeat(np.array(ids, np.int64), lengths))],
                    ["token", "n", "place", "set"],
                )

    read = docs.select(F.col(text).alias("text")).where("text is not null")
    return read.mapInArrow(scan, "token long, n int, place int, set long")


def _largest_partner(n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Size of the largest set that can still reach the needed overlap from this place on."""
    return (n - place) * (100 + PERCENT) // PERCENT - n


def _lists(n: np.ndarray, place: np.ndarray, name: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members (sizes, sets) of one index list that can still have partners, in pieces."""
    largest = _largest_partner(n, place)
    if len(n) <= PIECE:
        can = (n[None, :] <= largest[:, None]) & (n[:, None] <= largest[None, :]) & (name[:, None] != name[None, :])
        keep = can.any(axis=1)
        if keep.any():
            yield n[keep], name[keep]
        return
    # Blocks of equal size, each sorted by place: a probe skips the rest of a block at its bound.
    starts, lengths = runs(n)
    keep = np.zeros(len(n), bool)
    for s, k in zip(starts, lengths, strict=True):
        first, last = int(n[s]), int(largest[s])
        near = np.flatnonzero((n[starts] >= first) & (n[starts] <= last))
        for b in near:
            size = int(n[starts[b]])
            bound = size - least_overlap(first + size)
            end = starts[b] + np.searchsorted(place[starts[b] : starts[b] + lengths[b]], bound, side="right")
            mine = s + np.searchsorted(place[s : s + k], first - least_overlap(first + size), side="right")
            if end > starts[b] and mine > s and (b != np.searchsorted(starts, s) or mine - s > 1):
                keep[starts[b] : end] = True
                keep[s:mine] = True
    n, name = n[keep], name[keep]
    order = np.lexsort((name, n))
    n, name = n[order], name[order]
    first = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else np.empty(0, bool)
    n, name = n[first], name[first]
    cuts = range(0, len(n), PIECE)
    for i in cuts:
        for j in cuts:
            if j == i:
                yield n[i : i + PIECE], name[i : i + PIECE]
            elif j > i and 100 * n[min(i + PIECE, len(n)) - 1] >= PERCENT * n[j]:
                yield (np.concatenate([n[i : i + PIECE], n[j : j + PIECE]]),
                       np.concatenate([name[i : i + PIECE], name[j : j + PIECE]]))


def index_lists(posted: DataFrame) -> DataFrame:
    """``members``: distinct sets of candidates, as packed (size, set) pairs sorted by set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for table in whole_runs(batches, "token"):
            token, n, place, name = (table.column(c).to_numpy() for c in ("token", "n", "place", "set"))
            n, place = n.astype(np.int64), place.astype(np.int64)
            starts, lengths = runs(token)
            out: list[bytes] = []
            two = starts[lengths == 2]
            largest = _largest_partner(n, place)
            two = two[(name[two] != name[two + 1]) & (n[two] <= largest[two + 1]) & (n[two + 1] <= largest[two])]
            pair = np.stack([n[two], name[two], n[two + 1], name[two + 1]], axis=1)
            swap = pair[:, 1] > pair[:, 3]
            pair[swap] = pair[swap][:, [2, 3, 0, 1]]
            out += [row.tobytes() for row in pair]
            for s, k in zip(starts[lengths > 2], lengths[lengths > 2], strict=True):
                for sizes, names in _lists(n[s : s + k], place[s : s + k], name[s : s + k]):
                    names, at = np.unique(names, return_index=True)
                    if len(names) > 1:
                        out.append(np.stack([sizes[at], names], axis=1).tobytes())
            fresh = []
            for members in out:
                value = xxhash.xxh3_64_intdigest(members)
                if value not in seen:
                    if len(seen) >= 1 << 19:
                        seen.clear()
                    seen.add(value)
                    fresh.append(members)
            yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.binary())], ["members"])

    ordered = posted.repartition("token").sortWithinPartitions("token", "n", "place")
    return ordered.mapInArrow(scan, "members binary").distinct()


def _members(lists: DataFrame) -> DataFrame:
    """One row for each member of each list."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                blobs = part.column(1).to_pylist()
                sizes = [len(b) // 16 for b in blobs]
                values = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(values[:, 0].copy()),
                     pa.array(values[:, 1].copy())], ["list", "n", "set"])

    return lists.select("list", "members").mapInArrow(explode, "list long, n long, set long")


def _close(n: np.ndarray, sketches: list[bytes]) -> np.ndarray:
    """Differences of the sketches where a pair can be similar, else ``FAR``."""
    apart = np.zeros((len(n), len(n)), np.int32)
    words = np.array([len(s) // 8 for s in sketches])
    for size in np.unique(words):  # a pair keeps the difference on the places of its shorter sketch
        at = np.flatnonzero(words >= size)
        bits = np.stack([folded(np.frombuffer(sketches[i], np.uint64), size) for i in at])
        part = np.zeros((len(at), len(at)), np.int32)
        for word in range(size):
            part += np.bitwise_count(bits[:, None, word] ^ bits[None, :, word])
        apart[np.ix_(at, at)] = part
    total = n[:, None] + n[None, :]
    bad = (apart > total - 2 * least_overlap(total)) | np.eye(len(n), dtype=bool)
    return np.where(bad, FAR, apart)


def candidate_pairs(members: DataFrame, choose: Callable, parts: int) -> DataFrame:
    """``a, b`` pairs of sets that ``choose`` takes from each list's members (n, sketch[, root])."""
    names = members.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "list"):
            which, n, name = (table.column(c).to_numpy() for c in ("list", "n", "set"))
            sketches = table.column("sketch").to_pylist()
            root = table.column("root").to_numpy() if "root" in names else None
            left, right = [], []
            for s, k in zip(*runs(which), strict=True):
                part = slice(s, s + k)
                i, j = choose(n[part], sketches[part], None if root is None else root[part])
                left.append(name[part][i])
                right.append(name[part][j])
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    ordered = members.repartition(parts, "list").sortWithinPartitions("list")
    return ordered.mapInArrow(scan, "a long, b long").distinct()


def outward(n: np.ndarray, sketches: list[bytes], root: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each member with its closest possible partner outside its component."""
    apart = _close(n, sketches)
    if root is not None:
        apart[root[:, None] == root[None, :]] = FAR
    best = apart.argmin(axis=1)
    i = np.flatnonzero(apart[np.arange(len(n)), best] < FAR)
    return i, best[i]


def across(n: np.ndarray, sketches: list[bytes], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All possible pairs of members from different components."""
    possible = (_close(n, sketches) < FAR) & (root[:, None] != root[None, :])
    return np.nonzero(np.triu(possible))


def fetch_sets(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``set, shingles`` of the wanted sets.

    A bitmap of fixed size keeps most other sets out of the shuffle; a full one lets all through.
    """
    size = 1 << FILTER_POWER
    known = np.zeros(size, bool)
    known[wanted.select(F.col("set").bitwiseAND(size - 1).alias("p")).distinct().toPandas()["p"].to_numpy(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(known))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, memo, seen = np.unpackbits(shared.value).astype(bool), WordHashes(), set()
        for batch in batches:
            ids, sets = [], []
            for data in as_bytes(batch.column(0)):
                values = shingles(data, memo)
                name = set_id(values)
                if len(values) and bitmap[name & (size - 1)] and name not in seen:
                    if len(seen) >= 1 << 19:
                        seen.clear()
                    seen.add(name)
                    ids.append(name)
                    sets.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["set", "shingles"])

    read = docs.select(F.col(text).alias("text")).where("text is not null")
    return read.mapInArrow(scan, "set long, shingles binary").groupBy("set").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= PERCENT * (len(both) - shared))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    left = sets.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(check, "a long, b long")


def linked(members: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``node, root`` of the sets that links reach.

    In each round every member tries its closest partner outside its component, so a large group of near
    copies, whose members all link, ends as one component after a few rounds of at most one pair for each
    membership.  When a round links little, all untried pairs between components are compared; what
    is left there are pairs that the sketches cannot tell from similar ones.
    """
    sets = tried = links = roots = None
    choose, most = outward, 0
    parts = tasks(members.count(), MEMBER_ROWS)
    members = members.coalesce(parts)
    while True:
        labelled = members
        if roots is not None:
            labelled = members.join(roots.withColumnRenamed("node", "set"), "set", "left").select(
                "list", "n", "set", "sketch", F.coalesce("root", "set").alias("root"))
        pairs = candidate_pairs(labelled, choose, parts)
        pairs = compact(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), PAIR_ROWS)
        if sets is None:  # a set with a possible partner has a closest one, so later rounds need no others
            wanted = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
            sets = cut_lineage(fetch_sets(docs, text, wanted))
        found = compact(verified(pairs, sets))
        grew = found.count()
        if grew or tried is None:
            links = found if links is None else links.unionByName(found)
            roots = compact(components(links))
        if choose is across or tried is None and not pairs.take(1):
            return roots
        tried = pairs if tried is None else tried.unionByName(pairs)
        most = max(most, grew)
        if RARE * grew <= most:
            choose = across


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, id, set size, set, root set of its component and smallest id of the component."""
    spark = docs.sparkSession
    rows, blobs = document_sets(docs, doc_id, text)
    hot = spark.sparkContext.broadcast(hot_order(blobs))
    lists = cut_lineage(
        index_lists(postings(docs, text, hot)).select(F.monotonically_increasing_id().alias("list"), "members")
    )
    sketches = rows.where("n > 0").groupBy("set").agg(F.first("sketch").alias("sketch"))
    members = cut_lineage(_members(lists).join(sketches, "set").select("list", "n", "set", "sketch"))
    roots = linked(members, docs, text)
    named = (
        rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"))
        .join(roots.withColumnRenamed("node", "set"), "set", "left")
        .select("set", F.coalesce("root", "set").alias("root"), "least")
    )
    named = cut_lineage(named)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.select("set", "root").join(smallest, "root")
    return rows.drop("sketch").join(labels, "set", "left").select(
        *KEY, "doc_id", F.col("n").alias("n_shingles"), "set", "root",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
