"""Search, hard negatives and near-duplicate vectors against brute force."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tests.llm.cases import CLASHING, odd_rows, prose, table
from tidepanel.llm import negatives, quantised, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ITEMS = "item_id long, text string, note string"
VECTORS = "vec_id long, embedding array<float>, label int, score string"


# ---- search

def brute_search(rows, items, k=50):
    found = [(r[0], collections.Counter(TERM.findall((r[1] or "").translate(LOWER)))) for r in rows]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    holding = collections.Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in found:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(TERM.findall((text or "").translate(LOWER))) if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def searched(docs, items, **options):
    return sorted(map(tuple, search.search(docs, items, **options).collect()), key=repr)


def queries(rng):
    return [(i, prose(rng, 3 + 4 * i, 300)) for i in range(6)] + [
        (None, "w1 W2"), (7, None), (8, ""), (9, "none of these"), (10, "É x"), (10, "É x"), (11, "a b co 1 2")]


def test_search_on_odd_rows(spark):
    rng = random.Random(3)
    items = queries(rng)
    asked = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    docs = table(spark, odd_rows(), CLASHING).repartition(3)
    assert searched(docs, asked) == brute_search(odd_rows(), items)
    assert searched(docs, asked, k=2) == brute_search(odd_rows(), items, 2)
    assert searched(docs.limit(0), asked) == [] and searched(docs, asked.limit(0)) == []


def test_search_closes_accumulators_and_stays_exact(spark, monkeypatch):
    """Ties at the last rank, words of every frequency, many blocks of documents and of queries."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randrange(1, 60))), "en", "s", 1) for i in range(900)]
    rows += [(2000 - i, "rare w1 w2", "en", "s", 1) for i in range(30)]
    items = [(i, " ".join(f"w{int(rng.paretovariate(0.5)) % 900}" for _ in range(12))) for i in range(20)] + [(99, "rare w1")]
    asked = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    docs = table(spark, rows).repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    monkeypatch.setattr(search, "BLOCK_TERMS", 40)
    try:
        assert searched(docs, asked, k=10) == brute_search(rows, items, 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_accumulator_is_opened_below_the_kth_score():
    best = search.Best(2)
    rare, common = np.array([3, 7, 9]), np.arange(100)
    scores = search.accumulate([(rare, np.array([50, 60, 70])), (common, np.full(100, 10))], 100, best)
    assert np.flatnonzero(scores).tolist() == [3, 7, 9] and scores[[3, 7, 9]].tolist() == [60, 70, 80]
    tie = search.accumulate([(rare, np.array([50, 10, 5])), (common, np.full(100, 10))], 100, best)
    assert np.count_nonzero(tie) == 100  # the second best could still be any other


# ---- hard negatives

@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 40), (64, 64, 64), (100, 7, 129), (130, 96, 70)])
def test_strassen_equals_the_plain_product(shape):
    m, k, n = shape
    rng = np.random.default_rng(m)
    a, b = rng.integers(-(1 << 20), 1 << 20, (m, k)), rng.integers(-(1 << 20), 1 << 20, (k, n))
    for leaf in (1, 4, 16):
        assert (negatives.strassen(a, b, leaf) == a @ b).all()


def brute_negatives(rows):
    usable = [(i, (int(math.copysign(abs(c + 1) % 10, c + 1)) if i is not None and i % 7 == 0 else c), [math.floor(256 * float(x)) for x in v])
              for i, v, c in rows if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    rank = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for a, label, x in usable:
        if a is None or a % 50:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), i, c) for i, c, y in usable if i != a]
        for ps, p, _ in sorted((s for s in scored if s[2] == label), key=rank)[:5]:
            inside = sorted((s for s in scored if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps), key=rank)[:3]
            out += [(a, p, i, n, ps, s) for i, (s, n, _) in enumerate(inside, 1)]
    return sorted(out, key=repr)


def vector_rows():
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(0, 0.3, 24)], int(rng.integers(0, 10))) for i in range(400)]
    centre = np.float32(rng.normal(0, 0.3, 24))
    rows += [(1000 + i, [float(np.float32(v)) for v in centre + rng.normal(0, 0.02, 24)], 3) for i in range(60)]
    rows += [(2000 + i, [float(v) for v in centre], 3) for i in range(40)] + [rows[50], rows[51], rows[51]]
    return rows + [
        (None, rows[3][1], 4), (3000, None, 1), (3050, rows[4][1], None), (3100, [float("nan")] + rows[4][1][1:], 1),
        (3150, [None] + rows[4][1][1:], 1), (3200, [float("inf")] + rows[4][1][1:], 1), (3250, [0.0] * 24, 1), (3300, [], 1),
        (3350, rows[5][1][:11], 2), (3400, [-v for v in rows[6][1]], 5)]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], VECTORS).repartition(5)


def test_hard_negatives_on_odd_rows(spark, monkeypatch):
    rows = vector_rows()
    got = sorted(map(tuple, negatives.hard_negatives(vectors(spark, rows)).collect()), key=repr)
    assert got == brute_negatives(rows) and len(got) > 50
    monkeypatch.setattr(negatives, "GROUP", 4)
    monkeypatch.setattr(negatives, "TILE", 16)
    assert sorted(map(tuple, negatives.hard_negatives(vectors(spark, rows)).collect()), key=repr) == got
    assert negatives.hard_negatives(vectors(spark, rows).limit(0)).count() == 0


# ---- near-duplicate vectors

def brute_links(rows, limit=0.93):
    unit = []
    for _, v, c in rows:
        x = np.array([np.nan if e is None else e for e in v or []])
        ok = c is not None and len(x) and np.isfinite(x).all() and (x != 0).any()
        unit.append((c, x / np.linalg.norm(x)) if ok else None)
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a and b and a[0] == b[0] and len(a[1]) == len(b[1]) and float(a[1] @ b[1]) >= limit:
                n[i] += 1
                n[j] += 1
                root[top(i)] = top(j)
    least = collections.defaultdict(list)
    for i, r in enumerate(rows):
        least[top(i)] += [] if r[0] is None else [r[0]]
    out = []
    for i, r in enumerate(rows):
        component = min(least[top(i)], default=None)
        out.append((r[0], n[i], component, r[0] == component))
    return sorted(out, key=repr)


def linked(df, **options):
    return sorted(map(tuple, quantised.similar_vectors(df, **options).collect()), key=repr)


def test_similar_vectors_on_odd_rows(spark, monkeypatch):
    rows = vector_rows()
    want = brute_links(rows)
    assert linked(vectors(spark, rows)) == want and max(r[1] for r in want) >= 99
    monkeypatch.setattr(quantised, "PIECE", 16)
    monkeypatch.setattr(quantised, "SAMPLE", 64)
    assert linked(vectors(spark, rows)) == want
    assert linked(vectors(spark, rows).limit(0)) == []


def test_recall_at_the_limit(spark):
    """Pairs whose cosine is just above the limit, in random directions: the hardest links to probe."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        w = rng.normal(size=64)
        w -= (w @ x) * x
        w /= np.linalg.norm(w)
        for j, v in enumerate((x, 0.9305 * x + math.sqrt(1 - 0.9305**2) * w)):
            rows.append((2 * i + j, [float(v_) for v_ in v], i % 2))
    counts = {}
    for safety in (quantised.SAFETY, math.sqrt(63)):
        got = linked(vectors(spark, rows), safety=safety)
        counts[safety] = sum(1 for r in got if r[1])
        assert all(r[2] == r[0] - r[0] % 2 for r in got if r[1])
    assert counts[math.sqrt(63)] == len(rows)
    assert counts[quantised.SAFETY] >= 0.995 * len(rows)
