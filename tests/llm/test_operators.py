"""The corpus operators against brute force on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import CLASHING, SCHEMA, odd_rows, prose, table
from tidepanel.llm import (
    backoff, decontaminate, graph, jaccard, licences, lines, mixing, personal, quality, sharding, tokens,
)
from tidepanel.llm.texts import WordHashes, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, odd_rows(), CLASHING).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# ---- word hashes

def test_long_texts_are_cut_at_white_space(monkeypatch):
    data = b"alpha beta\ngamma " * 50 + b"x" * 500 + b" end"
    whole = word_hashes(data, WordHashes()).tolist()
    monkeypatch.setattr("tidepanel.llm.texts.PIECE", 64)
    assert word_hashes(data, WordHashes()).tolist() == whole


# ---- line frequency

def base_numbers(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if again[w] > 1 for j in range(i, i + 5)}
    split = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(split) - len(set(split)), len(covered))


def test_line_frequency_on_odd_rows(odd):
    got = rows_of(lines.line_frequency(odd), "doc_id", *lines._MEASURES)
    assert got == sorted(((r[0], *base_numbers(r[1])) for r in odd_rows()), key=repr)


def test_boilerplate_depletes_documents(spark, empty):
    rng = random.Random(1)
    menu = prose(rng, 30)
    rows = [(i, f"{menu}\n{prose(rng, 5)}", "en", "a", 1) for i in range(25)]
    rows += [(100 + i, prose(rng, 60) + f"\nend {i}", "en", "a", 1) for i in range(25)]
    rows += [(200 + i, f"{menu}\n{prose(rng, 60)}", "en", "b", 1) for i in range(5)]
    docs = table(spark, rows)
    kept = {r["doc_id"]: r["kept"] for r in lines.line_frequency(docs).collect()}
    assert sorted(i for i, k in kept.items() if not k) == list(range(25))
    measured = lines.measured(docs, "doc_id", "text", "source")
    common = lines.boilerplate(measured, 20, 0.08)
    texts = {r["doc_id"]: r["text"] for r in lines.strip_lines(docs, common).collect()}
    assert texts[0] == rows[0][1].split("\n")[1] and texts[200] == rows[50][1] and len(texts) == len(rows)
    assert lines.line_frequency(empty).count() == 0


# ---- sharding

def test_shards_hold_groups_and_slots_have_no_gaps(spark, odd, empty):
    got = sharding.shard_documents(odd).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows()), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == want
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(s) == 1 for s in by_text.values())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert sharding.shard_documents(empty).count() == 0


def test_tree_of_schedules_is_near_the_plain_schedule(spark, monkeypatch):
    rng = random.Random(2)
    sizes = [int(rng.paretovariate(1.2) * 100) for _ in range(3000)]
    groups = spark.createDataFrame([(f"g{i}", s) for i, s in enumerate(sizes)], "item string, size long")
    import numpy as np
    plain = np.bincount(sharding.schedule(np.array(sizes), 16), sizes, 16).max()
    for bucket in (20_000, 20):
        monkeypatch.setattr(sharding, "GROUPS_A_BUCKET", bucket)
        placed = {r["item"]: r["shard"] for r in sharding.assign_groups(groups).collect()}
        assert len(placed) == len(sizes)
        loads = collections.Counter()
        for i, s in enumerate(sizes):
            loads[placed[f"g{i}"]] += s
        assert max(loads.values()) <= 1.02 * plain


# ---- similarity

def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and sets[j] and 100 * both >= 90 * len(x | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(x), least.get(find(i)) if x else r[0]) for i, (r, x) in enumerate(zip(rows, sets))), key=repr)


def near_copies(seed, groups, copies, words):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(rng, words + rng.randrange(20)).split()
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(len(text))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text), "en", "s", 1))
    return rows


def test_similar_documents_on_odd_rows(odd, empty):
    got = rows_of(jaccard.similar_documents(odd), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(odd_rows())
    assert jaccard.similar_documents(empty).count() == 0


@pytest.mark.parametrize("piece", [1024, 8])
def test_similar_documents_against_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(jaccard, "PIECE", piece)
    rows = near_copies(3, 6, 20, 90)
    got = rows_of(jaccard.similar_documents(table(spark, rows)), "doc_id", "n_shingles", "component_id")
    assert got == brute_components(rows)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    roots = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert roots == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


# ---- mixing

def test_mixture_meets_its_targets(spark, odd, empty):
    rng = random.Random(4)
    rows = [(i, prose(rng, 5 + rng.randrange(60)), "en", None if i % 9 == 0 else f"s{i % 4 if i % 2 else 0}", 1) for i in range(900)]
    got = mixing.mixture_report(table(spark, rows)).collect()
    assert len(got) == 900 and sorted(map(tuple, got), key=repr) == sorted(
        map(tuple, mixing.mixture_report(table(spark, rows[::-1])).collect()), key=repr)
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    names = sorted(n for n in size if n is not None) + [None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    want, open_names, left = {}, set(names), 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[n] for n in open_names)
        full = {n for n in open_names if level * weight[n] > 2 * size[n]}
        want |= {n: level * weight[n] for n in open_names}
        if not full:
            break
        want |= {n: 2.0 * size[n] for n in full}
        left -= sum(2 * size[n] for n in full)
        open_names -= full
    for n in names:
        assert math.isclose(target[n], want[n]) and abs(taken[n] - target[n]) <= 65
    assert mixing.mixture_report(odd).count() == len(odd_rows())
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixing.mixture_report(empty).count() == 0 and mixing.mix(empty).count() == 0
    times = {(r["doc_id"], r["size"]): r["times"] for r in mixing.mixture_report(odd).collect()}
    counted = collections.Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    assert counted[56] == times[56, 30_000]


# ---- personal data

def base_spans(text):
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(digits):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    out = []
    for kind, pattern in kinds.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_spans_keep_the_base(spark, odd, empty):
    rng = random.Random(6)
    bits = ["a.b+c@d-e.org", "x@y", "_@h.io@k.net.", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "0255.00001.3.4", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "4111111111111111", "+1 (425) 555-9684", "+12", "+1+2 333 444 555", "é", "\n", "word", "12", "3.14", "\U0001f600"]
    rows = [(i, rng.choice(["", " ", "ñ"]).join(rng.choice(bits) for _ in range(rng.randrange(12))), "en", "s", 1) for i in range(200)]
    rows.append((900, "call 1.1.1.1 " * 2_000, "en", "s", 1))
    got = {r["doc_id"]: r for r in personal.span_report(table(spark, rows, ("base", "added", "spans"))).collect()}
    for i, text, *_ in rows:
        want = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}
        assert sum(got[i][f"n_{k}"] for k in personal.KINDS) == len(want)
    assert personal.span_report(odd).count() == len(odd_rows()) and personal.span_report(empty).count() == 0


# ---- tokens

def test_token_counts_equal_the_library(spark, odd, empty):
    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(7)
    alphabet = ["a", "b1", " ", "\n", "'s", "é", "<|endoftext|>", "­", "²", "一", " ", "Ᲊ", "\U0001f600", "\x1c", "\x85", "<|endof"]
    texts = ["".join(rng.choice([*alphabet, chr(rng.randrange(32, 0x3000))]) for _ in range(rng.randrange(30))) for _ in range(300)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = rows_of(tokens.count_tokens(table(spark, rows), VOCABULARY), "doc_id", "n_bytes", "n_tokens")
    assert got == sorted(((i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(texts)), key=repr)
    got = rows_of(tokens.count_tokens(odd, VOCABULARY), "doc_id", "n_tokens")
    assert got == sorted(((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_rows()), key=repr)
    assert tokens.count_tokens(empty, VOCABULARY).count() == 0


def test_whole_tokens_are_proved():
    whole = tokens.counter(VOCABULARY).whole
    library = Tokenizer.from_file(VOCABULARY)
    assert len(whole) > 40_000
    for entry in random.Random(8).sample(sorted(whole), 500):
        assert len(library.encode(entry, add_special_tokens=False).ids) == 1


# ---- licences

def test_licence_lines(spark, odd, empty):
    rng = random.Random(9)
    said = {"Released under the MIT License.": "mit", "All rights reserved.": "all-rights-reserved", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
            "Licensed under the Apache License, Version 2.0.": "apache",
            "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    rows, want = [], {}
    for i in range(120):
        parts = [prose(rng, 20) for _ in range(3)]
        if i % 4 == 0:
            line, want[i] = rng.choice(list(said.items()))
            parts.insert(1, line)
        rows.append((i, "\n".join(parts), "en", "s", 1))
    rows.append((500, "You need a driving licence.\nThe public was not let in.", "en", "s", 1))
    got = {r["doc_id"]: (r["families"], r["spans"]) for r in licences.licence_report(table(spark, rows)).collect()}
    assert got == {r[0]: (want[r[0]], f"{want[r[0]]}:1") if r[0] in want else ("", "") for r in rows}
    assert licences.licence_report(odd).count() == len(odd_rows()) and licences.licence_report(empty).count() == 0


# ---- contamination

def brute_contamination(text, items):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    words, hit, names = cut(text), set(), set()
    for name, item in items:
        w = cut(item)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1 if windows else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add("" if name is None else str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_equals_all_windows(spark, odd, empty):
    rng = random.Random(10)
    items = [(i, prose(rng, rng.choice([3, 12, 13, 14, 30, 60]), 60)) for i in range(25)] + [(None, "lone words here now"), (90, None), (91, " . ")]
    items.append((92, items[0][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i in range(150):
        parts = [prose(rng, rng.randrange(40), 60)]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(w) + 1)
            parts += [" ".join(w[at : at + rng.choice([12, 13, 25, 60])]).upper(), prose(rng, rng.randrange(20), 60)]
        rows.append((i, ", ".join(parts), "en", "s", 1))
    rows += odd_rows()
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = rows_of(decontaminate.contamination(table(spark, rows, CLASHING), bench), *names)
    assert got == sorted(((r[0], *brute_contamination(r[1], items)) for r in rows), key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(odd, none).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


# ---- quality

def test_quality_is_learnt_and_held_out(spark, odd, empty):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.6
        text = prose(rng, 50) if good else " | ".join(f"w{rng.randrange(400)}###" for _ in range(30))
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    marked = spark.createDataFrame(labels + [(5000, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(table(spark, rows, ("score", "label")), marked).collect()}
    out = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert [i for i in range(600) if got[i]["held_out"]] == out
    assert sum(got[i]["predicted"] == labels[i][1] for i in out) >= 0.97 * len(out)
    scores = [r["score"] for r in quality.quality_scores(odd, marked).collect()]
    assert len(scores) == len(odd_rows()) and all(0 <= s <= 1 for s in scores)
    nothing = quality.quality_scores(odd, marked.where("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in nothing)
    assert quality.quality_scores(empty, marked).count() == 0


def test_sum_of_squares_equals_all_pairs():
    import numpy as np
    random_numbers = np.random.default_rng(1)
    model = quality.Machine(0.3, random_numbers.normal(size=50), random_numbers.normal(size=(50, 4)))
    places, values = np.array([3, 7, 9, 40]), np.array([0.5, -1.0, 0.2, 0.1])
    z = 0.3 + model.weights[places] @ values + sum(
        model.factors[places[i]] @ model.factors[places[j]] * values[i] * values[j] for i in range(4) for j in range(i))
    assert math.isclose(model.score(places, values), 1 / (1 + math.exp(-z)), rel_tol=1e-9)


# ---- backoff scores

def test_backoff_scores_equal_plain_counts(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(backoff, "CHUNK_ROWS", 5)
    got = {}
    for r in backoff.scores(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["log_score"]))
    texts = [(r[0], WORD.findall((r[1] or "").translate(LOWER))) for r in odd_rows()]
    counts = [collections.Counter([*zip(w), *zip(w, w[1:]), *zip(w, w[1:], w[2:])]) for _, w in texts]
    every = sum(counts, collections.Counter())
    total = sum(len(w) for _, w in texts)
    for (name, w), own in zip(texts, counts):
        want = 0.0
        for i, c in enumerate(w):
            tri, bi = (tuple(w[i - 2 : i + 1]), tuple(w[i - 1 : i + 1])) if i > 1 else (None, tuple(w[i - 1 : i + 1]) if i else None)
            if tri and every[tri] > own[tri]:
                want += math.log((every[tri] - own[tri]) / (every[tri[:2]] - own[tri[:2]]))
            elif bi and every[bi] > own[bi]:
                want += math.log(0.4 * (every[bi] - own[bi]) / (every[bi[:1]] - own[bi[:1]]))
            else:
                want += math.log(0.16 * max(0.5, every[(c,)] - own[(c,)]) / max(1, total - len(w)))
        assert any(n == len(w) and (s is None if not w else math.isclose(s, want, rel_tol=1e-9)) for n, s in got[name])
    assert backoff.scores(empty).count() == 0


def test_clashing_columns_pass_through_the_mix(odd):
    assert set(CLASHING) <= set(mixing.mix(odd).columns)
    assert odd.where(F.col("doc_id").isNull()).count() == 2


def changed_copies(count, words, changes, seed):
    """Near copies of one text, each with a few words of its own."""
    rng = random.Random(seed)
    base = prose(rng, words).split()
    rows = []
    for i in range(count):
        own = list(base)
        for j in rng.sample(range(words), changes):
            own[j] = f"own{rng.randrange(10**9)}"
        rows.append((i, " ".join(own), "en", "s", 1))
    return rows


def compared_pairs(spark, monkeypatch, rows):
    """Pairs that the rounds compare, and the components."""
    counts = []

    def counted(pairs, sets):
        counts.append(pairs.count())
        return real(pairs, sets)

    real = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", counted)
    found = jaccard.similar_documents(table(spark, rows).repartition(4)).select("component_id").distinct().count()
    return sum(counts), found


def test_pairs_grow_with_a_near_copy_group_and_not_with_its_square(spark, monkeypatch):
    pairs = {}
    for n in (400, 1600):
        pairs[n], components = compared_pairs(spark, monkeypatch, changed_copies(n, 200, 1, n))
        assert components == 1
        monkeypatch.undo()
    assert pairs[1600] < 1600 * 40 and pairs[1600] < 6 * pairs[400]


def test_sketches_tell_unrelated_sets_of_any_size_apart():
    rng = random.Random(2)
    for n in (40, 1000, 6000, 20_000):
        sets = [jaccard.shingles(prose(rng, n, 10**6).encode(), WordHashes()) for _ in range(4)]
        sizes = jaccard.np.array([len(s) for s in sets])
        assert (jaccard._close(sizes, [jaccard.sketch(s) for s in sets]) == jaccard.FAR).all()
    close = sets[0][:-50]
    apart = jaccard._close(jaccard.np.array([len(sets[0]), len(close)]), [jaccard.sketch(sets[0]), jaccard.sketch(close)])
    assert 0 < apart[0, 1] <= 50


def test_row_keys_leave_columns_of_their_name_alone(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 40), "en", "s", 1) for i in range(20)] + [(20, "short", "en", "s", 1)]
    for extra in (("__file", "__row"), ("__row",)):
        docs = table(spark, rows)
        for name in extra:
            docs = docs.withColumn(name, F.lit(1))
        for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_duplicates):
            kept = stage(spark, docs, "")
            assert kept.columns == docs.columns
            assert sorted(tuple(r[n] for n in extra) for r in kept.collect()) == [(1,) * len(extra)] * (
                20 if stage is corpus_pipeline.quality_rules else 21)


def test_mixing_returns_columns_of_any_name(spark):
    rows = [(i, prose(random.Random(i), 20), "en", f"s{i % 2}", 1) for i in range(30)]
    docs = table(spark, rows, ("__place", "__source", "__times", "row"))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 30
    assert {tuple(r)[5:] for r in mixed.collect()} == {("x",) * 4}
