"""Hidden personal data is added, clean text is left alone, and many spans in one text take seconds."""

import random
import time

from pyspark.sql import functions as F

from tidepanel.llm import personal

WORDS = "the report of last spring shows that river levels and harvest prices rose while traffic fell near town".split()


def numbers(rng):
    """Clean text with digits, dots and marks of many kinds."""
    return rng.choice([
        f"on {rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", f"at {rng.randrange(24)}:{rng.randrange(60):02}:{rng.randrange(60):02}",
        f"version {rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(400)}", f"order {rng.randrange(10**6)}-{rng.randrange(10**4)}",
        "met at noon", "look at this page", "a **bold** word", f"page {rng.randrange(900)}", f"{rng.random():.4f} and xxl",
        f"isbn 978-{rng.randrange(10)}-{rng.randrange(10**4):04}-{rng.randrange(10**4):04}-{rng.randrange(10)}", f"id {rng.randrange(10**9)}",
    ])


def luhn(rng):
    head = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(head))
    return head + str(-total % 10)


def plain(rng):
    card = luhn(rng)
    return rng.choice([
        f"contact {rng.choice(WORDS)}.{rng.choice(WORDS)}@{rng.choice(WORDS)}.example.org",
        f"from host {rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}",
        f"my card {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", f"phone +{rng.randrange(10, 99)} {rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}",
    ])


def hidden(rng):
    """A hidden form of other wording and values than the base spans, and its kind."""
    name, host = f"{rng.choice(WORDS)}{rng.randrange(90)}", f"{rng.choice(WORDS)}-shop"
    return rng.choice([
        ("email", f"{name} [at] {host} [dot] com"), ("email", f"{name}(at){host}(dot)net"), ("email", f"{name} at {host} dot org"),
        ("card", f"{rng.randrange(1000, 9999)} **** **** {rng.randrange(1000, 9999)}"), ("card", f"{rng.randrange(1000, 9999)}-XXXX-XXXX-{rng.randrange(1000, 9999)}"),
        ("ip", f"{rng.randrange(256)}[.]{rng.randrange(256)}[.]{rng.randrange(256)}[.]{rng.randrange(256)}"),
    ])


def said(rng, what):
    return " ".join(rng.choices(WORDS, k=9)) + " " + what + " " + " ".join(rng.choices(WORDS, k=9))


def test_hidden_forms_are_added_and_clean_text_is_left(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(1_200):
        rows.append((i, said(rng, numbers(rng) + " and " + numbers(rng) + (" " + plain(rng) if i % 3 == 0 else ""))))
    for i in range(2_000, 2_120):
        kind, form = hidden(rng)
        rows.append((i, said(rng, form)))
        start = rows[-1][1].index(form)
        want[i] = (kind, start, start + len(form))
    out = personal.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "added").collect()
    added = {r["doc_id"]: [(personal.KINDS[s["kind"]], s["start"], s["end"]) for s in r["added"]] for r in out}
    caught = sum(any(k == kind and a <= lo and b >= hi for k, a, b in added[i]) for i, (kind, lo, hi) in want.items())
    wrong = sum(len(a) for i, a in added.items() if i < 2_000)
    assert caught >= 0.9 * len(want), (caught, len(want))
    assert wrong <= 0.02 * caught, wrong


def test_every_row_is_learnt_from(spark):
    """Only few rows far from the start of the hash range hold what teaches the hidden forms of a kind."""
    rng = random.Random(5)
    rows = [(i, said(rng, numbers(rng))) for i in range(9_600)]
    mails = spark.createDataFrame(
        [(10_000 + i, said(rng, f"contact {rng.choice(WORDS)}.{i}@{rng.choice(WORDS)}.example.org")) for i in range(800)],
        "doc_id long, text string")
    late = mails.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) > 0.6 * (1 << 20))
    forms = [f"{rng.choice(WORDS)}{i} [at] {rng.choice(WORDS)}-shop [dot] com" for i in range(60)]
    hidden_rows = spark.createDataFrame([(20_000 + i, said(rng, f)) for i, f in enumerate(forms)], "doc_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(late).unionByName(hidden_rows)
    out = personal.personal_spans(docs).where("doc_id >= 20000").collect()
    assert sum(len(r["added"]) == 1 and r["added"][0]["kind"] == 0 for r in out) >= 54


def test_counts_cover_every_row(spark):
    """Two copies of a table have the same feature vectors, each twice as often."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, said(rng, numbers(rng) + " and " + plain(rng))) for i in range(300)], "doc_id long, text string")
    once, twice = ({tuple(r[:-1]): r["n"] for r in personal.counted(d, "text").collect()} for d in (docs, docs.unionByName(docs)))
    assert twice == {k: 2 * n for k, n in once.items()} and {k[-1] for k in once} == {0.0, 1.0}


def test_unbeaten_equals_brute_force(spark):
    """No certain span is met by a result, results are disjoint, and a candidate that meets nothing stays."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        spans = [(a := rng.randrange(3_000), a + rng.randrange(1, 12), rng.choice([0.5, 0.7, 0.9, 2.0])) for _ in range(rng.choice([0, 1, 5, 700]))]
        rows.append((i, sorted((a, b, s, (0, a, b)) for a, b, s in spans)))
    df = spark.createDataFrame(rows, f"id int, items array<{personal.SWEPT}>")
    for r in df.select("items", personal.unbeaten(F.array_sort("items")).alias("out")).collect():
        items, out = [tuple(x)[:3] for x in r["items"]], [tuple(x)[:3] for x in r["out"]]

        def meets(x, y):
            return x[0] < y[1] and y[0] < x[1]

        assert all(x in items and x[2] < 2 for x in out)
        assert not any(meets(x, y) for x in out for y in items if y[2] == 2)
        assert all(a[1] <= b[0] for a, b in zip(out, out[1:], strict=False))
        alone = [x for i, x in enumerate(items) if x[2] < 2 and not any(meets(x, y) for j, y in enumerate(items) if j != i)]
        assert set(alone) <= set(out)


def test_many_spans_in_one_text(spark):
    rows = [(i, said(random.Random(i), plain(random.Random(i)))) for i in range(60)] + [(99, "call 1.1.1.1 or a [at] b [dot] c " * 30_000)]
    start = time.monotonic()
    got = {r["doc_id"]: r for r in personal.span_report(spark.createDataFrame(rows, "doc_id long, text string")).drop("spans").collect()}
    assert got[99]["n_ip"] == 30_000 and time.monotonic() - start < 120
