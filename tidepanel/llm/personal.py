"""Personal data by candidate gradient boosting, in DataFrame functions only.

*Base spans* are matches of strict patterns that pass a check (address parts, Luhn digits, number of
digits).  *Generators* with high recall propose further spans, which overlap each other and the base
spans: obfuscated addresses, loosely written or masked numbers, digit runs of any grouping.  Boosted
trees score a candidate from its format and its context: digits, groups, separators, the characters
around it and the words before it.  Per kind, the lowest threshold whose selection was right in at
least ``PRECISION`` of a calibration half is used, so a kind that cannot be told apart selects nothing.
Selected candidates that overlap no base span and no better candidate are added; base spans stay.

There are no labels of personal data, so the trees learn from the base spans of the whole table, rewritten in
their own context into the forms that people hide them in (``forms``): spelled at-signs and dots, masked or
oddly grouped numbers, other prefixes.  A candidate that covers a rewritten span with its kind is positive.
Negative are the candidates of the table's own texts that touch no base span, and those that give a
rewritten span another kind; a candidate of the texts that has such a form already (``veiled``) is of
unknown class and left out.  Trees learn on one half of the texts, thresholds on the other.  A kind
without base spans selects nothing.  Every row counts, repeated texts as often as they stand in the table;
they share a half, which the text's hash decides.

Trees see whole numbers and flags only, so candidates are counted by their features where the rows are
read, and the trees and thresholds are fitted on those counts as weights.  What is shuffled and fitted is
the table of different feature vectors, which grows far slower than the texts.  The learner tries every
value as a split point while there are at most ``BINS`` squared vectors; beyond that Spark chooses the
split points, and nothing else, from that many of them.

Everything else is computed inside the row with array functions.  Places are found by cutting the text at
the matches and summing lengths in blocks, and overlaps by one pass over the spans in order of their
starts: linear in the text but for that sort.

Edge cases: null counts as the empty text; texts without digits or at-signs skip the patterns; repeated
rows are searched each; very long texts are searched whole; of overlapping candidates with equal scores
the one that starts first stays; an empty table gives an empty result; without positives and negatives in
the table nothing is added; columns besides the named ones are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
TREES, DEPTH, BINS = 12, 4, 1024
BLOCK = 512

_LOCAL, _NAME = "A-Za-z0-9._%+-", "A-Za-z0-9-"
_FREE = rf"(?:\G|(?<![{_LOCAL}]))"
# The contract's patterns.  Possessive repeats and the look behind only keep the engine from trying the
# inside of a run again; what matches is the same, in linear time.
BASE = {
    "email": rf"{_FREE}[{_LOCAL}]++@[{_NAME}]++(?:\.[{_NAME}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": rf"{_FREE}[{_LOCAL}]++\x20?(?:@|\[at\]|\(at\)|\x20at\x20)\x20?[{_NAME}]++"
             rf"(?:\x20?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)\x20?[{_NAME}]++)*+",
    "ip": r"(?<![0-9])[0-9]++(?:(?:\[\.\]|\(\.\)|[.:])[0-9]++){2,7}+",
    "card": r"(?<![0-9])[0-9*xX]{2,}+(?:[\x20./-]?[0-9*xX]{2,}+)*+",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]++(?:[\x20().\/-]{1,3}+[0-9]++)++",
}
GATES = {"email": r"@|[\[(]at[\])]|\x20at\x20", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
BASE_GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
CONTEXT = {
    "phone_word": r"(?i)\b(?:phone|tel|call|fax|mobile|cell)\b",
    "email_word": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "card_word": r"(?i)\b(?:card|visa|credit|debit|account|iban|payment)\b",
    "ip_word": r"(?i)\b(?:ip|host|server|address|from)\b",
    "other_word": r"(?i)\b(?:token|key|hash|version|id|isbn|order|date|page|no)\b",
}
# Forms that only hidden spans have.
VEILED = {
    "words": r"[\[(](?:at|dot|\.)[\])]|\x20at\x20.*\x20dot\x20",
    "masks": r"^(?=.*[*xX]{4})(?=.*[0-9]{4})(?:[^0-9*xX]*[0-9*xX]){13,19}[^0-9*xX]*$",
}
CERTAIN = 2.0
FEATURES = ("kind", "length", "digits", "letters", "groups", "longest", "separators", "plus", "bracket", "at", "star",
            "marks", "dots", "before", "after", *CONTEXT)


def running(lengths: Column) -> Column:
    """Sums of all lengths before each one; by blocks, since appending to one long array is quadratic."""
    def sums(part: Column, start: Column) -> Column:
        return F.aggregate(
            part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
        )["out"]

    zero = F.lit(0)
    count = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(zero, count - 1), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    starts = sums(F.transform(blocks, lambda p: F.aggregate(p, zero, lambda a, n: a + n)), zero)
    return F.flatten(F.zip_with(blocks, starts, sums))


def found(df: DataFrame, text: str, patterns: dict[str, str], gates: dict[str, str], prefix: str) -> DataFrame:
    """Add ``{prefix}{kind}``: each kind's matches with place, text and what stands around them."""
    matches, pieces, steps = {}, {}, {}
    value = F.col(text)
    for kind, pattern in patterns.items():
        m, p = f"__m_{kind}", f"__p_{kind}"
        matches[m] = F.when(value.rlike(gates[kind]), F.regexp_extract_all(value, F.lit(pattern), F.lit(0)))
        pieces[p] = F.when(F.size(m) > 0, F.split(value, pattern, -1))
        lengths = F.zip_with(F.slice(p, 1, F.size(m)), m, lambda a, b: F.length(a) + F.length(b))
        steps[f"__s_{kind}"] = F.when(F.size(m) > 0, running(lengths))
    df = df.withColumns(matches).withColumns(pieces).withColumns(steps)
    spans = {f"{prefix}{kind}": _spans(index, kind) for index, kind in enumerate(patterns)}
    return df.withColumns(spans).drop(*matches, *pieces, *steps)


def _spans(index: int, kind: str) -> Column:
    """One kind's matches as structs, from the cut text and the summed lengths."""
    m, p, s = F.col(f"__m_{kind}"), F.col(f"__p_{kind}"), F.col(f"__s_{kind}")

    def span(i: Column) -> Column:
        before, match = F.get(p, i), F.get(m, i)
        start = F.get(s, i) + F.length(before)
        return F.struct(
            F.lit(index).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"),
            match.alias("match"), F.right(before, F.lit(24)).alias("before"),
            F.left(F.get(p, i + 1), F.lit(2)).alias("after"),
        )

    return F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.size(m) - 1), span))


def passes(kind: str, match: Column) -> Column:
    """The check of a base match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(9, 15)


def edge(char: Column) -> Column:
    """What kind of character stands next to a span."""
    return (
        F.when(F.coalesce(char, F.lit("")) == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike(r"\p{L}"), 2)
        .when(char.rlike("[0-9]"), 3).when(char.rlike("[\"'=]"), 4).otherwise(5)
    )


def described(span: Column) -> Column:
    """A candidate with its features."""
    match, before = span["match"], span["before"]

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(match, pattern, ""))

    groups = F.split(match, "[^0-9]+")
    numbers = [
        span["kind"], F.length(match), count("[^0-9]"), count("[^A-Za-z]"), F.size(groups),
        F.array_max(F.transform(groups, F.length)), count(r"[A-Za-z0-9]"), match.startswith("+"), match.contains("("),
        match.rlike(r"@|\bat\b"), match.rlike("[*xX]"),
        count("[^0-9*xX]"), count("[^.]") + F.size(F.split(match, r"\[dot\]|\(dot\)|\x20dot\x20")),
        edge(F.right(before, F.lit(1))), edge(F.left(span["after"], F.lit(1))),
        *[before.rlike(p) for p in CONTEXT.values()],
    ]
    return F.struct(
        span["kind"].alias("kind_no"), span["start"].alias("start"), span["end"].alias("end"),
        (match.rlike(VEILED["words"]) | match.rlike(VEILED["masks"])).alias("veiled"),
        *[n.cast("double").alias(f) for f, n in zip(FEATURES, numbers, strict=True)],
    )


SWEPT = "struct<start:int,end:int,score:double,span:struct<kind:int,start:int,end:int>>"


def certain(span: Column) -> Column:
    """A base span as an item of ``unbeaten``."""
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(CERTAIN).alias("score"), span.alias("span"))


def unbeaten(items: Column, kind: str = SWEPT) -> Column:
    """Of items (start, end, score, ...), those below ``CERTAIN`` that overlap no certain and no better one.

    One pass in order of starts keeps the best item of those that overlap in turn.  What it lets go of
    ends before the next start, so nothing later can overlap it.  Results gather in blocks.
    """
    none, nothing = F.lit(None).cast(kind), F.array().cast(f"array<{kind}>")

    def let_go(last: Column, when: Column) -> Column:
        return F.when(last.isNotNull() & (last["score"] < CERTAIN) & when, F.array(last)).otherwise(nothing)

    def step(state: Column, item: Column) -> Column:
        last = state["last"]
        clash = F.coalesce(item["start"] < last["end"], F.lit(False))
        both = (last["score"] >= CERTAIN) & (item["score"] >= CERTAIN)
        stays = F.when(both, F.when(last["end"] >= item["end"], last).otherwise(item)).when(
            last["score"] >= item["score"], last).otherwise(item)
        return F.struct(
            F.when(clash, stays).otherwise(item).alias("last"),
            F.concat(state["out"], let_go(last, ~clash)).alias("out"),
        )

    def block(state: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(state["last"].alias("last"), nothing.alias("out")), step)
        # one element, so that the pass over the block is not repeated for each of its fields
        return F.element_at(F.transform(F.array(done), lambda d: F.struct(
            d["last"].alias("last"), F.concat(state["out"], F.array(d["out"])).alias("out"))), 1)

    count = F.ceil(F.size(items) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    start = F.struct(none.alias("last"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    swept = F.aggregate(
        blocks, start, block, lambda s: F.concat(F.flatten(s["out"]), let_go(s["last"], F.lit(True))))
    return F.when(F.size(items) > 0, swept).otherwise(nothing)


def placed(span: Column) -> Column:
    """A span's kind and place alone."""
    return F.struct(span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"))


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """Add ``base``: the spans (kind, start, end) of the strict patterns, by kind and place."""
    rows = with_strict(docs, text)
    return rows.withColumn("base", F.transform("strict", placed)).drop("strict")


def with_strict(docs: DataFrame, text: str) -> DataFrame:
    """Add ``strict``: the checked matches of the strict patterns with their text and context."""
    found_in = found(docs, text, BASE, BASE_GATES, "__b_")

    def checked(kind: str) -> Column:
        return F.coalesce(F.filter(f"__b_{kind}", lambda s: passes(kind, s["match"])), F.array())

    return found_in.withColumn("strict", F.concat(*[checked(k) for k in KINDS])).drop(*[f"__b_{k}" for k in KINDS])


def forms(kind: str, match: Column) -> list[Column]:
    """The ways in which a span of a kind is hidden."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        name, host = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)

        def spelled(at: str, dot: str) -> Column:
            return F.concat(name, F.lit(at), F.replace(host, F.lit("."), F.lit(dot)))

        return [spelled(" [at] ", " [dot] "), spelled("(at)", "(dot)"), spelled(" at ", " dot "),
                spelled(" [at] ", "."), spelled("[at]", "[dot]"), spelled(" @ ", ".")]
    if kind == "ip":
        return [F.replace(match, F.lit("."), F.lit(dot)) for dot in ("[.]", "(.)")]
    if kind == "card":
        first, last = F.left(digits, F.lit(4)), F.right(digits, F.lit(4))
        masked = [F.concat(first, F.lit(m), last) for m in (" **** **** ", "-xxxx-xxxx-", "-XXXX-XXXX-", "********")]
        grouped = [F.regexp_replace(digits, "([0-9]{4})(?=[0-9]{2})", f"$1{mark}") for mark in "./"]
        return masked + grouped
    parts = r"^([0-9]{2})([0-9]{3})([0-9]{3})([0-9]+)$"
    return [F.regexp_replace(digits, parts, form) for form in ("00$1 $2 $3 $4", "($2) $3-$4", "0$2 $3 $4", "$2-$3-$4", "00$1-$2-$3$4")]


def planted(rows: DataFrame) -> DataFrame:
    """Base spans rewritten into a hidden form between what stood around them: text, kind, place."""
    span = F.col("s")
    pick = F.pmod(F.xxhash64("s"), F.lit(1 << 20)).cast("int")
    hidden = F.coalesce(*[
        F.when(span["kind"] == i, F.get(F.array(*ways), pick % len(ways)))
        for i, ways in enumerate(forms(k, span["match"]) for k in KINDS)
    ])
    out = rows.select("half", F.explode_outer("strict").alias("s")).where(span.isNotNull()).withColumn("hidden", hidden)
    first = F.length(span["before"])
    return out.select(
        "half", span["kind"].alias("kind"), first.alias("first"), (first + F.length("hidden")).alias("last"),
        F.concat(span["before"], "hidden", F.coalesce(span["after"], F.lit(""))).alias("text"),
    )


def with_candidates(docs: DataFrame, text: str) -> DataFrame:
    """Add ``candidates``: what the generators propose, with features."""
    proposed = found(docs, text, GENERATORS, GATES, "__c_")
    described_all = [F.coalesce(F.transform(f"__c_{k}", described), F.array()) for k in KINDS]
    return proposed.withColumn("candidates", F.concat(*described_all)).drop(*[f"__c_{k}" for k in KINDS])


def tree_sql(node, names: tuple[str, ...]) -> str:
    """A fitted tree as nested CASE over the fields of ``c``."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{node.prediction()!r}D"
    split = node.split()
    left, right = tree_sql(node.leftChild(), names), tree_sql(node.rightChild(), names)
    return f"CASE WHEN c.{names[split.featureIndex()]} <= {split.threshold()!r}D THEN {left} ELSE {right} END"


def score_sql(model: GBTClassificationModel) -> str:
    """The probability of a fitted model as an SQL expression over a candidate ``c``."""
    parts = [
        f"{weight!r}D * ({tree_sql(tree._java_obj.rootNode() if hasattr(tree, '_java_obj') else tree, FEATURES)})"
        for weight, tree in zip(model.treeWeights, model.trees, strict=True)
    ]
    return f"1D / (1D + exp(-2D * ({' + '.join(parts)})))"


def counted(docs: DataFrame, text: str) -> DataFrame:
    """How often each feature vector stands in each half of the texts with each label: half, features, label, n."""
    half = F.pmod(F.xxhash64(text, F.lit("half")), F.lit(2)).alias("half")
    read = docs.select(F.col(text).alias("text")).where("text IS NOT NULL")
    # Outer explodes: the filter that Spark derives from an inner one would be pushed below and evaluate
    # the whole chain of patterns again for each reference.
    c, label = F.col("c"), F.col("label")
    hidden = with_candidates(planted(with_strict(read, "text").select(half, "strict")), "text")
    positive = hidden.withColumn("c", F.explode_outer("candidates")).where(
        (c["start"] < F.col("last")) & (c["end"] > F.col("first"))
    ).withColumn("label", (
        (c["kind_no"] == F.col("kind")) & (c["start"] <= F.col("first")) & (c["end"] >= F.col("last"))).cast("double"))
    rows = with_candidates(with_strict(read, "text"), "text").select(half, "strict", "candidates")
    candidate = rows.schema["candidates"].dataType.elementType.simpleString()
    item = f"struct<start:int,end:int,score:double,span:{candidate}>"

    def untouched(kind: int) -> Column:
        """The candidates of one kind, which are disjoint, that overlap no base span."""
        base = F.transform("strict", lambda b: F.struct(
            b["start"].alias("start"), b["end"].alias("end"), F.lit(CERTAIN).alias("score"),
            F.lit(None).cast(candidate).alias("span")))
        mine = F.transform(F.filter("candidates", lambda x: x["kind_no"] == kind), lambda x: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), F.lit(1.0).alias("score"), x.alias("span")))
        return unbeaten(F.array_sort(F.concat(base, mine)), item)

    clear = rows.select("half", F.concat(*[untouched(i) for i in range(len(KINDS))]).alias("clear"))
    negative = clear.select("half", F.explode_outer("clear").alias("item")).select(
        "half", F.col("item.span").alias("c")).where(c.isNotNull() & ~c["veiled"]).withColumn("label", F.lit(0.0))
    vectors = [part.select("half", *[c[f].alias(f) for f in FEATURES], label) for part in (positive, negative)]
    return vectors[0].unionByName(vectors[1]).groupBy("half", *FEATURES, "label").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, text: str) -> tuple[str, dict[int, float]] | None:
    """Score expression and thresholds by kind, learnt on all rows; None if they cannot tell anything apart."""
    labelled = cut_lineage(counted(docs, text))
    if labelled.where("half = 0").select("label").distinct().count() < 2:
        return None
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(
        labelled.where("half = 0").withColumn("weight", F.col("n").cast("double")))
    model = GBTClassifier(
        labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=11).fit(ready)
    score = score_sql(model)
    scored = labelled.where("half = 1").withColumn("c", F.struct(*FEATURES)).select(
        F.col("kind").cast("int").alias("kind_no"), "label", "n", F.round(F.expr(score), 3).alias("score"))
    steps = scored.groupBy("kind_no", "score").agg(
        F.sum(F.col("label").cast("long") * F.col("n")).alias("right"), F.sum("n").alias("n"))
    down = Window.partitionBy("kind_no").orderBy(F.desc("score"))
    good = steps.withColumns({"r": F.sum("right").over(down), "all": F.sum("n").over(down)}).where(
        F.col("r") >= PRECISION * F.col("all"))
    chosen = good.groupBy("kind_no").agg(F.min("score").alias("least")).collect()
    return score, {r["kind_no"]: r["least"] for r in chosen}


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, ``base`` and ``added`` spans (kind number, start, end in characters)."""
    read = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fitted = fit(read, "text")
    rows = with_base(read, "text")
    if fitted is None or not fitted[1]:
        return rows.withColumn("added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    score, least = fitted
    limits = " ".join(f"WHEN {k} THEN {t!r}D" for k, t in least.items())
    rows = with_candidates(rows, "text").withColumn("scored", F.expr(
        f"filter(transform(candidates, c -> named_struct('start', c.start, 'end', c.end, 'score', round({score}, 3), "
        f"'span', named_struct('kind', c.kind_no, 'start', c.start, 'end', c.end))), "
        f"s -> s.score >= CASE s.span.kind {limits} ELSE 3D END)"))
    rows = rows.withColumn("items", F.array_sort(F.concat(F.transform("base", certain), "scored")))
    return rows.select("doc_id", "base", F.transform(unbeaten(F.col("items")), lambda o: o["span"]).alias("added"))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas, by kind and start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def span_report(docs: DataFrame) -> DataFrame:
    """Per row: base spans by kind, their digest, and all spans."""
    rows = personal_spans(docs)

    def count(index: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == index)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
