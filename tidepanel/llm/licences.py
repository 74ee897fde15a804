"""Licence scan by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a line.  Its word n-grams (one to three words) are the features of a sparse multinomial
logistic regression over licence families and an unknown class.  It is trained on licence wordings in
several frames, alone and inside ordinary paragraphs, against a bounded sample of ordinary paragraphs
of the corpus and some near misses.  n-grams that more than one in a hundred ordinary paragraphs have
tell nothing and are left out; an elastic net leaves few weights.  Per family, predictions are followed
down a calibration half to the lowest probability at which at least ``PRECISION`` of them were right; at
the next one below, or at ``LEAST_PROBABILITY`` if there is none, a paragraph is unknown.  A prediction counts when a template of its family confirms it: most of the
template's words and word pairs stand in the paragraph.

A paragraph can only leave the unknown class through a weighted n-gram, and each of those has a rarest
word.  Paragraphs without any of these words are set aside by one array test, which loses nothing; the
others are exploded and joined with the table of weights (at most ``MOST_GRAMS`` rows, sent to all
executors), and weights are summed by paragraph before the shuffle.

Edge cases: null texts have no paragraphs; lines without words are no paragraphs; repeated rows are
scanned each; a corpus with no ordinary paragraphs is scanned with the near misses as the only
negatives; an empty table gives an empty result; columns besides the named ones are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.texts import KEY, keyed
from tidepanel.session import cut_lineage

# Public licence wordings by family.
TEMPLATES = {
    "agpl": ["GNU Affero General Public License", "AGPL-3.0", "GNU Affero General Public License, version 3"],
    "all-rights-reserved": ["All rights reserved.", "No part of this publication may be reproduced"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "BSD License",
            "Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["CC0 1.0", "dedicated to the public domain", "Creative Commons Zero"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License, version 2", "GNU General Public License",
            "GPL-3.0", "GPL-2.0"],
    "lgpl": ["GNU Lesser General Public License", "LGPL-2.1", "GNU Lesser General Public License, version 3"],
    "mit": ["MIT License", "The MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy"],
    "mpl": ["Mozilla Public License, version 2.0", "MPL-2.0", "Mozilla Public License"],
}
FRAMES = (
    "{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.",
    "This software is distributed under the terms of the {}.", "See the {} for details.", "The code is available under {}.",
    "Copyright 2020. {}",
)
NEAR_MISSES = (
    "You need a driving licence to rent a car.", "The license plate was hard to read.", "She teaches at MIT.",
    "An apache helicopter passed.", "All the rights of the citizens were reserved for later debate.",
    "The general public was not let in.", "A version 3 of the plan was released under pressure.",
    "The commons were open to the public.", "A creative attribution of the painting.", "He was free of charge.",
    "The terms of the agreement are under review.", "See the appendix for details.", "The code is available.",
)
FAMILIES = ("unknown", *sorted(TEMPLATES))
NEGATIVES = 3_000
MOST_GRAMS = 20_000
PRECISION = 0.95
LEAST_PROBABILITY = 0.5
LEAST_COMMON = 3
CONFIRMED = 0.6


def words_of(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams_of(words: Column) -> Column:
    """The distinct runs of one to three words."""
    def runs(k: int) -> Column:
        last = F.size(words) - k
        return F.when(last >= 0, F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, k), " "),
        )).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(words, runs(2), runs(3)))


def with_grams(df: DataFrame, text: str) -> DataFrame:
    """Add ``grams`` of a text column; the words are a column first, or each run would cut the text again."""
    return df.withColumn("__words", words_of(F.col(text))).withColumn("grams", grams_of(F.col("__words"))).drop("__words")


def paragraphs(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns, paragraph, text`` for each line of ``text`` with a word."""
    return docs.select(*columns, F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))


def templates(spark) -> DataFrame:
    """``family, template, of, gram``: the ``of`` words and word pairs of each template."""
    rows = [(FAMILIES.index(f), t) for f, texts in TEMPLATES.items() for t in texts]
    wanted = F.filter("grams", lambda g: F.size(F.split(g, " ")) < 3)
    known = with_grams(spark.createDataFrame(rows, "family int, t string"), "t").select("family", "t", wanted.alias("w"))
    return known.select("family", F.col("t").alias("template"), F.size("w").alias("of"), F.explode("w").alias("gram"))


def confirmed(grams: DataFrame, *columns: str) -> DataFrame:
    """``columns, family`` for paragraphs (columns, gram) that hold most of a template of the family."""
    known = templates(grams.sparkSession)
    return (
        grams.join(F.broadcast(known), "gram").groupBy(*columns, "family", "template", "of").count()
        .where(F.col("count") >= CONFIRMED * F.col("of")).select(*columns, "family").distinct()
    )


def training_set(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Labelled n-gram rows (label, grams, half) of ordinary and licence paragraphs; the wordings' n-grams."""
    spark = docs.sparkSession
    total = max(1, docs.count())
    share = min(1.0, NEGATIVES / total)
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    lines = (
        paragraphs(sample).groupBy("text").agg(F.count("*").alias("n"))
        .orderBy(F.xxhash64("text"), "text").limit(NEGATIVES).select("text")
    )
    near = spark.createDataFrame([(t,) for t in NEAR_MISSES], "text string")
    lines = cut_lineage(with_grams(lines.unionByName(near), "text").withColumn("line", F.xxhash64("text")))
    licensed = confirmed(lines.select("line", F.explode("grams").alias("gram")), "line").select("line").distinct()
    plain = cut_lineage(lines.join(licensed, "line", "left_anti").where(F.size("grams") > 0).select(
        "text", "grams", F.row_number().over(Window.orderBy("line", "text")).alias("n")))
    framed = [
        (FAMILIES.index(f), frame.format(t)) for f, texts in TEMPLATES.items() for t in texts for frame in FRAMES
    ]
    rows = [(i + 1, f, t) for i, (f, t) in enumerate(framed)]
    alone = spark.createDataFrame(rows, "n int, label int, t string")
    inside = alone.join(plain.select("n", "text"), "n").select("label", F.concat_ws(" ", "text", "t").alias("t"))
    texts = alone.select("label", "t").unionByName(inside)
    positive = with_grams(texts, "t").select("label", "grams")
    negative = plain.select(F.lit(0).alias("label"), "grams")
    half = F.pmod(F.xxhash64("grams"), F.lit(2)).alias("half")
    wording = with_grams(alone, "t").select(F.explode("grams").alias("g")).distinct().collect()
    return negative.select("*", half), positive.select("*", half), sorted(r["g"] for r in wording)


class Classifier:
    """Weights by n-gram, intercepts, limits by family and the words without which nothing is found."""

    def __init__(self, weights: dict[str, list[float]], intercepts: list[float], limits: dict[int, float], anchors: list[str]):
        self.weights, self.intercepts, self.limits, self.anchors = weights, intercepts, limits, anchors


def train(docs: DataFrame) -> Classifier:
    """Fit the classifier on wordings and a sample of ``docs`` (with a column ``text``)."""
    negative, positive, wording = training_set(docs)
    plain = negative.count()
    known = negative.select(F.explode(F.array_intersect("grams", F.lit(wording))).alias("g"))
    often = {r["g"]: r["count"] for r in known.groupBy("g").count().collect()}
    useful = [g for g in wording if often.get(g, 0) < max(LEAST_COMMON, plain / 100)]
    # Some thousand short rows: a few partitions keep each step of the fit short.
    rows = cut_lineage(
        negative.unionByName(positive).withColumn("grams", F.array_intersect("grams", F.lit(useful))).coalesce(4))
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=MOST_GRAMS, binary=True, minDF=2)
    fitted = counter.fit(rows.where("label > 0"))
    ready = fitted.transform(rows).withColumn("label", F.col("label").cast("double"))
    model = LogisticRegression(family="multinomial", regParam=0.001, elasticNetParam=0.5, maxIter=60).fit(
        ready.where("half = 0 or label > 0"))
    coefficients = model.coefficientMatrix.toArray()
    weights = {
        gram: [float(x) for x in coefficients[:, i]]
        for i, gram in enumerate(fitted.vocabulary) if abs(coefficients[:, i]).max() > 1e-6
    }
    judged = model.transform(ready.where("half = 1")).select(
        "label", "prediction", F.round(F.array_max(vector_to_array("probability")), 3).alias("p")).where("prediction > 0")
    down = Window.partitionBy("prediction").orderBy(F.desc("p"))
    steps = judged.groupBy("prediction", "p").agg(
        F.sum((F.col("label") == F.col("prediction")).cast("int")).alias("r"), F.count("*").alias("n"))
    steps = steps.withColumns({
        "good": F.sum("r").over(down) >= PRECISION * F.sum("n").over(down), "below": F.lead("p").over(down)})
    chosen = steps.where("good").groupBy("prediction").agg(F.min_by("below", "p").alias("below")).collect()
    limits = {int(x["prediction"]): max(x["below"] or 0.0, LEAST_PROBABILITY) for x in chosen}
    anchors = sorted({min(g.split(" "), key=lambda w: (often.get(w, 0), w)) for g in weights})
    return Classifier(weights, [float(x) for x in model.interceptVector.toArray()], limits, anchors)


def licence_paragraphs(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``key, paragraph, family, probability`` of confirmed paragraphs of rows (key, text)."""
    spark = docs.sparkSession
    names = [f"w{i}" for i in range(len(FAMILIES))]
    table = spark.createDataFrame([(g, *w) for g, w in classifier.weights.items()] or [("", *[0.0] * len(names))],
                                  "gram string, " + ", ".join(f"{n} double" for n in names))
    lines = paragraphs(docs, *KEY).select(*KEY, "paragraph", words_of(F.col("text")).alias("words"))
    possible = lines.where(F.arrays_overlap("words", F.lit(classifier.anchors or [""])))
    # Only the n-grams of some wording go on; the arrays stay behind, as an explode would repeat them.
    wordings = table.select("gram").union(templates(spark).select("gram")).distinct()
    matched = cut_lineage(
        possible.select(*KEY, "paragraph", F.explode(grams_of(F.col("words"))).alias("gram"))
        .join(F.broadcast(wordings), "gram"))
    sums = matched.join(F.broadcast(table), "gram").groupBy(*KEY, "paragraph").agg(*[F.sum(n).alias(n) for n in names])
    odds = F.array(*[F.exp(F.col(n) + F.lit(b)) for n, b in zip(names, classifier.intercepts, strict=True)])
    scored = sums.select(*KEY, "paragraph", odds.alias("odds")).select(
        *KEY, "paragraph", (F.array_position("odds", F.array_max("odds")) - 1).cast("int").alias("family"),
        (F.array_max("odds") / F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)).alias("probability"))
    limits = F.coalesce(*[F.when(F.col("family") == k, F.lit(p)) for k, p in classifier.limits.items()], F.lit(2.0))
    predicted = scored.where((F.col("family") > 0) & (F.round("probability", 3) > limits))
    return predicted.join(confirmed(matched, *KEY, "paragraph"), [*KEY, "paragraph", "family"]).select(
        *KEY, "paragraph", F.get(F.lit(list(FAMILIES)), F.col("family")).alias("family"), "probability")


def licence_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, lines with a word, licence lines, their families, and ``family:line`` of each."""
    rows = keyed(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    classifier = train(rows.select("text").where("text is not null"))
    spotted = cut_lineage(licence_paragraphs(rows.select(*KEY, "text"), classifier))
    by_row = spotted.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("family")).alias("families"),
        F.array_sort(F.collect_list(F.struct("paragraph", "family"))).alias("spans"))
    n_lines = F.size(F.filter(F.split("text", "\n"), lambda s: s.rlike("[A-Za-z0-9]")))
    joined = rows.select(*KEY, "doc_id", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long").alias("n_paragraphs"))
    return joined.join(by_row, list(KEY), "left").select(
        "doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_licence"),
        F.coalesce(F.concat_ws(",", "families"), F.lit("")).alias("families"),
        F.coalesce(F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["family"], s["paragraph"]))), F.lit(""))
        .alias("spans"),
    )
