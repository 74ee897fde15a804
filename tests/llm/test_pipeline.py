"""The pipeline stage by stage against the operators' brute-force versions, and the registered queries."""

import collections
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.cases import SCHEMA, odd_rows, prose, table
from tests.llm.test_operators import base_numbers, brute_components, brute_contamination, near_copies
from tidepanel.session import shared_folder

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op1_line_frequency", "op3_jaccard_components", "op4_source_mixture", "op8_benchmark_overlap",
                                  "op11_accumulator_search", "op12_hard_negatives", "op13_similar_vectors"])
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = con.execute(entry.oracle_sql()[name])
    order = sorted(range(len(result.description)), key=lambda i: result.description[i][0])
    assert [result.description[i][0] for i in order] == columns
    want = sorted(repr([row[i] for i in order]) for row in result.fetchall())
    assert sorted(repr(list(row)) for row in df.select(*columns).collect()) == want


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names if n[2].isdigit()] == [f"op{i}" for i in range(1, 14)]
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_stages_against_brute_force(spark):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = odd_rows() + [(300 + r[0], *r[1:]) for r in near_copies(12, 3, 6, 60)]
    rows += [(700 + i, f"{text} and then some words of our own", "en", "s0", 1) for i, (_, text) in enumerate(bench[:5])]
    stages = dict(corpus_pipeline.STAGES)

    def written(df):
        folder = shared_folder(spark, "stage")
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    def values(df):
        assert df.columns == docs.columns
        return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]

    docs = written(table(spark, rows, ("kept", "root", "shard")))
    kept = values(stages["quality_rules"](spark, docs, FOLDER))
    good = [r for r in rows if base_numbers(r[1])[0] >= 10 and 5 * base_numbers(r[1])[4] <= base_numbers(r[1])[0]]
    assert sorted(kept, key=repr) == sorted(good, key=repr)

    unique = values(stages["near_duplicates"](spark, docs, FOLDER))
    sizes = collections.Counter((c, n > 0) for _, n, c in brute_components(rows))
    assert len(unique) == sum(1 if shingled else n for (_, shingled), n in sizes.items())
    assert len({c for _, n, c in brute_components(unique) if n}) == sum(1 for _, n, _ in brute_components(unique) if n)

    clean = values(stages["decontamination"](spark, docs, FOLDER))
    assert sorted(clean, key=repr) == sorted((r for r in rows if not brute_contamination(r[1], bench)[4]), key=repr)

    mixed = values(stages["source_mixture"](spark, docs, FOLDER))
    assert set(mixed) <= set(rows) and 0.9 < sum(base_numbers(r[1])[0] for r in mixed) / (1.5 * sum(base_numbers(r[1])[0] for r in rows)) < 1.1
    placed = stages["shards"](spark, docs, FOLDER).collect()
    assert len(placed) == len(rows)


def test_empty_documents_pass_through(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        folder = shared_folder(spark, "stage")
        stage(spark, docs, FOLDER).write.parquet(folder)
        docs = spark.read.parquet(folder)
    assert docs.count() == 0


def test_one_of_a_large_copy_group_survives(spark):
    rng = random.Random(11)
    copy = "\n".join(prose(rng, 12) for _ in range(5))
    footer = "all rights reserved by the owners of this site and its many partners"
    own = "\n".join(prose(rng, 12) for _ in range(5))
    rows = [(i, copy, "en", "s0", 1) for i in range(100)]
    rows += [(100 + i, prose(rng, 60, 5_000), "en", "s0", 1) for i in range(175)]
    rows += [(275 + i, f"{footer}\nw{chr(97 + i)} is new", "en", "s0", 1) for i in range(25)]
    rows += [(300 + i, own, "en", "s1", 1) for i in range(20)] + [(320 + i, prose(rng, 60, 5_000), "en", "s1", 1) for i in range(180)]
    docs = table(spark, rows)
    for name in ("quality_rules", "near_duplicates"):
        folder = shared_folder(spark, "stage")
        dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER).write.parquet(folder)
        docs = spark.read.parquet(folder)
    left = sorted(r["doc_id"] for r in docs.collect())
    assert left == [0, *range(100, 275), 300, *range(320, 500)]
