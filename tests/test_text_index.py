import random

import pytest
from pyspark.sql import functions as F

from citeloom.operators import search, text_index

SCHEMA = "chunk_id long, text string"


def ranked(df):
    return [(r.chunk_id, round(r.score, 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    words = ["the"] * 30 + ["of", "a"] * 10 + [f"w{i}" for i in range(60)] + ["Ünï", "5000.88"]
    out = [(i, " ".join(draw.choices(words, k=draw.randint(1, 60)))) for i in range(700)]
    return [*out, (900, None), (901, ""), (902, "the " * 4000), (903, "zebra the the"), (904, "Zebra, of the Ünï-w1")]


@pytest.fixture(scope="module")
def made(spark, rows, tmp_path_factory):
    index = text_index.TextIndex(spark, f"file://{tmp_path_factory.mktemp('text')}/i", "chunk_id", "long")
    index.update(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return index


QUERIES = ["the", "zebra the of", "5000.88 && (ünï) w1", "none zebra", "?!"]


@pytest.mark.parametrize("k", [2, 1000])
def test_equals_the_scan(spark, made, rows, k):
    df = spark.createDataFrame(rows, SCHEMA)
    for q in QUERIES:
        assert ranked(made.search(q, k)) == ranked(search.bm25(df, q, k)), q


def test_updates_and_merges_equal_the_scan(spark, rows, tmp_path, monkeypatch):
    index = text_index.TextIndex(spark, f"file://{tmp_path}/i", "chunk_id", "long")
    assert index.search("the", 3).count() == 0
    first, new = rows[:400], [(3, "w1 again"), *rows[400:]]
    index.update(spark.createDataFrame(first, SCHEMA))
    index.update(spark.createDataFrame(new, SCHEMA), spark.createDataFrame([(5,), (6,), (12345,)], "chunk_id long"))
    left = spark.createDataFrame([r for r in first if r[0] not in (3, 5, 6)] + new, SCHEMA)
    check = lambda: [ranked(index.search(q, 20)) for q in QUERIES] == [ranked(search.bm25(left, q, 20)) for q in QUERIES]
    assert check() and index.texts().count() == left.count()
    index.merge()
    assert check() and len(index.segments()) == 1 and index.segments()[0]["gone"] == 0
    monkeypatch.setattr(text_index, "MOST_SEGMENTS", 1)
    index.update(spark.createDataFrame([(5, "the zebra")], SCHEMA))
    left = left.unionAll(spark.createDataFrame([(5, "the zebra")], SCHEMA))
    assert check() and len(index.segments()) == 1


def test_a_search_reads_its_terms_only(made, monkeypatch, spark, rows, tmp_path):
    plan = made.search("zebra w1", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term" in plan or "EqualTo(term" in plan
    monkeypatch.setattr(text_index, "BUCKET_POSTINGS", 500)
    index = text_index.TextIndex(spark, f"file://{tmp_path}/i", "chunk_id", "long")
    index.update(spark.createDataFrame(rows, SCHEMA))
    assert index.segments()[0]["buckets"] > 8
    files = index.search("zebra", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in files and ranked(index.search("zebra", 5)) == ranked(search.bm25(spark.createDataFrame(rows, SCHEMA), "zebra", 5))


def test_frequent_terms_bring_no_candidates(made):
    """`zebra` is in two texts: with k = 2 the texts that have only `the` cannot come in, and are not aggregated."""
    plan = made.search("zebra the", 2)._jdf.queryExecution().analyzed().toString()
    assert "LeftSemi" in plan
    assert [r.chunk_id for r in made.search("zebra the", 2).collect()] in ([903, 904], [904, 903])


def test_the_second_of_two_updates_raises(spark, tmp_path):
    index = text_index.TextIndex(spark, f"file://{tmp_path}/i", "chunk_id", "long")
    create = index.pointers.create
    index.pointers.create = lambda n, v: create(n, v | {}) and create(n, v)  # the number is taken meanwhile
    with pytest.raises(RuntimeError, match="came first"):
        index.update(spark.createDataFrame([(1, "a")], SCHEMA).where(F.lit(True)))
