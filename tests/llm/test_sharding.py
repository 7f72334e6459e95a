import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.llm import sharding


def places(spark, sizes):
    rows = [(i, a) for i, n in enumerate(sizes) for a in range(n)]
    return spark.createDataFrame(rows, "part int, at long").repartition(3)


@pytest.mark.parametrize(("sizes", "shards"), [([400, 0, 37, 1], 4), ([1], 3), ([5, 5], 16), ([900], 1), ([700, 300], 7)])
def test_matrix_has_the_margins(spark, sizes, shards):
    out = sharding.communication(places(spark, sizes), shards).collect()
    assert all(r.n > 0 for r in out)
    by_part, by_shard = Counter(), Counter()
    for r in out:
        by_part[r.part] += r.n
        by_shard[r.shard] += r.n
    assert [by_part[i] for i in range(len(sizes))] == sizes
    total = sum(sizes)
    assert [by_shard[j] for j in range(shards)] == [total // shards + (j < total % shards) for j in range(shards)]


def test_matrix_is_hypergeometric(spark):
    """The mean and variance of an entry over seeds are those of drawing without replacement."""
    sizes, shards, n = [6, 6], 2, 16
    cells = places(spark, sizes).cache()
    entries = []
    for k in range(n):
        entries.append(sum(r.n for r in sharding.communication(cells, shards, f"s{k}").collect() if (r.part, r.shard) == (0, 0)))
    mean, var = sum(entries) / n, sum(x * x for x in entries) / n - (sum(entries) / n) ** 2
    # 6 of 12 drawn, 6 marked: mean 3, variance 6 * 1/2 * 1/2 * 6/11 = 0.818; multinomial counts would have 1.5
    assert abs(mean - 3) < 0.8 and 0.2 < var < 1.5, (mean, var)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i}", "x", i) for i in range(3000)] + [(5000 + i, "the same copy", "y", 0) for i in range(1500)]
    rows += [(None, None, None, None)] * 3 + [(7, "", "z", 1)] * 4 + [(8, "é" * 50_000, "z", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, Slot long").repartition(6)


def test_shards_are_exact_and_slots_gapless(docs):
    out = sharding.digest(docs).collect()
    n = docs.count()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(16))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {len(v) for v in by.values()} <= {n // 16, n // 16 + 1}
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}


def test_copies_spread_like_other_rows(docs):
    out = sharding.shuffle(docs)
    assert out.columns == ["doc_id", "text", "a.b", "shard", "slot"]
    rows = out.collect()
    share = Counter(r.shard for r in rows if r.text == "the same copy")
    chi = sum((share[j] - 1500 / 16) ** 2 / (1500 / 16) for j in range(16))
    assert chi < 38  # 15 degrees of freedom, one in a thousand
    neighbours = sum(a.doc_id is not None and b.doc_id is not None and abs(a.doc_id - b.doc_id) == 1 for a, b in zip(sorted(rows, key=lambda r: (r.shard, r.slot)), sorted(rows, key=lambda r: (r.shard, r.slot))[1:]))
    assert neighbours < 20  # the order is not the input's


def test_reruns_agree_and_seeds_differ(docs):
    one, two = (sorted(map(tuple, sharding.digest(docs).collect()), key=str) for _ in range(2))
    assert one == two
    other = sorted(map(tuple, sharding.digest(docs, seed="other").collect()), key=str)
    assert one != other


def test_buckets_within_a_shard(docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 30)
    monkeypatch.setattr(sharding, "SENT_ENTRIES", 0)  # the matrix is joined, not sent
    by = {}
    for r in sharding.digest(docs, 5).collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_few_rows_and_none(spark, docs):
    assert sharding.digest(docs.limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in sharding.digest(docs.limit(1)).collect()] == [(0, 0)]
    assert sorted((r.shard, r.slot) for r in sharding.shuffle(docs.limit(5), 1).collect()) == [(0, i) for i in range(5)]
    with pytest.raises(ValueError, match="shards"):
        sharding.shuffle(docs, 0)


def test_no_python_in_the_plan(docs):
    plan = sharding.digest(docs.withColumn("x", F.lit(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
