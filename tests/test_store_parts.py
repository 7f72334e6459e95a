"""The store's parts: what a commit writes, two writers, old snapshots."""

import os
import random

import pytest
from pyspark.sql import functions as F

from citeloom import schema
from citeloom.plans import store
from citeloom.plans.store import Change

EDGE = "source_slug string, target_slug string"


def edges(spark, pairs):
    return spark.createDataFrame(pairs, EDGE)


def rows(db, name="references_edge"):
    return sorted(tuple(r) for r in db.table(name).collect())


@pytest.fixture()
def db(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db", part_rows=100)
    every = spark.range(2000).select(F.concat(F.lit("d"), F.col("id") % 300).alias("source_slug"), F.concat(F.lit("t"), "id").alias("target_slug"))
    hot = spark.range(1000).select(F.lit("hot").alias("source_slug"), F.concat(F.lit("h"), "id").alias("target_slug"))
    s.commit({"references_edge": every.unionAll(hot), "document": spark.createDataFrame([("a", "A")], "slug string, name string")})
    return s


def test_parts_tile_the_keys_and_a_hot_place_is_divided(db):
    parts = db.current()["references_edge"]
    assert len(parts) > 15 and max(p.rows for p in parts) < 300 and sum(p.rows for p in parts) == 3000  # ranges are of sampled bounds
    assert parts[0].lo == 0 and parts[-1].hi == 1 << 62 and all(a.hi == b.lo for a, b in zip(parts, parts[1:]))
    for p in parts:
        low, high = db._read("references_edge", [p]).select(F.min(store.position("references_edge")), F.max(store.position("references_edge"))).first()
        assert p.lo <= low and high < p.hi
    assert db.at("references_edge", "hot").count() == 1000 and db.at("references_edge", "none").isEmpty()


def test_one_reference_writes_one_file(db, tmp_path):
    before = db.current()
    db.change({"references_edge": Change(insert=edges(db.spark, [("a", "b")]))})
    after = db.current()
    new = set(after["references_edge"]) - set(before["references_edge"])
    assert len(new) == 1 and len(set(before["references_edge"]) - set(after["references_edge"])) == 1 and after["document"] == before["document"]
    files = [f for f in os.listdir(tmp_path / "db" / new.pop().path) if f.endswith(".parquet")]
    assert len(files) == 1 and len(rows(db)) == 3001
    db.change({"references_edge": Change(insert=edges(db.spark, [("a", "b")]))})
    assert len(rows(db)) == 3001
    db.change({"references_edge": Change(delete=edges(db.spark, [("a", "b")]))})
    assert len(rows(db)) == 3000


def test_changes_equal_whole_tables(db):
    spark, want = db.spark, set(rows(db))
    place = spark.createDataFrame([("hot",), ("d7",)], "source_slug string")
    db.change({"references_edge": Change(delete=place, insert=edges(spark, [("d7", "x"), ("hot", "y"), ("d8", "t8")]))})
    want = {r for r in want if r[0] not in ("hot", "d7")} | {("d7", "x"), ("hot", "y")}
    assert set(rows(db)) == want
    db.change({"references_edge": Change(delete=spark.createDataFrame([("t9",), ("t10",), ("none",)], "target_slug string"))})
    want = {r for r in want if r[1] not in ("t9", "t10")}
    assert set(rows(db)) == want and len(rows(db)) == len(want)
    db.change({"references_edge": Change(delete=db.table("references_edge"))})
    assert rows(db) == [] and [(p.lo, p.hi) for p in db.current()["references_edge"]][0][0] == 0
    db.change({"references_edge": Change(upsert=edges(spark, [("q", "r")]))})
    assert rows(db) == [("q", "r")]


def test_upsert_and_add(db):
    spark = db.spark
    doc = lambda *r: spark.createDataFrame(list(r), "slug string, name string")
    db.change({"document": Change(upsert=doc(("a", "A2"), ("b", "B")))})
    assert rows(db, "document") == [("a", "A2"), ("b", "B")]
    kept = db.current()
    with pytest.raises(schema.DuplicateKeyError):
        db.change({"document": Change(add=doc(("a", "A3"))), "references_edge": Change(insert=edges(spark, [("u", "v")]))})
    assert db.current() == kept and ("u", "v") not in rows(db)


def test_two_writers(db, tmp_path):
    """The second writer finds its number taken and makes its change anew; a whole table made from an old snapshot is refused."""
    other = store.Store(db.spark, f"file://{tmp_path}/db", part_rows=100)
    calls = []

    def mine(t):
        if not calls:
            other.change({"references_edge": Change(insert=edges(db.spark, [("other", "o")]))})
        calls.append(t["references_edge"].count())
        return {"references_edge": Change(insert=edges(db.spark, [("mine", "m")]))}

    db.change(mine)
    assert calls == [3000, 3001] and {("other", "o"), ("mine", "m")} <= set(rows(db))

    whole = db._written

    def late(*args):
        out = whole(*args)
        other.change({"document": Change(upsert=db.spark.createDataFrame([("z", "Z")], "slug string, name string"))})
        return out

    db._written = late
    with pytest.raises(store.ConcurrentCommitError):
        db.commit({"document": db.spark.createDataFrame([("w", "W")], "slug string, name string")})
    assert rows(db, "document") == [("a", "A"), ("z", "Z")]


def test_torn_pointers_and_old_snapshots(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db", keep=3)
    for i in range(6):
        s.change({"references_edge": Change(insert=edges(spark, [("a", f"b{i}")]))})
    assert len(s.pointers.numbers()) == 3 and len(os.listdir(tmp_path / "db" / "references_edge")) <= 6
    live = {p.path for n in s.pointers.numbers() for p in store._parts(s.pointers.read(n))["references_edge"]}
    there = {f"references_edge/{t}/{p}" for t in os.listdir(tmp_path / "db" / "references_edge") for p in os.listdir(tmp_path / "db" / "references_edge" / t) if p.startswith("__part")}
    assert there == live
    (tmp_path / "db" / "_current" / f"{s.pointers.numbers()[-1] + 1:012d}").write_text('{"references_edge"')  # a writer died
    assert len(rows(s)) == 6
    s.change({"references_edge": Change(insert=edges(spark, [("a", "c")]))})
    assert len(rows(s)) == 7


def counting(spark, df):
    """df, and an accumulator of how many of its rows were computed."""
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            n.add(len(b))
            yield b

    return df.mapInPandas(run, df.schema), n


def test_a_commit_computes_its_rows_once(spark, tmp_path):
    """store_parts: a table is not computed for its count, its bounds and its rows; its parts are of exact counts."""
    s = store.Store(spark, f"file://{tmp_path}/db", part_rows=100)
    df, n = counting(spark, spark.range(1000).select(F.concat(F.lit("d"), "id").alias("source_slug"), F.lit("t").alias("target_slug")))
    s.commit({"references_edge": df})
    parts = s.current()["references_edge"]
    assert n.value == 1000 and len(parts) < 20 and max(p.rows for p in parts) <= 90
    assert [p.rows for p in parts] == [s._read("references_edge", [p]).count() for p in parts]
    with pytest.raises(schema.DuplicateKeyError):
        s.commit({"references_edge": s.table("references_edge").unionAll(edges(spark, [("d7", "t")]))})
    assert s.current()["references_edge"] == parts and not os.listdir(tmp_path / "db" / "_staged")


def test_a_deletion_computes_what_goes_once(db):
    """store_deletion: rows that go are not computed for the parts they lie in and again for the parts' rows; tables without rows are left alone."""
    gone, n = counting(db.spark, edges(db.spark, [("d7", f"t{300 * i + 7}") for i in range(5)]))
    want = {r for r in rows(db) if r not in {("d7", f"t{300 * i + 7}") for i in range(5)}}
    db.change({"references_edge": Change(delete=gone), "chunk": Change(delete=gone)})
    assert n.value == 5 and set(rows(db)) == want and len(want) == 2995 and db.current()["chunk"] == []


def test_the_part_of_a_position_is_found_by_halving(spark):
    draw = random.Random(1)
    lows = [0, *sorted(draw.sample(range(1, 1 << 62), 3000))]
    parts = [store.Part("", lo, hi, 1) for lo, hi in zip(lows, [*lows[1:], 1 << 62])]
    at = [*draw.sample(lows, 500), *(lo - 1 for lo in draw.sample(lows[1:], 500)), 0, (1 << 62) - 1]
    for some in (parts, parts[:1], parts[:2], parts[:3], parts[:1024]):
        index = store._index(F.col("at"), some)
        got = spark.createDataFrame([(a,) for a in at], "at long").select("at", index.alias("i")).collect()
        assert all(r.i == max(k for k, p in enumerate(some) if p.lo <= r.at) for r in got)
    plan = spark.range(9).select(store._index(F.col("id"), parts).alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "filter(" not in plan
