"""The SimHash step of the near-duplicates at a Jaccard similarity of 0.8."""

import random

import numpy as np
from pyspark.sql import functions as F

from citeloom.llm import near_copies as N
from citeloom.llm import simhash_dedup

from .test_near_copies import edited


def texts():
    draw, rows = random.Random(12), []
    for c in range(12):
        base = [f"b{c}w{draw.random()}" for _ in range(300)]
        rows += [(100 * c + k, edited(draw, base, draw.choice((0, 1, 2, 4, 9)))) for k in range(9)]
    return [*rows, (9_000, ""), (9_001, None)]


def test_pairs_within_bits_are_all_found(spark):
    rows = texts()
    sets = {N.key(t): N.shingle_set(t) for _, t in rows}
    sims = {fp: simhash_dedup.simhash_of(s) for fp, s in sets.items()}
    plain = {fp: sum(1 << b for b in range(64) if len(s) and 2 * int(((s >> np.uint64(b)) & np.uint64(1)).sum()) > len(s)) for fp, s in sets.items()}
    assert sims == plain
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    distinct = N.written(N._keys(docs, "doc_id", "text").groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("sim").alias("sim"), F.first("bands").alias("bands")), "distinct")
    got = {(r.u, r.v) for r in N.within_bits(distinct, hot=1000).collect()}
    want = {(u, v) for u in sims for v in sims if u < v and (sims[u] ^ sims[v]).bit_count() <= N.BITS}
    assert len(set(sims.values())) == len(sims) and got == want and len(want) > 20
    few = {(r.u, r.v) for r in N.within_bits(distinct, hot=2).collect()}
    assert few and few <= want
    # SimHash joins them without a single key of MinHash
    alone = {(min(r), max(r)) for r in N.links(docs, distinct.withColumn("bands", F.array().cast("array<bigint>"))).collect()}
    assert alone == {(u, v) for u, v in want if N.similarity(sets[u], sets[v]) >= N.LEAST}


def test_sets_of_one_simhash_are_a_star(spark):
    distinct = spark.createDataFrame([(i, 7) for i in range(40)] + [(100, 8), (101, -1)], "fp long, sim long")
    got = {(r.u, r.v) for r in N.within_bits(distinct).collect()}
    assert got == {(0, i) for i in range(1, 40)} | {(0, 100)}
