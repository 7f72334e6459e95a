"""The pipeline's stages on the smallest tables, each held against a plain version of what it decides."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeloom.llm import pii, quality
from citeloom.llm.queries import tokenizer_path

from .test_mixing import fill
from .test_near_copies import brute as brute_classes
from .test_pii import brute as brute_spans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The input and every stage's output, written and read again as on a cluster."""
    folder, docs = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], DATA).write.parquet(f"file://{folder}/{name}")
        out.append(spark.read.parquet(f"file://{folder}/{name}"))
    return [df.collect() for df in out], [df.columns for df in out]


def test_stages(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    columns = steps[1]
    assert all(c == columns[0] for c in columns[:-1])


def test_quality_stage(spark, steps):
    before, after = steps[0][:2]
    docs = spark.createDataFrame(before, spark.read.parquet(f"{DATA}/documents.parquet").schema)
    kept = {r.doc_id for r in quality.judge(docs, spark.read.parquet(f"{DATA}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in after} == kept and len(after) == len(kept)
    marked = {r.doc_id for r in before if sum(c in "#*$%&|" for c in r.text) * 20 > len(r.text)}
    # with 80 trusted documents many n-grams of junk are too rare to tell
    assert len(kept & marked) <= 0.5 * len(marked) and len(kept) > 0.7 * (len(before) - len(marked))


def test_duplicates_stage(steps):
    """Held to five words and a similarity of 0.8: op1's two bits are the contract of its query alone."""
    before, after = steps[0][1:3]
    label = brute_classes([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == set(label.values()) and len(after) == len(set(label.values()))
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_personal_data_stage(steps):
    before, after = steps[0][2:4]
    text = {r.doc_id: r.text for r in before}
    assert set(text) == {r.doc_id for r in after}
    for r in after:
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
        if not pii.base_spans(text[r.doc_id]) and not list(pii.instances(text[r.doc_id], [])):
            assert r.text == text[r.doc_id]


def test_mixing_stage(steps):
    before, after = steps[0][3:5]
    rows = {tuple(r) for r in before}
    times = Counter(tuple(r) for r in after)
    assert set(times) <= rows and max(times.values()) <= 3
    size, taken = Counter(), Counter()
    for r in before:
        size[r.source] += len(r.text.split())
    for r in after:
        taken[r.source] += len(r.text.split())
    order = sorted(size)
    want = dict(zip(order, fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)))
    longest = {s: max(len(r.text.split()) for r in before if r.source == s) for s in order}
    assert all(abs(taken[s] - want[s]) <= longest[s] and taken[s] <= 3 * size[s] for s in order)  # documents are taken whole


def test_packing_stage(steps):
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    before, pieces = steps[0][4:]
    of = {}
    for r in before:
        of.setdefault(r.doc_id, []).append(plain.encode(r.text, add_special_tokens=False).ids + [2])
    assert {p.doc_id for p in pieces} == set(of)
    for k, copies in of.items():
        assert sum(p.length for p in pieces if p.doc_id == k) == sum(map(len, copies))
    once = {k: v[0] for k, v in of.items() if len(v) == 1}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and at & (at - 1) == 0
    single = [p for p in pieces if p.doc_id in once]
    for k in once:
        own = sorted((p for p in single if p.doc_id == k), key=lambda p: p.start)
        assert [p.ids_crc32 for p in own] == [zlib.crc32(np.asarray(once[k][p.start : p.start + p.length], "<u4").tobytes()) for p in own]
        assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))] and own[0].doc_tokens == len(once[k])


def test_empty_and_odd_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = "plain words that follow one another in a text of some length, none of them twice"
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 30, None, None, None), (3, good, "en", "s", 9), (3, good, "en", "s", 9), (None, good + " or other", None, None, None)]
    odd = spark.createDataFrame(rows, docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    for stage in stages.values():
        assert stage(spark, docs.limit(0), DATA).collect() == []
    assert all(r.text and r.text.startswith("plain") for r in stages["quality"](spark, odd, DATA).collect())
    kept = stages["near_duplicates"](spark, odd, DATA).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, "", "en", "s", 0), rows[3], rows[4]], key=str)
    hidden = stages["personal_data"](spark, odd, DATA).collect()
    assert Counter((r.doc_id, r.text, r.n_chars) for r in hidden) == Counter((i, t, len(t or "")) for i, t, *_ in rows)
    assert set(stages["mixing"](spark, odd, DATA).collect()) <= set(odd.collect())
    packed = stages["packing"](spark, odd, DATA).collect()
    assert sum(p.doc_tokens == 1 for p in packed) == 3 and sum(p.start == 0 for p in packed) == len(rows)


def test_stages_keep_clashing_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    names = ["n_words", "llr", "kept", "size", "target", "times", "__copy", "h", "extra", "fp", "row", "a.b"]
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, DATA)
        assert out.columns == wide.columns, name
        got = out.collect()
        assert got and all(r[n] == f"{n}:{r.doc_id}" for r in got for n in names), name


def test_run_gives_what_the_stages_give(spark, steps):
    out = corpus_pipeline.run(spark, DATA).collect()
    of = lambda rows: Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0)
    assert of(out) == of(steps[0][-1])
    assert sum(r.length for r in out) == sum(r.length for r in steps[0][-1])
