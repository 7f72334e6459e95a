import pytest

from citeloom.llm import mixing


def fill(sizes, weights, epochs):
    """Water-filling as told: share out, clamp, share the excess again."""
    total, capped, target = sum(sizes), set(), [0.0] * len(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in capped]
        rest = total - sum(epochs * sizes[i] for i in capped)
        for i in open_:
            target[i] = rest * weights[i] / sum(weights[j] for j in open_)
        over = [i for i in open_ if target[i] > epochs * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = float(epochs * sizes[i])
        capped.update(over)


@pytest.fixture(scope="module")
def docs(spark):
    rows, k = [], 0
    for source, n, words in [("a", 40, 30), ("b", 300, 7), ("c", 5, 50), (None, 900, 11), ("Z", 60, 1), ("é", 400, 9)]:
        for i in range(n):
            rows.append((k, " x" * (words + i % 5), source, "t", k))
            k += 1
    rows += [(k, None, "a", "t", 0), (k + 1, "", None, "t", 0), (k + 1, "", None, "t", 0), (None, "one two", "b", "t", 0), (None, "one two", "b", "t", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string, size long").repartition(5)


def test_targets_and_takings(docs):
    out = mixing.mix(docs, carry=False).collect()
    rows = docs.collect()
    assert len(out) == len(rows)
    order = sorted({r.source for r in rows if r.source}) + [None]
    sizes = [sum(len((r.text or "").split()) for r in rows if r.source == s) for s in order]
    want = dict(zip(sizes, fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 3)))
    assert len(want) == len(order)
    taken = {}
    for r in out:
        assert abs(r.target - want[r.source_size]) < 1e-6 * r.source_size
        assert 0 <= r.times <= 3
        taken[r.source_size] = taken.get(r.source_size, 0) + r.times * r.size
    for size, words in taken.items():
        assert abs(words - want[size]) <= 60, (size, words, want[size])  # about a document


def test_reruns_agree_and_columns_stay(docs):
    first = sorted(map(tuple, mixing.mix(docs).select("doc_id", "times").collect()), key=str)
    again = sorted(map(tuple, mixing.mix(docs.repartition(3)).select("doc_id", "times").collect()), key=str)
    assert first == again
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(t for _, t in first)
    assert set(out.collect()) <= set(docs.collect())  # target and size are the input's own, not the mix's
    odd = docs.withColumnsRenamed({"target": "__copy", "size": "a.b"})
    assert set(mixing.repeated(odd).collect()) <= set(odd.collect())


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    out = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert [(r.size, r.target, r.times) for r in out] == [(0, 0.0, 0)] * 2
