import random

from citeloom.llm import near_copies as N
from citeloom.llm import simhash_dedup


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """Smallest reachable id by plain sets of five words, all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            either = len(sets[a] | sets[b])
            if a < b and (not either or len(sets[a] & sets[b]) >= 0.8 * either) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {i: low if x == high else x for i, x in label.items()}
    return label


def edited(draw, words, edits):
    words = list(words)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"e{draw.random()}"
    return " ".join(words)


def test_classes_equal_all_pairs(spark):
    draw, rows = random.Random(3), [(0, ""), (1, " \n"), (2, "one two")]
    for c in range(6):
        base = [f"b{c}w{draw.random()}" for _ in range(150)]
        rows += [(10 + 40 * c + k, edited(draw, base, draw.choice((0, 1, 2, 3, 5, 8)))) for k in range(25)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)
    for hot in (3, N.HOT_BLOCK):
        assert {r.doc_id: r.component_id for r in N.classes(docs, hot_block=hot).collect()} == want, hot
    assert sorted(r.doc_id for r in N.deduplicate(docs).collect()) == sorted(set(want.values()))


def test_cells_of_a_block_equal_all_pairs(spark, monkeypatch):
    """Blocks of several chunks, of which no pivot is near all: copies of copies, and texts that share a passage alone."""
    draw = random.Random(11)
    base, rows = [f"p{draw.random()}" for _ in range(120)], []
    for c in range(5):
        own = [edited(draw, base, 6).split()]
        for k in range(14):  # each an edit of an earlier one, so that ends of the chain are far apart
            own.append(edited(draw, draw.choice(own), draw.choice((1, 2, 3))).split())
        rows += [(100 * c + k, " ".join(w)) for k, w in enumerate(own)]
    rows += [(1000 + i, " ".join([*base, *[f"own{i}w{k}" for k in range(draw.choice((5, 20, 60)))]])) for i in range(40)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute(rows)
    assert 5 < len(set(want.values())) < len(rows)
    for sets, shingles in ((2_048, 2_000_000), (9, 2_000_000), (2_048, 1_500)):
        monkeypatch.setattr(N, "CHUNK_SETS", sets)
        monkeypatch.setattr(N, "CHUNK_SHINGLES", shingles)
        assert {r.doc_id: r.component_id for r in N.classes(docs, hot_block=3).collect()} == want, (sets, shingles)


def test_few_edited_words_do_not_save_a_copy(spark):
    draw = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    rows = [(i, edited(draw, base, 3)) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash_dedup.deduplicate(docs).count() > 1  # op1's contract keeps these apart
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert [r.doc_id for r in stage(spark, docs, "").collect()] == [0]


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, 1), (3, text + " ", 2), (3, "other text", 2), (9, None, 3), (8, " ", 3), (8, " ", 3), (None, text, 0), (None, "no id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = N.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, text + " "), (3, "other text"), (8, " "), (None, "no id")], key=str)
    assert N.classes(docs.limit(0)).count() == 0 == N.deduplicate(docs.limit(0)).count()
