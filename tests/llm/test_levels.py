"""Levels that are calibrated on every labelled row, whatever their number."""

import itertools

from citeloom.llm import common, quality, url_filter


def test_url_level_takes_in_every_shape(spark):
    """Against every level between the scores of all shapes, each by models of the half that it is not in."""
    names = ["".join(x) for x in itertools.product("abct", "abeo", "ins")]
    hosts = [f"{w}{'-casino' if i % 4 == 0 else 'cas' if i % 4 == 1 else 'news'}.org" for i, w in enumerate(names)]
    df = spark.createDataFrame([(i, f"http://{h}/{p}") for i, (h, p) in enumerate(itertools.product(hosts, ("en", "slots")))], "page_id long, url string")
    _, level, wrong = url_filter.scores(df)
    rows = [(r.s, r.bad, r.even) for r in url_filter.shapes(df).selectExpr("s", "bad", "pmod(xxhash64(s), 2) = 0 as even").collect()]
    models = {e: url_filter.Ratio(*[url_filter.Markov().learn([s for s, b, f in rows if b == bad and f == e]) for bad in (False, True)]) for e in (False, True)}
    held = [(models[not e].score(s), b, e) for s, b, e in rows]
    good, bad = [x for x, b, _ in held if not b], [x for x, b, _ in held if b]
    error = lambda t: sum(url_filter.errors(good, bad, t))
    assert abs(error(level) - error(url_filter.calibrate(good, bad))) < 1e-9
    assert abs(level - url_filter.calibrate(good, bad)) < 1e-6
    half = {e: url_filter.calibrate(*[[x for x, b, f in held if b == bad and f == e] for bad in (False, True)]) for e in (False, True)}
    assert abs(wrong[0] - sum(x < half[not e] for x, b, e in held if not b) / len(good)) < 1e-9
    assert abs(wrong[1] - sum(x >= half[not e] for x, b, e in held if b) / len(bad)) < 1e-9


def test_levels_count_all_rows_below(spark):
    rows = [(float(i * 7 % 23), int(i % 3 == 0)) for i in range(400)]
    cuts, good, bad = common.levels(spark.createDataFrame(rows, "x double, good int"), "x", "good")
    every = sorted({x for x, _ in rows})
    assert (good, bad) == (sum(g for _, g in rows), sum(1 - g for _, g in rows))
    got = {r.value: (r.last, r.lost, r.caught) for r in cuts.collect()}
    assert got == {x: (every[i - 1] if i else None, sum(g for y, g in rows if y < x), sum(1 - g for y, g in rows if y < x)) for i, x in enumerate(every)}


def test_quality_counts_take_in_every_label(spark):
    """More trusted documents, and more held out, than any fixed number that was once taken."""
    n = 16_000
    text = "concat('w', id % 7, ' v', id % 5)"
    docs = spark.range(n).selectExpr("id as doc_id", f"{text} as text").unionByName(spark.sql("select cast(null as long) as doc_id, 'w1 v1' as text from range(50)"))
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    held = {r.doc_id for r in labels.where(quality._held()).collect()}
    ids = quality.trusted(labels)
    assert {r.id for r in ids.collect()} == set(range(n)) - held and n - len(held) > 10_000
    total = quality.ngram_counts(docs, ids, "doc_id", "text", 64).groupBy().sum("n_all", "n_trusted").first()
    assert tuple(total) == (3 * (n + 50), 3 * (n - len(held)))


def test_quality_level_takes_in_every_label(spark):
    n = 9_000  # of each class, one good one in five held out
    labels = spark.range(6 * n).selectExpr("id as doc_id", "cast(id < 5 * %d as int) as quality" % n, "0 as toxic")
    # scores as score() gives them: errors are least between 0.3 and 0.31, whatever the hashes of ids
    llr = "CASE WHEN id < 5 * {n} THEN 0.31 + (id % 977) / 1000 - if(id % 50 = 0, 1, 0) ELSE 0.3 - (id % 991) / 1000 + if(id % 50 = 0, 1, 0) END".format(n=n)
    scored = spark.range(6 * n).selectExpr("id as doc_id", "20L as n_words", "0L as n_repeat_words", f"cast({llr} as double) as llr")
    level = quality.calibrated(scored, labels, None, "doc_id", "text", scored=scored)
    held = {r.doc_id for r in labels.where(quality._held()).collect()}
    rows = [(r.doc_id, r.llr) for r in scored.collect()]
    good, bad = sorted(x for i, x in rows if i < 5 * n and i in held), sorted(x for i, x in rows if i >= 5 * n)
    want = url_filter.calibrate(good, bad)
    assert len(good) > 2_000 < len(bad) and sum(url_filter.errors(good, bad, level)) <= sum(url_filter.errors(good, bad, want)) + 1e-9


def test_quality_carries_the_id_alone(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{'g' if i % 2 else 'b'}{(i + k) % 9}" for k in range(30)), "x") for i in range(60)], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    whole, ids = quality.judge(docs, labels, buckets=64), quality.judge(docs, labels, buckets=64, carry=False)
    assert whole.columns == ["doc_id", "text", *quality.MADE, "base_failed", "kept"] and ids.columns == [c for c in whole.columns if c != "text"]
    assert sorted(map(tuple, whole.drop("text").collect())) == sorted(map(tuple, ids.collect()))
