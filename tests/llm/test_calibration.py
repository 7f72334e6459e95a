import random

from pyspark.sql import functions as F

from citeloom.llm import quality as Q


def test_calibrated_level_has_the_least_errors(spark):
    """Against every level between the held-out scores, tried one by one."""
    draw, rows, marks = random.Random(5), [], []
    for i in range(120):
        good = i % 2
        words = [f"{'g' if draw.random() < (0.6 if good else 0.45) else 'b'}{draw.randrange(60)}" for _ in range(40)]
        rows.append((i, " ".join(words)))
        marks.append((i, good, 0))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = Q.written(Q.ratios(Q.ngram_counts(docs, Q.trusted(labels), "doc_id", "text", 256), 256), "ratios")
    level = Q.calibrated(docs, labels, model, "doc_id", "text", 256)
    held = {r.doc_id for r in labels.where(Q._good() & Q._held()).collect()}
    scored = Q.written(Q.score(docs, model, "text", 256).select("doc_id", "llr", Q.failed().alias("failed")), "scored").where(~F.col("failed")).collect()
    good, bad = [r.llr for r in scored if r.doc_id in held], [r.llr for r in scored if r.doc_id % 2 == 0]
    assert good and bad

    def errors(t):
        return sum(x < t for x in good) / len(good) + sum(x >= t for x in bad) / len(bad)

    every = sorted(good + bad)
    assert abs(errors(level) - min(map(errors, [*every, every[-1] + 1]))) < 1e-9
