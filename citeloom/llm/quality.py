"""Quality rules: a hashed n-gram log-likelihood ratio, and plain counts, over whole texts, in SQL functions only.

Word unigrams and bigrams fall into BUCKETS hash buckets. Two multinomials are counted over the
buckets, one on trusted documents and one on all; a text's score is the mean over its n-grams of
log p_trusted - log p_all, and a text is kept if the score reaches a threshold, calibrated on
labelled documents that the counts of trusted ones leave out. The counts of the corpus take in
every document, the trusted ones and the threshold every labelled one. The table of ratios has
BUCKETS entries whatever the input, so it travels to the executors as one scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, columns, fresh, levels, text_of, written

#: Of the trusted rows one in HELD_SHARE, by hash of the id, is kept for the threshold, the others are counted. THRESHOLD holds where a class has none.
BUCKETS, HELD_SHARE, SMOOTHING, THRESHOLD = 1 << 18, 5, 3.0, -0.24
MIN_WORDS, REPEAT_SHARE, WINDOW = 10, 20, 5
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")
SPACE = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _bucket(h: Column, buckets: int) -> Column:
    if buckets & (buckets - 1) == 0:  # the same, and cheaper
        return h.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")
    return F.pmod(h, F.lit(buckets)).cast("int")


def _grams(h: Column, buckets: int) -> Column:
    """Buckets of the words and of the pairs of neighbouring words; null after the last word."""
    return F.concat(F.transform(h, lambda x: _bucket(x, buckets)), F.transform(h, lambda x, i: F.when(i + 1 < F.size(h), _bucket(F.xxhash64(x, F.get(h, i + 1)), buckets))))


def ngram_counts(docs: DataFrame, trusted_ids: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n_all, n_trusted) over all texts; trusted_ids are distinct ids, as many as there are, in the column `id`."""
    # texts are shuffled to their labels, those without an id by their hashes, as null ids would meet in one task
    apart = F.when(F.col(id_col).isNull(), F.xxhash64(text_of(text_col))).otherwise(F.lit(0).cast("long"))
    flagged = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), apart.alias("apart"))
    flagged = flagged.join(trusted_ids.select("id", F.lit(0).cast("long").alias("apart"), F.lit(1).alias("good")).hint("shuffle_hash"), ["id", "apart"], "left")
    h = flagged.select("good", words_of(F.col("text")).alias("w")).select("good", _hashes(F.col("w")).alias("h"))
    return h.select("good", F.explode(_grams(F.col("h"), buckets)).alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n_all"), F.count("good").alias("n_trusted"))


def ratios(counts: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> DataFrame:
    """One row: the log ratio of each bucket, as an array. Without trusted n-grams all ratios are 0.

    Both multinomials get pseudo-counts in proportion to their totals, so that a bucket that is
    rare in the whole corpus says little and the threshold holds for small and large corpora.
    """
    spark = counts.sparkSession
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    total = counts.agg(F.coalesce(F.sum("n_all"), F.lit(0)).alias("a"), F.coalesce(F.sum("n_trusted"), F.lit(0)).alias("t")).first()
    share = total["t"] / total["a"] if total["a"] else 0.0
    value = F.log(F.col("n_trusted") + smoothing) - F.log(F.col("n_all") * share + smoothing) if total["t"] else F.lit(0.0)
    pairs = every.agg(F.array_sort(F.collect_list(F.struct("bucket", value.cast("float").alias("r")))).alias("p"))
    return pairs.select(F.col("p.r").alias("ratios"))


def _labelled(labels: DataFrame, which: Column) -> DataFrame:
    """Ids of labelled documents, all of them."""
    return labels.where(which & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct()


def _good() -> Column:
    return (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)


def _held() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD_SHARE)) == 0


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of trusted labelled documents: quality 1 and not toxic, without those kept for the threshold."""
    return written(_labelled(labels, _good() & ~_held()), "trusted")


def calibrated(docs: DataFrame, labels: DataFrame, model: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, scored: DataFrame | None = None) -> float:
    """The level of llr that parts held-out trusted documents from those of quality 0 with the least sum of error rates, in the middle of its gap.

    All such documents take part, but for those that fail the base rules; of equally good levels the lowest is taken. scored is
    what score() gave for docs, where it is at hand.
    """
    if scored is None:
        scored = written(score(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), model, "text", buckets).drop("text"), "scored")
        id_col = "id"
    good, bad = _labelled(labels, _good() & _held()), _labelled(labels, F.col("quality") == 0)
    ids = good.select("id", F.lit(1).alias("good")).unionByName(bad.select("id", F.lit(0).alias("good"))).groupBy("id").agg(F.max("good").alias("good"))
    held = scored.where(~failed()).select(F.col(id_col).alias("id"), "llr").join(ids, "id").select("good", "llr")
    cuts, good_rows, bad_rows = levels(written(held, "held"), "llr", "good")
    if not good_rows or not bad_rows:
        return THRESHOLD
    best = cuts.orderBy(F.col("lost") / good_rows - F.col("caught") / bad_rows, "value").first()
    return (best["value"] + best["last"]) / 2 if best["last"] is not None else best["value"]


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words"))


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and llr added.

    llr is 0 for a text without words. Input columns of these names are replaced.
    """
    keep = columns(docs, *MADE)
    w, h, win, lines, spots, ratio = (fresh(docs, s) for s in ("w", "h", "win", "lines", "spots", "ratio"))
    text = text_of(text_col)
    df = docs.select(*keep, text.alias(lines + "t"), words_of(text).alias(w))
    df = df.select(
        *keep,
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(lines + "t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(lines + "t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0).alias(lines),
        w,
    )
    # one row each: the generator computes the hashes once for all that uses them
    df = df.select("*", F.explode(F.array(_hashes(F.col(w)))).alias(h)).drop(w)
    n = F.size(h)
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(h), i + k) for k in range(WINDOW)])))
    # the optimizer puts a subquery that is used once into the expression, so no row carries its result
    df = df.select("*", model.scalar().alias(ratio))
    mean = F.aggregate(_grams(F.col(h), buckets), F.lit(0.0), lambda s, g: s + F.coalesce(F.get(F.col(ratio), g).cast("double"), F.lit(0.0)))
    df = df.select(*keep, n.cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), windows.alias(win), F.when(n > 0, mean / (2 * n - 1)).otherwise(0.0).alias("llr"))
    # positions of windows that occur again: sorted by hash, equal ones are neighbours
    placed = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.select("*", F.when(F.size(F.array_distinct(win)) < F.size(win), placed).alias(spots))
    same = lambda j: F.get(F.col(spots), j)["x"]
    again = F.array_sort(F.transform(F.filter(spots, lambda s, j: F.coalesce(s["x"] == same(j + 1), F.lit(False)) | F.coalesce((j > 0) & (s["x"] == same(F.greatest(j - 1, F.lit(0)))), F.lit(False))), lambda s: s["i"]))
    df = df.select("*", again.alias(lines))
    covered = F.aggregate(F.transform(lines, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(lines), j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "llr")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None, buckets: int = BUCKETS, carry: bool = True) -> DataFrame:
    """score() with base_failed and kept added: every document is judged, in one further reading of the texts.

    Scores are written before the threshold is calibrated on those of labelled documents, with all columns or, without `carry`,
    with the id alone, which are then all that the result has.

    base_failed: under MIN_WORDS words, or over REPEAT_SHARE percent of the words in repeated
    windows. kept: not base_failed and llr >= threshold, the calibrated one unless given. A null text
    is empty and fails; rows repeated or with null ids are judged like others; with no trusted
    label all llr are 0 and only the base rules act. An empty table gives no rows.
    """
    counts = Written(ngram_counts(docs, trusted(labels), id_col, text_col, buckets), "ngrams")
    model = written(ratios(counts.df, buckets), "ratios")
    counts.drop()
    scored = score(docs, model, text_col, buckets)
    if not carry:
        scored = scored.select(id_col, *MADE)
    keep = columns(scored, *MADE, "base_failed", "kept")
    level = THRESHOLD if threshold is None else threshold
    if threshold is None:
        n = labels.where("doc_id IS NOT NULL").agg(F.count_if(_good() & _held()).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).first()
        if n["good"] and n["bad"]:
            scored = written(scored, "scored")
            level = calibrated(docs, labels, model, id_col, text_col, buckets, scored)
    verdict = F.struct(*MADE, failed().alias("base_failed"), (~failed() & (F.col("llr") >= level)).alias("kept"))
    # a generator again: filters on what it gives stay above it, else they would be computed anew within each other
    return scored.select(*keep, F.inline(F.array(verdict)))
