"""Source divergence audit: how far each source's words are from the other sources' of its language, by sorting.

Tasks count the terms of their documents by language and source and hand out sorted partial runs, so
that Spark's sort merges as many pieces as were handed out instead of ordering rows one by one. These
are dealt out by ranges of (term, lang, source, document) and sorted in them, so that a term of any
frequency spreads over as many ranges as it fills. The term leads, as Spark's sort tells most rows
apart by the first bytes of the first column. One scan over a range closes the run of a term
when the next one begins: its documents and its occurrences by source. Only the first and the last
term of a range may go on in another; their partial runs meet in a small second step.

Sums over all kept terms of a pair of sources are put together without making pairs of terms that
one of them lacks: such a term has one and the same probability z in all sources of equal totals.
With f as below and z the probability of a term that a source lacks, the sum is that over common
terms of f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq), plus that over the terms of the one of
f(p, zq) - f(zp, zq), that over the terms of the other of f(zp, q) - f(zp, zq), and V f(zp, zq). The
second and third need only how often a source has each probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Written, text_of, written

#: A term is kept in a language from so many documents on; so many terms are told of each group; probabilities are by so many.
LEAST_DOCUMENTS, TOP, PARTS = 3, 200, 1_000_000_000
#: Words, and different terms by their bytes, that a task holds before it hands out partial runs; parts that a hot key is split into where groups are too many to be sent.
HELD, SALTS = 6_000_000, 32
#: Rows handed out at once, bytes of text taken at once.
OUT_ROWS, PIECE = 20_000, 1 << 20
#: Whether a byte of UTF-8 is of a term, as ASCII letters and all of other code points are; the byte with A-Z lower-cased.
LETTER, LOWER = np.zeros(256, dtype=bool), np.arange(256, dtype=np.uint8)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER[65:91] += 32
PARTIAL = "lang string, term string, source string, document string, docs long, n long"
RUNS = "lang string, term string, whole boolean, docs long, runs array<struct<source:string,docs:long,n:long>>"


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def terms_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts (UTF-8, none null), one after another, and how many each text has."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    if ends[0] == ends[-1]:
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(texts), np.int64)
    chars = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    letter = LETTER[chars]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]  # a text begins anew, even if the one before ends in a letter
    begins[first] = letter[first]
    letters = LOWER[chars[letter]]
    at = np.append(np.flatnonzero(begins[letter]), len(letters)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(letters)])
    return found.dictionary_encode(), np.diff(np.searchsorted(np.flatnonzero(begins), ends))


def partial_runs(docs: DataFrame, most: int = HELD) -> DataFrame:
    """(lang, term, source, document, docs, n) of tasks' documents: docs of them, the first one `document`, have the term, n times in all.

    docs: lang, source, document, text, none but document null. A document's terms are in one partial run each, and a task
    hands out its runs, sorted by term, language and source, when it holds over `most` words; 4 bytes of different
    terms count as one more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # documents held: lang, source, document
        chunks: list[pa.DictionaryArray] = []  # their terms
        owners: list[np.ndarray] = []  # the places in rows of the terms' documents
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            held = pa.chunked_array(chunks).unify_dictionaries().chunks
            chunks.clear()
            order = pc.array_sort_indices(held[0].dictionary)
            terms = held[0].dictionary.take(order).view(pa.string())
            rank = np.empty(len(terms), np.int64)
            rank[order.to_numpy()] = np.arange(len(terms))
            words = rank[np.concatenate([c.indices.to_numpy() for c in held])]
            del held, order, rank
            # documents are numbered by language and source
            by_group = sorted(range(len(rows)), key=lambda i: rows[i][:2])
            number = np.empty(len(rows), np.int32)
            number[by_group] = np.arange(len(rows))
            heads = [k for k, i in enumerate(by_group) if not k or rows[i][:2] != rows[by_group[k - 1]][:2]]
            group_of = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(heads, append=len(rows)))
            langs, sources = (_strings([rows[by_group[k]][c] for k in heads]) for c in (0, 1))
            documents = pa.array([rows[by_group[k]][2] for k in heads], pa.string())

            words *= len(rows)
            words += number[np.concatenate(owners)]
            owners.clear()
            words.sort()
            pairs = np.flatnonzero(np.append(True, words[1:] != words[:-1]))  # of a term and a document
            n, words = len(words), words[pairs]
            term = words // len(rows)
            words -= term * len(rows)
            group = group_of[words]
            at = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (group[1:] != group[:-1])))
            in_docs, times = np.diff(at, append=len(pairs)), np.diff(pairs[at], append=n)
            term, group = term[at], group[at]
            del words, pairs, at
            for i in range(0, len(term), OUT_ROWS):
                some = slice(i, i + OUT_ROWS)
                mine = pa.array(group[some])
                yield pa.RecordBatch.from_arrays(
                    [langs.take(mine), terms.take(pa.array(term[some])), sources.take(mine), documents.take(mine), pa.array(in_docs[some], pa.int64()), pa.array(times[some], pa.int64())],
                    ["lang", "term", "source", "document", "docs", "n"],
                )

        for b in batches:
            lang, source = (b.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "source"))
            batch, text = list(zip(lang, source, b.column("document").to_pylist())), b.column("text").cast(pa.binary())
            # whole documents, a piece at a time; a word has a byte at least
            piece = np.append(0, np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)) // min(most, PIECE)
            cuts = sorted({0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(batch)})
            for low, high in pairwise(cuts):
                found, counts = terms_of(text.slice(low, high - low))
                if not len(found):
                    continue
                chunks.append(found)
                owners.append(np.repeat(np.arange(len(rows), len(rows) + high - low, dtype=np.int32), counts))
                rows += batch[low:high]
                size += len(found) + found.dictionary.nbytes // 4
                if size > most:
                    yield from out()
                    rows, size = [], 0
        if rows:
            yield from out()

    return docs.select("lang", "source", "document", "text").mapInArrow(run, PARTIAL)


def scanned(partial: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, whole, docs, runs) by one scan over sorted ranges of partial runs.

    A whole term has all its runs in the row and at least `least` documents; other rows are of terms
    that may go on in another range.
    """
    key = ["term", "lang", "source"]
    parts = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the document only parts rows of one term and group, so it is not sorted by within a range
    dealt = partial.repartitionByRange(parts, *key, "document").drop("document").sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        term, runs, border = None, [], True

        def close(whole: bool) -> None:
            docs = sum(r[1] for r in runs)
            if not whole or docs >= least:
                rows.append((*term, whole, docs, runs))

        def out() -> pa.RecordBatch:
            flat = [r for row in rows for r in row[4]]
            ends = [0]
            for row in rows:
                ends.append(ends[-1] + len(row[4]))
            items = pa.StructArray.from_arrays([_strings([r[0] for r in flat]), *[pa.array([r[i] for r in flat], pa.int64()) for i in (1, 2)]], ["source", "docs", "n"])
            columns = [_strings([r[0] for r in rows]), _strings([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.bool_()), pa.array([r[3] for r in rows], pa.int64())]
            batch = pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["lang", "term", "whole", "docs", "runs"])
            rows.clear()
            return batch

        for b in batches:
            if not b.num_rows:
                continue
            # rows at which a run begins: one of the three differs from the row before
            begins = np.zeros(b.num_rows, dtype=bool)
            begins[0] = True
            for c in ("lang", "term", "source"):
                begins[1:] |= pc.not_equal(b.column(c).slice(1), b.column(c).slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(begins)
            names = [b.column(c).take(pa.array(at)).cast(pa.binary()).to_pylist() for c in ("lang", "term", "source")]
            sums = [np.add.reduceat(b.column(c).to_numpy(), at).tolist() for c in ("docs", "n")]
            for lang, t, source, docs, n in zip(*names, *sums):
                if (lang, t) != term:
                    if term is not None:
                        close(not border)
                        border = False
                    term, runs = (lang, t), []
                if runs and runs[-1][0] == source:
                    runs[-1][1] += docs
                    runs[-1][2] += n
                else:
                    runs.append([source, docs, n])
            if len(rows) >= OUT_ROWS:
                yield out()
        if term is not None:
            close(False)
        if rows:
            yield out()

    return dealt.select("lang", "term", "source", "docs", "n").mapInArrow(run, RUNS)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, runs array<struct<source, n>>) of the terms in at least `least` documents of the language, one row a term."""
    partial = Written(partial_runs(docs), "partial")
    runs = written(scanned(partial.df, least), "runs")
    partial.drop()
    inner = runs.where("whole").select("lang", "term", F.transform("runs", lambda r: F.struct(r["source"].alias("source"), r["n"].alias("n"))).alias("runs"))
    # the first and the last term of each range
    edge = runs.where(~F.col("whole")).select("lang", "term", F.inline("runs")).groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    edge = edge.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("runs")).where(F.col("docs") >= least)
    return inner.unionByName(edge.select("lang", "term", "runs"))


def probability(n: Column, total: Column) -> Column:
    """1 + floor(PARTS * (n + 1) / total), exact for any counts."""
    large = F.call_function("div", F.lit(PARTS).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)"), total.cast("decimal(19,0)"))
    return F.when(n < PARTS, F.call_function("div", F.lit(PARTS).cast("long") * (n + 1), total)).otherwise(large) + 1  # below, the product fits a long


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q), exact."""
    return F.call_function("div", (p - q) * (p - q), q)


def _with(df: DataFrame, groups: DataFrame, on: list[str], few: bool) -> DataFrame:
    """df with the columns of its group; where there are too many groups to send, hot keys of df are split in SALTS parts."""
    if few:
        return df.join(F.broadcast(groups), on)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    return salted.join(groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")), [*on, "__salt"]).drop("__salt")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", id_col: str = "doc_id", least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group of a language and a source, ranked from 1 by value, then item.

    Part `pair`: each other source of the language, with the sum of distance() over its kept terms,
    p the group's probability of a term and q the other's. Part `term`: the group's own terms that it
    has more often than its language, by distance(), the first `top`. A term is a run of letters of
    ASCII or of any other code points, with A-Z lower-cased. Every row is a document, repeated rows
    and those of null ids too; null texts, languages and sources are empty ones. Groups without terms
    take part in pairs; a language without kept terms has value 0 there. An empty table gives no rows.
    Other columns are not read.
    """
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), F.col(id_col).cast("string").alias("document"), text_of(text_col).alias("text"))
    terms = kept_terms(rows, least)
    flat = terms.select("lang", "term", F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["n"]).alias("in_lang"), F.inline("runs"))
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = terms.groupBy("lang").agg(F.count("*").alias("v"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "v"])
    groups = written(groups.withColumn("z", F.when(F.col("v") > 0, probability(F.lit(0), F.col("total") + F.col("v")))), "groups")
    few = groups.count() <= BROADCAST_ROWS
    by_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    known = groups.join(by_lang, "lang")
    p, q = probability(F.col("n"), F.col("total") + F.col("v")), probability(F.col("in_lang"), F.col("lang_total") + F.col("v"))
    shares = written(_with(flat, known, ["lang", "source"], few).select("lang", "term", "source", "z", p.alias("p"), q.alias("q")), "shares")

    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"), "v")
    p, z, oz = F.col("p"), F.col("z"), F.col("other_z")
    either = groups.select("lang", "source", "z").join(other, "lang").where(F.col("source") != F.col("item"))
    none = either.select("lang", "source", "item", F.coalesce(F.col("v") * distance(z, oz), F.lit(0)).alias("value"))
    often = shares.groupBy("lang", "source", "z", "p").agg(F.count("*").alias("m"))
    met = _with(often, other.drop("v"), ["lang"], few).where(F.col("source") != F.col("item"))
    here = F.struct(F.col("source").alias("source"), F.col("item").alias("item"), (F.col("m") * (distance(p, oz) - distance(z, oz))).alias("value"))
    there = F.struct(F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (distance(oz, p) - distance(oz, z))).alias("value"))
    single = met.select("lang", F.inline(F.array(here, there)))
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("op"), F.col("z").alias("other_z"))
    op = F.col("op")
    common = shares.join(right, ["term", "lang"]).where(F.col("source") != F.col("item"))  # as many rows as pairs of sources that have the term
    common = common.select("lang", "source", "item", (distance(p, op) - distance(p, oz) - distance(z, op) + distance(z, oz)).alias("value"))
    pairs = none.unionByName(single).unionByName(common).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(own)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + v.v) AS p
      FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term),
q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n + 1)) // (t.total + v.v) AS q
      FROM l JOIN (SELECT lang, sum(n)::HUGEINT AS total FROM l GROUP BY lang) t ON t.lang = l.lang JOIN v ON v.lang = l.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value
      FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM o UNION ALL SELECT * FROM t))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
