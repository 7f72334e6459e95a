"""The near-duplicates of simhash_dedup at another likeness: a Jaccard similarity of word shingles, decided on whole shingle sets.

SimHash comes first: sets whose fingerprints differ in at most BITS bits meet in pigeonhole blocks,
are compared whole, and those similar are joined. Blocks of bits can not propose all pairs: at a
similarity of 0.8 some 10 of 64 bits differ. The rest is found by op5's fingerprint, the
one-permutation MinHash: its BINS least hashes are cut into BANDS blocks of ROWS. Two sets of
similarity s share a block with probability 1 - (1 - s^ROWS)^BANDS, over 0.9999 at LEAST = 0.8.
Texts of equal sets are one. Sets that share a key and are not yet joined are compared whole. In a block of over HOT_BLOCK sets all are compared with
PIVOTS of it first, and then those outside the block's largest component with all not yet joined to them,
cell by cell and without a row for each pair.
Of a set's shingles only those that another set of a block has too can be shared: this bounds the
similarity of two sets from above by their sizes and these counts, before any whole sets are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_dedup
from .common import connected_components, small_batches, text_of, written
from .fingerprint import minima

SHINGLE, LEAST, BINS, ROWS, HOT_BLOCK, PIVOTS = 5, 0.8, 128, 5, 64, 4
#: Sets, and shingles of all its sets, of a chunk of a hot block on average at most; a cell holds two chunks.
CHUNK_SETS, CHUNK_SHINGLES = 1_024, 250_000
BANDS = BINS // ROWS
#: Differing bits of SimHashes that meet, pieces that a SimHash is cut into, and fingerprints of a block up to which all its pairs are taken.
BITS, PIECES, HOT_BITS = 4, 6, 16


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted."""
    return np.unique(simhash_dedup.shingle_hashes(text, size)).astype("<u8")


def _key(of: np.ndarray) -> int:
    return simhash_dedup._signed(xxhash.xxh64_intdigest(of.tobytes()))


def key(text: str | None) -> int:
    """A hash of the shingle set as a signed long."""
    return _key(shingle_set(text))


def bands_of(of: np.ndarray) -> list[int]:
    """A key for each band, a hash of its least hashes; none for a text without words."""
    if not len(of):
        return []
    return [simhash_dedup._signed(xxhash.xxh64_intdigest(band.tobytes())) for band in minima(of, BINS)[: BANDS * ROWS].reshape(BANDS, ROWS)]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp, sim, bands): one row for each input row; fp is the hash of the shingle set, sim its SimHash as a signed long."""
    small_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint, sim bigint, bands array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in b.column(1).to_pylist()]
            sims = [simhash_dedup._signed(simhash_dedup.simhash_of(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_key, sets), pa.int64()), pa.array(sims, pa.int64()), pa.array(map(bands_of, sets), pa.list_(pa.int64()))], ["doc_id", "fp", "sim", "bands"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(fp, of): the shingle sets of the texts with the column fp of wanted, found by its column first_id."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(_key, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "of"])

    ids = wanted.select("first_id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(ids, F.col("id").eqNullSafe(F.col("first_id")), "left_semi")
    found = texts.select("text").mapInArrow(run, "fp bigint, of binary")
    return written(found.join(wanted.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.min("of").alias("of")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of at least `least`."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= least for x, y in zip(a, b)], dtype=bool)

    small_batches(pairs.sparkSession)
    first, second = sets.select(F.col("fp").alias("u"), F.col("of").alias("a")), sets.select(F.col("fp").alias("v"), F.col("of").alias("b"))
    return written(pairs.join(second, "v").join(first, "u").where(near("a", "b")).select("u", "v"), "near")


def _common(sets: DataFrame) -> DataFrame:
    """(fp, size, common): the shingles of each set, and how many of them another of the sets has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp, of in zip(b.column("fp"), b.column("of")):  # a batch a set, so that no more than one is held
                own = np.frombuffer(of.as_buffer(), "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), fp.as_py())), pa.array(own)], ["fp", "t"])

    small_batches(sets.sparkSession)
    alone = sets.select("fp", "of").mapInArrow(run, "fp bigint, t bigint").groupBy("t").agg(F.count("*").alias("n"), F.min("fp").alias("fp")).where("n = 1")
    sizes = sets.select("fp", (F.octet_length("of") / 8).cast("long").alias("size"))
    return sizes.join(alone.groupBy("fp").agg(F.count("*").alias("alone")), "fp", "left").select("fp", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def within_bits(distinct: DataFrame, bits: int = BITS, pieces: int = PIECES, hot: int = HOT_BITS) -> DataFrame:
    """Pairs (u, v) of sets of distinct (fp, sim) whose SimHashes differ in at most `bits` bits.

    The least set of each SimHash stands for it, and pairs with the others of that SimHash. Of two
    SimHashes `bits` apart some pieces - bits of the pieces agree, and these key a block. A pair is
    taken in the first such block, from blocks of over `hot` SimHashes only pairs with PIVOTS of it.
    """
    one = written(distinct.groupBy("sim").agg(F.min("fp").alias("fp")), "sims")
    same = distinct.join(one.select("sim", F.col("fp").alias("u")), "sim").select("u", F.col("fp").alias("v"))
    masks = F.array(*[F.lit(simhash_dedup._signed(m)).cast("long") for m in simhash_dedup._masks(pieces, bits)])
    block = ["table", "key"]
    rows = one.select(F.struct("sim", "fp").alias("a"), F.posexplode(F.transform(masks, lambda m: F.col("sim").bitwiseAND(m))).alias(*block))
    held = rows.groupBy(*block).agg(F.count("*").alias("n"), *[F.min_by("a", F.xxhash64("a", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]).where("n > 1")
    met = written(rows.join(held, block), "bits")
    differ = F.col("a.sim").bitwiseXOR(F.col("b.sim"))
    near = (F.bit_count(differ) <= bits) & (F.col("a.sim") != F.col("b.sim"))
    first = ~F.exists(F.slice(masks, F.lit(1), F.col("table")), lambda m: differ.bitwiseAND(m) == 0)  # no table before has both in one block
    cold = met.where(F.col("n") <= hot)
    pairs = cold.select(*block, "a").join(cold.select(*block, F.col("a").alias("b")), block).where((F.col("a.fp") < F.col("b.fp")) & near & first)
    stars = met.where(F.col("n") > hot).select("a", F.explode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("b")).where(near)
    return written(_ordered(reduce(DataFrame.unionByName, [df.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")) for df in (pairs, stars)], same)), "close")


def links(docs: DataFrame, distinct: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, hot_block: int = HOT_BLOCK) -> DataFrame:
    """Edges (u, v) between the sets of distinct (fp, first_id, sim, bands) that join all those found similar.

    Pairs of near SimHashes are compared first; those that share a key of MinHash follow, unless they are joined by then.
    """
    block = ["band", "key"]
    rows = distinct.select("fp", "first_id", F.posexplode("bands").alias("band", "key"))
    met = written(rows.join(rows.groupBy(*block).agg(F.count("*").alias("n")).where("n > 1"), block).drop("n"), "blocks")
    close = within_bits(distinct)
    ends = close.select(F.explode(F.array("u", "v")).alias("fp"))
    sets = _sets(docs, distinct.join(met.select("fp").unionByName(ends), "fp", "left_semi").select("fp", "first_id"), id_col, text_col)
    joined = _verified(close, sets, least)
    label = connected_components(joined).select(F.col("node").alias("fp"), "label")
    able = _common(sets).where(F.col("common") >= least * F.col("size") - 1e-9)  # else similar to none
    met = written(met.drop("first_id").join(able, "fp").join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "blocks")
    one = F.struct("fp", "size", "common", "label")
    held = met.groupBy(*block).agg(F.count("*").alias("n"), *[F.min_by(one, F.xxhash64("fp", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]).where("n > 1")
    met = written(met.join(held, block), "blocks")

    def can(a: str, b: str) -> Column:
        """Whether two sets are not joined yet and can be similar: they share at most what the poorer one shares with any."""
        most = F.least(f"{a}.common", f"{b}.common")
        return (F.col(f"{a}.label") != F.col(f"{b}.label")) & (most >= least * (F.col(f"{a}.size") + F.col(f"{b}.size") - most) - 1e-9)

    cold, hot = met.where(F.col("n") <= hot_block), met.where(F.col("n") > hot_block)
    mates = cold.select(*block, one.alias("a")).join(cold.select(*block, one.alias("b")), block).where((F.col("a.fp") < F.col("b.fp")) & can("a", "b"))
    stars = hot.select(one.alias("b"), F.explode(F.array(*[f"p{i}" for i in range(PIVOTS)])).alias("a")).where(can("a", "b"))
    named = [df.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")) for df in (mates, stars)]
    pairs = written(_ordered(named[0].unionByName(named[1])), "pairs")
    edges = joined.unionByName(_verified(pairs, sets, least))
    if hot.isEmpty():
        return edges
    # whole for hot blocks too: sets of different components are compared in cells of the block
    label = connected_components(edges).select(F.col("node").alias("fp"), "label")
    hot = hot.select(*block, "fp", "size", "common").join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    return edges.unionByName(written(_across(written(hot, "hot"), sets, least), "across"))


def _across(hot: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (u, v) that join all similar sets of different components in each block; hot: band, key, fp, size, common, label.

    A block's sets are dealt into chunks of at most about CHUNK_SETS sets and CHUNK_SHINGLES
    shingles, and each pair of chunks is a cell: a cell counts what each of its sets outside the
    block's largest component shares with all others at once, and gives a link for each two
    components that meet. No pair is a row, and a set is sent once to a cell, not once a pair.
    """
    block = ["band", "key"]
    crowd = hot.groupBy(*block, "label").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    crowd = crowd.groupBy(*block).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("labels")).where("labels > 1")
    k = F.greatest(F.ceil(F.col("n") / CHUNK_SETS), F.ceil(F.col("s") / CHUNK_SHINGLES)).cast("int")
    dealt = hot.join(crowd.select(*block, "main", k.alias("k")), block).withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("k")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select(*block, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "fp", "size", "common", "label", "main").join(sets, "fp")

    def cell(t: pa.Table) -> pa.Table:
        fp, size, common, label, chunk = (t.column(c).to_numpy() for c in ("fp", "size", "common", "label", "chunk"))
        main, low, high = t.column("main")[0].as_py(), t.column("low")[0].as_py(), t.column("high")[0].as_py()
        own = [np.frombuffer(x, "<u8") for x in t.column("of").to_pylist()]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        names, ids = np.unique(np.concatenate(own), return_inverse=True)
        mark, group, found = np.zeros(len(names), dtype=bool), label.copy(), []
        for i in np.flatnonzero(label != main):
            most = np.minimum(common, common[i])
            can = (group != group[i]) & (most >= least * (size + size[i] - most) - 1e-9)
            if low != high:  # within a chunk another cell compares
                can &= chunk != chunk[i]
            if not can.any():
                continue
            mine = ids[starts[i] : starts[i + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[ids], starts[:-1])
            mark[mine] = False
            for j in np.flatnonzero(can & (both >= least * (size + size[i] - both))):
                if group[j] != group[i]:
                    found.append((min(fp[i], fp[j]), max(fp[i], fp[j])))
                    group[group == group[j]] = group[i]
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return dealt.groupBy(*block, "low", "high").applyInArrow(cell, "u bigint, v bigint").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, hot_block: int = HOT_BLOCK) -> DataFrame:
    """One row for each input row: doc_id, fp (a hash of the shingle set), component_id, root.

    component_id is the smallest id among all rows reachable over pairs of a similarity of at
    least `least`, root the component's smallest fp. Null texts count as empty; texts without
    words are copies of one another. Null ids are ignored as component_id unless a component has
    no other. Repeated rows stay. An empty table gives no rows.
    """
    keyed = written(_keys(docs, id_col, text_col), "keys")
    distinct = written(keyed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.first("sim").alias("sim"), F.first("bands").alias("bands")), "distinct")
    label = connected_components(links(docs, distinct, id_col, text_col, least, hot_block))
    named = written(distinct.select("fp", "first_id").join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("root")), "labels")
    of = named.join(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id", "root")
    return keyed.select("doc_id", "fp").join(of, "fp", "left").select("doc_id", "fp", "component_id", "root")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, as simhash_dedup.deduplicate picks it."""
    return simhash_dedup.keep_one(docs, classes(docs, id_col, text_col), key, id_col, text_col)
