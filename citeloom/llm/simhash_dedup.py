"""SimHash near-duplicates: fingerprints that differ in few bits share a pigeonhole block.

A 64-bit fingerprint is cut into BLOCKS pieces. Two fingerprints with at most MAX_BITS
differing bits agree in all but MAX_BITS pieces, so they meet in one of the
C(BLOCKS, MAX_BITS) tables keyed by the agreeing pieces; pairs that meet are verified.
Only distinct fingerprints take part. A key held by more than HOT_BLOCK fingerprints is not
expanded into pairs: two fingerprints differ in at most two bits exactly if some 64-bit word is
at most one bit from each, so such fingerprints meet at these words, of which each has 65 and
each word at most 65 fingerprints. That loses no link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, connected_components, fresh, small_batches, text_of, written

SHINGLE, SEED, MAX_BITS, BLOCKS, HOT_BLOCK = 3, 42, 2, 5, 64
CHUNK = 1 << 15


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each word shingle. bytes.lower() and bytes.split() know just A-Z and ASCII white space."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(joined, seed)], np.uint64)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    return np.fromiter((hashed(joined[a : b - 1], seed) for a, b in zip(starts, starts[size:])), np.uint64, len(words) - size + 1)


def simhash(text: str | None) -> int:
    """Fingerprint of a text as an unsigned 64-bit integer; 0 if it has no words."""
    return simhash_of(shingle_hashes(text))


def simhash_of(hashes: np.ndarray) -> int:
    """Fingerprint of shingle hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each input row; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(simhash(t)) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def _masks(blocks: int, differ: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    pieces = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(kept) for kept in combinations(pieces, blocks - differ)]


def links(fps: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints of column fp that link all those within MAX_BITS bits.

    From blocks of up to hot_block fingerprints come all pairs within MAX_BITS, from larger ones a
    star at each meeting word, whose edges are links too and join the same components.
    """
    masks = [_signed(m) for m in _masks(BLOCKS, MAX_BITS)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    rows = fps.select("fp", keys.alias("k")).select("fp", "k.table", "k.key")
    held = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(rows.join(held, ["table", "key"]), "blocks")
    cold, hot = met.where(F.col("n") <= hot_block), met.where(F.col("n") > hot_block).select("fp").distinct()
    pairs = (
        cold.select("table", "key", F.col("fp").alias("u"))
        .join(cold.select("table", "key", F.col("fp").alias("v")), ["table", "key"])
        .where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS))
        .select("u", "v")
    )
    near = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]))
    words = hot.select("fp", near.alias("word")).groupBy("word").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = words.select("u", F.explode("all").alias("v")).where("u <> v")
    return pairs.unionByName(stars).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_block: int = HOT_BLOCK) -> DataFrame:
    """One row for each input row: doc_id, fingerprint (16 hex digits), component_id, fp, first_id, root.

    component_id is the smallest id among all rows reachable over links, first_id the smallest
    with the same fingerprint, root the component's smallest fingerprint. Null texts count as empty; texts without words have fingerprint 0
    and link like others. Null ids are ignored as component_id unless a component has no other.
    Repeated rows stay. An empty table gives no rows.
    """
    docs_fp = written(fingerprints(docs, id_col, text_col), "simhash")
    distinct = written(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    label = connected_components(links(distinct, hot_block))
    named = written(distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label")), "labels")
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of = named.join(least, "label").select("fp", "first_id", "component_id", F.col("label").alias("root"))
    return docs_fp.join(of, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "first_id", "root")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the component's smallest (id, fingerprint); of rows equal in both, that of the least text.

    The search shuffles fingerprints only; texts are shuffled once, to pick the rows. Null ids
    come last, and a component without other ids keeps one row.
    """
    return keep_one(docs, classes(docs, id_col, text_col), lambda t: _signed(simhash(t)), id_col, text_col)


def keep_one(docs: DataFrame, found: DataFrame, key: Callable[[str | None], int], id_col: str, text_col: str) -> DataFrame:
    """The rows that deduplicate() keeps, by the components found (doc_id, fp, component_id, root); key gives a text's fp."""
    keep = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("fp"))).alias("k"))
    i, f = fresh(docs, "keep"), fresh(docs, "fp")
    keep = written(keep.select(F.col("k.id").alias(i), F.col("k.fp").alias(f + "k")), "keep")
    ids = keep.select(i).distinct()
    kept = docs.join(ids, F.col(id_col).eqNullSafe(F.col(i)), "left_semi")
    again = written(found.groupBy(F.col("doc_id").alias(i)).agg(F.count("*").alias("n")).where("n > 1").select(i), "again")
    if again.isEmpty():
        return kept

    @F.pandas_udf("bigint")
    def fp(texts):
        return texts.map(key)

    # ids on several rows: only the rows of the fingerprints that stay, once each
    single = kept.join(again, F.col(id_col).eqNullSafe(F.col(i)), "left_anti")
    several = kept.join(again, F.col(id_col).eqNullSafe(F.col(i)), "left_semi").withColumn(f, fp(text_of(text_col)))
    several = several.join(keep, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(f) == F.col(f + "k")), "left_semi")
    several = several.groupBy(id_col, f).agg(F.min_by(F.struct(*columns(docs)), text_of(text_col)).alias("row")).select("row.*")
    return single.unionByName(several)
