"""Document fingerprints: one-permutation MinHash, optimally densified, packed to few bits a bin.

The shingles of a text are hashed once; the top bits of a hash choose its bin and each bin keeps
its least hash. An empty bin takes the value of the first filled bin in an order of its own,
drawn at random once and for all, which is optimal densification. Of each value BIN_BITS low
bits are kept, and the share of equal bins is corrected for those equal by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of, written
from .simhash_dedup import shingle_hashes

SHINGLE, SEED, BINS, BIN_BITS = 5, 7, 256, 4


@cache
def _orders(bins: int) -> np.ndarray:
    """[i, b]: place of bin b in the order in which the empty bin i looks at bins."""
    with np.errstate(over="ignore"):
        x = (np.arange(bins * bins, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x.reshape(bins, bins).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")


def minima(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Least hash of each bin, empty bins filled by densification; hashes must not be empty."""
    least = np.sort(hashes)  # by bin, then by value
    of = (least >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.r_[True, of[1:] != of[:-1]]
    values, filled = np.zeros(bins, np.uint64), of[first]
    values[filled] = least[first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        values[empty] = values[filled[_orders(bins)[np.ix_(empty, filled)].argmin(axis=1)]]
    return values


def fingerprint(text: str | None, bins: int = BINS) -> str:
    """Hex string of bins * BIN_BITS bits; empty for a text without words, which has no shingle."""
    hashes = shingle_hashes(text, SHINGLE, SEED)
    if not len(hashes):
        return ""
    low = (minima(hashes, bins) & np.uint64((1 << BIN_BITS) - 1)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of the shingles behind two fingerprints, between 0 and 1; 1 for two of no words, 0 for one."""
    if not a or not b:
        return float(a == b)
    equal = sum(x == y for x, y in zip(a, b)) / len(a)
    chance = 2.0**-BIN_BITS
    return max(0.0, (equal - chance) / (1 - chance))


def edited(text: str, other: str) -> str:
    """The last third of the code points replaced by as many first ones of another text, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def _result(key: object, text: str, mark: str, other: str, other_mark: str) -> tuple:
    new = edited(text, other)
    of_new = mark if new == text else fingerprint(new)
    return key, len(text), hashlib.sha256(new.encode()).hexdigest(), mark, of_new, likeness(mark, of_new), likeness(mark, other_mark)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _fields(docs: DataFrame, id_col: str) -> str:
    return f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) dealt out by ranges in descending order of the id, sorted within them; nulls come last, equal ids go by the hash of their texts.

    Rows that are equal in both are parted by the row's place in the input, so that no id, and no
    repeated row, needs to fit into one range. Ranges follow Spark's sample of the keys.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("__h"), F.monotonically_increasing_id().alias("__at"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("__h").desc(), F.xxhash64("__at")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edit takes the next document's text in descending order of the ids, see edited() and
    _in_ranges(); the last row's next is the first, and a single row is its own. Ids may be of any
    type that can be ordered. Null ids are last, a null text is empty, an empty table gives no rows.

    Texts are shuffled once, into ranges of the order. A range compares its rows with one another
    and hands out its first and its last text; what it finds is written, and the last row of each
    range, one a task, then meets the first of the next.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, key_type = TaskContext.get().partitionId(), None, None  # last: id, text, fingerprint of the row that waits for its next
        for b in batches:
            key_type, out = b.column(0).type, []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                mark = fingerprint(text)
                if last is None:
                    out.append((part, "first", text, key, None, None, mark, None, None, None))
                else:
                    out.append((part, None, None, *_result(*last, text, mark)))
                last = key, text, mark
            yield batch(out, key_type)
        if last is not None:
            yield batch([(part, "last", last[1], last[0], None, None, last[2], None, None, None)], key_type)

    def batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 10
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.string(), pa.string(), key_type, *TYPES])], ["part", "edge", "whole", *NAMES])

    found = written(_in_ranges(docs, id_col, text_col).mapInArrow(within, f"part int, edge string, whole string, {_fields(docs, id_col)}"), "compared", codec="zstd")
    parts = [r["part"] for r in found.where("edge = 'last'").select("part").orderBy("part").collect()]  # one row a range
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    edges = found.where("edge IS NOT NULL").select("part", "edge", "doc_id", "whole", "fingerprint")
    ends = edges.where("edge = 'last'").join(after, "part").select("next", "doc_id", "whole", "fingerprint")
    starts = edges.where("edge = 'first'").select(F.col("part").alias("next"), F.col("whole").alias("other"), F.col("fingerprint").alias("other_mark"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_result(*r) for r in zip(*(c.to_pylist() for c in b.columns))]
            columns = list(zip(*rows)) or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [b.column(0).type, *TYPES])], NAMES)

    met = ends.join(starts, "next").select("doc_id", "whole", "fingerprint", "other", "other_mark").mapInArrow(across, _fields(docs, id_col))
    return found.where("edge IS NULL").select(*NAMES).unionByName(met)
