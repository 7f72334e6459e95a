"""A full-text index: postings in blocks by term, as segments that only grow, searched without reading other terms.

A segment holds the postings of the texts that one update brought: for each term blocks of at most
BLOCK texts with the term's counts and the texts' lengths, and each block's largest count and
smallest length, from which a bound on its scores follows. Blocks are dealt into buckets by the
term's hash and sorted by term in them. Texts that go are noted by id, and leave for good when
segments are merged. A pointer file names the segments of a snapshot.

A search scores the texts of its rarest terms first. The k-th best of these scores bounds the
result from below; terms whose bounds together do not reach it cannot bring a text into the result,
so that only texts of the other terms are candidates, and of these only those in blocks that can.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pointers import Pointers
from .search import B, K1, tokens

#: Texts of a block; postings of a bucket on average; segments that are merged into one when there are more.
BLOCK, BUCKET_POSTINGS, MOST_SEGMENTS = 512, 2_000_000, 16
MOST_BUCKETS = 4_096


def _part(tf: Column, length: Column, mean: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


class TextIndex:
    """Segments under one folder; `ident` names the texts' key, of any type that Parquet holds."""

    def __init__(self, spark: SparkSession, folder: str, ident: str = "chunk_id", kind: str = "string"):
        self.spark, self.folder, self.ident, self.kind = spark, folder.rstrip("/"), ident, kind
        self.pointers = Pointers(spark, f"{self.folder}/_current")

    def segments(self) -> list[dict]:
        """name, buckets, texts, words, gone of each segment, the oldest first."""
        return (self.pointers.latest()[1] or {"segments": []})["segments"]

    # -- what a segment's folder holds

    def _schema(self) -> str:
        return f"term string, ids array<{self.kind}>, tfs array<int>, lengths array<int>, max_tf int, min_length int, bucket int"

    def _texts(self, segments: list[dict]) -> DataFrame:
        """(segment, id, length) of all texts that segments brought."""
        paths = [f"{self.folder}/{s['name']}/texts" for s in segments if s["texts"]]
        schema = f"segment int, {self.ident} {self.kind}, length int"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _gone(self, segments: list[dict]) -> DataFrame:
        """(segment, id): texts that a later update took out of a segment."""
        paths = [f"{self.folder}/{s['name']}/gone" for s in segments if s["gone"]]
        schema = f"segment int, {self.ident} {self.kind}"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def texts(self) -> DataFrame:
        """(id, length) of the texts that are indexed now."""
        now = self.segments()
        return self._texts(now).join(self._gone(now), ["segment", self.ident], "left_anti").drop("segment")

    # -- updates

    def update(self, added: DataFrame, removed: DataFrame | None = None, text: str = "text") -> None:
        """Texts that go and texts that come, as one segment; a text that comes again takes the place of what it was.

        added: the ident and the text, each id once; removed: ids. Null texts have no words. Of two
        updates at a time the second raises.
        """
        number, now = self.pointers.latest()
        segments = (now or {"segments": []})["segments"]
        name, serial = f"segment-{uuid.uuid4().hex}", max([s["serial"] for s in segments], default=0) + 1
        base = f"{self.folder}/{name}"
        split = added.select(self.ident, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
        counted = split.mapInArrow(_counts(self.ident), f"{self.ident} {self.kind}, term string, tf int, length int")
        counted.write.parquet(f"{base}/counts")
        counts = self.spark.read.schema(counted.schema).parquet(f"{base}/counts")
        known = counts.where("term = ''").select(F.lit(serial).alias("segment"), self.ident, "length")  # one row a text, see _counts()
        known.write.parquet(f"{base}/texts")
        totals = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("w")).first()
        postings = counts.where("term <> ''").count()
        buckets = min(MOST_BUCKETS, 1 << max(0, (-(-postings // BUCKET_POSTINGS) - 1).bit_length()))
        self._write_blocks(counts.where("term <> ''"), base, buckets)
        out = known.select(self.ident)
        out = out if removed is None else out.unionByName(removed.select(self.ident)).distinct()
        live = self._texts(segments).join(self._gone(segments), ["segment", self.ident], "left_anti")
        gone = live.join(out, self.ident, "left_semi").select("segment", self.ident, "length")
        gone.write.parquet(f"{base}/gone")
        lost = self.spark.read.schema(gone.schema).parquet(f"{base}/gone").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("w")).first()
        self._delete(f"{base}/counts")
        told = {"name": name, "serial": serial, "buckets": buckets, "texts": totals["n"], "words": totals["w"], "gone": lost["n"], "gone_words": lost["w"]}
        if not self.pointers.create(number + 1, {"segments": [*segments, told]}):
            self._delete(base)
            raise RuntimeError("another update of the index came first")
        if len(segments) + 1 > MOST_SEGMENTS:
            self.merge()

    def _write_blocks(self, counts: DataFrame, base: str, buckets: int) -> None:
        """counts: (id, term, tf, length), to blocks by bucket of the term, sorted by term; a frequent term goes over several ranges."""
        bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
        ranges = max(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = counts.withColumn("bucket", bucket).repartitionByRange(ranges, "bucket", "term", self.ident).sortWithinPartitions("bucket", "term", self.ident)
        dealt.select("bucket", "term", self.ident, "tf", "length").mapInArrow(_blocks(self.ident), self._schema()).write.partitionBy("bucket").parquet(f"{base}/blocks")

    def merge(self) -> None:
        """All segments as one, without the texts that went."""
        number, now = self.pointers.latest()
        segments = (now or {"segments": []})["segments"]
        if len(segments) < 2 and not any(s["gone"] for s in segments):
            return
        serial, name = max(s["serial"] for s in segments) + 1, f"segment-{uuid.uuid4().hex}"
        base = f"{self.folder}/{name}"
        known = self._texts(segments).join(self._gone(segments), ["segment", self.ident], "left_anti")
        known.select(F.lit(serial).alias("segment"), self.ident, "length").write.parquet(f"{base}/texts")
        totals = self.spark.read.schema("length int").parquet(f"{base}/texts").agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("w")).first()
        postings = self._postings(segments, None)
        n = postings.count()
        buckets = min(MOST_BUCKETS, 1 << max(0, (-(-n // BUCKET_POSTINGS) - 1).bit_length()))
        self._write_blocks(postings.select(self.ident, "term", "tf", "length"), base, buckets)
        told = {"name": name, "serial": serial, "buckets": buckets, "texts": totals["n"], "words": totals["w"], "gone": 0, "gone_words": 0}
        if not self.pointers.create(number + 1, {"segments": [told]}):
            self._delete(base)
            raise RuntimeError("another update of the index came first")
        for s in segments:
            self._delete(f"{self.folder}/{s['name']}")

    def _delete(self, path: str) -> None:
        fs, p = self.pointers.fs(path)
        fs.delete(p, True)

    # -- searches

    def _blocks(self, segments: list[dict], terms: list[str] | None) -> DataFrame:
        """Blocks with their segment's serial; of the terms' buckets only, the terms being pushed down to the files."""
        schema, out = self._schema(), None
        for s in segments:
            if not s["texts"]:
                continue
            df = self.spark.read.schema(schema).parquet(f"{self.folder}/{s['name']}/blocks")
            if terms is not None:
                of = F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(s["buckets"])).cast("int") for t in terms]))
                buckets = self.spark.range(1).select(of).first()[0]
                df = df.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
            df = df.withColumn("segment", F.lit(s["serial"]))
            out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], f"{schema}, segment int") if out is None else out

    def _postings(self, segments: list[dict], terms: list[str] | None, blocks: DataFrame | None = None) -> DataFrame:
        """(segment, term, id, tf, length) of texts that are there."""
        blocks = self._blocks(segments, terms) if blocks is None else blocks
        rows = blocks.select("segment", "term", F.inline(F.arrays_zip(F.col("ids").alias("i"), F.col("tfs").alias("f"), F.col("lengths").alias("l")))).toDF("segment", "term", self.ident, "tf", "length")
        return rows.join(self._gone(segments), ["segment", self.ident], "left_anti") if any(s["gone"] for s in segments) else rows

    def search(self, query: str, k: int) -> DataFrame:
        """(id, score) of the k texts that score best for any of the query's words, as a scan of all texts would rank them."""
        terms, segments = sorted({t for t in re.findall(r"[^\W_]+", query.lower())}), self.segments()
        n = sum(s["texts"] - s["gone"] for s in segments)
        none = self.spark.createDataFrame([], f"{self.ident} {self.kind}, score double")
        if not terms or n <= 0 or k < 1:
            return none
        mean = max(sum(s["words"] - s["gone_words"] for s in segments) / n, 1e-9)
        blocks = self._blocks(segments, terms)
        bound = _part(F.col("max_tf"), F.col("min_length"), mean)
        if any(s["gone"] for s in segments):
            often = {r["term"]: r["df"] for r in self._postings(segments, terms).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a term
        else:
            often = {r["term"]: r["df"] for r in blocks.groupBy("term").agg(F.sum(F.size("ids")).alias("df")).collect()}
        if not often:
            return none
        highest = {r["term"]: r["b"] for r in blocks.groupBy("term").agg(F.max(bound).alias("b")).collect()}
        weight = {t: float(np.log(1 + (n - d + 0.5) / (d + 0.5))) for t, d in often.items()}
        most = {t: weight[t] * highest[t] for t in often}
        by_rarity = sorted(often, key=lambda t: (often[t], t))
        first, seen = [], 0
        while len(first) < len(by_rarity) and seen < k:
            first.append(by_rarity[len(first)])
            seen += often[first[-1]]
        least = 0.0
        if len(first) < len(by_rarity):
            # partial scores of the rarest terms' texts: the k-th best is a lower bound of the k-th best score
            some = self._scored(segments, first, weight, mean).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
            least = some["s"] if some["n"] == k else 0.0
        spare, rest = [], 0.0
        for t in sorted(most, key=lambda t: (most[t], t)):
            if rest + most[t] >= least - 1e-9:
                break
            spare.append(t)
            rest += most[t]
        leading = [t for t in often if t not in spare]
        if not spare:
            return self._scored(segments, leading, weight, mean).orderBy(F.desc("score"), self.ident).limit(k)
        total = sum(most.values())
        mine = F.element_at(F.create_map(*[F.lit(x) for t in leading for x in (t, weight[t])]), F.col("term"))
        others = F.element_at(F.create_map(*[F.lit(x) for t in leading for x in (t, total - most[t])]), F.col("term"))
        can = self._blocks(segments, leading).where(mine * bound + others >= least - 1e-9)
        candidates = self._postings(segments, leading, can).select(self.ident).distinct()
        return self._scored(segments, list(often), weight, mean, candidates).orderBy(F.desc("score"), self.ident).limit(k)

    def _scored(self, segments: list[dict], terms: list[str], weight: dict[str, float], mean: float, among: DataFrame | None = None) -> DataFrame:
        rows = self._postings(segments, terms)
        rows = rows if among is None else rows.join(among, self.ident, "left_semi")
        idf = F.element_at(F.create_map(*[F.lit(x) for t in terms for x in (t, weight[t])]), F.col("term"))
        return rows.select(self.ident, (idf * _part(F.col("tf"), F.col("length"), mean)).alias("s")).groupBy(self.ident).agg(F.sum("s").alias("score"))


def _counts(ident: str):
    """Rows (id, term, tf, length) of texts' tokens, and for each text one of the empty term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, tfs, lengths = [], [], [], []
            for i, words in enumerate(b.column("t").to_pylist()):
                found = Counter(words)
                at += [i] * (len(found) + 1)
                terms += ["", *found]
                tfs += [0, *found.values()]
                lengths += [len(words)] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays([b.column(ident).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int32()), pa.array(lengths, pa.int32())], [ident, "term", "tf", "length"])

    return run


def _blocks(ident: str):
    """Blocks of the rows of a sorted range: a block ends with its term, after BLOCK rows, or with the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, dtype=bool)
            new[0] = True
            new[1:] = pc.not_equal(b.column("term").slice(1), b.column("term").slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new)
            since = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.append(starts, b.num_rows)))
            at = np.flatnonzero(since % BLOCK == 0)
            ends = pa.array(np.append(at, b.num_rows).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, b.column(c)) for c in (ident, "tf", "length")]
            tf, length = (b.column(c).to_numpy() for c in ("tf", "length"))
            columns = [b.column("term").take(pa.array(at)), *lists, pa.array(np.maximum.reduceat(tf, at)), pa.array(np.minimum.reduceat(length, at)), b.column("bucket").take(pa.array(at))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "ids", "tfs", "lengths", "max_tf", "min_length", "bucket"])

    return run
