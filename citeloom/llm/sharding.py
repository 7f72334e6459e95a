"""Uniform shuffle into shards of exact sizes by a communication matrix, in DataFrame functions only.

Each partition first puts its rows into a random order. A matrix then says how many rows go from
each partition to each shard; its rows add up to the partitions' sizes, its columns to the shards'.
A partition cuts its order by its row of the matrix, the pieces are exchanged, and each shard puts
what it got into a random order again.

The matrix is drawn from the multivariate hypergeometric distribution without any floating-point
sampler. Every place of a partition draws a shard, which gives multinomial counts. Shards with too
many places give up as many as they have too many, chosen uniformly among all of theirs, and shards
with too few take these in random order. No step tells one place from another, and whatever treats
all places alike and ends with exact column sums is uniform among the assignments with these sums.
About the square root of the number of rows change hands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, columns, fresh, text_of

SHARDS, SEED, LAW = 16, "shard-1", "rows"
MOST_SHARDS = 1 << 15
#: Rows that a bucket of a shard has on average at most; a bucket is sorted in one task.
BUCKET_ROWS = 4_096
#: Entries of the matrix up to which it is sent to all tasks (16 bytes each); a larger one is joined by partition.
SENT_ENTRIES = 1 << 20
_PLACE = (1 << 33) - 1  # bits of monotonically_increasing_id() that count rows within a partition


def _local(df: DataFrame, order: Sequence[Column], part: str, at: str) -> DataFrame:
    """df with its partition's number and the 0-based place in the partition's order."""
    dealt = df.sortWithinPartitions(*order)
    return dealt.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))})


def _hash(seed: str, *values: str) -> Column:
    return F.xxhash64(F.lit(seed), *values)


def _bits(h: Column, n: int) -> Column:
    """The n highest bits of a hash, as a number of 0 to 2^n - 1."""
    return F.shiftrightunsigned(h, 64 - n)


def _ranked(df: DataFrame, keys: Sequence[str], rank: str) -> tuple[DataFrame, Written]:
    """df with the 0-based place in the order of the keys; ranges are sorted for themselves, only their sizes meet."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = Written(_local(df.repartitionByRange(n, *keys), [F.col(k) for k in keys], "__range", "__in"), "ranked")
    sizes = dealt.df.groupBy("__range").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))  # one row a range
    before = F.coalesce(F.sum("n").over(W.partitionBy("one").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))
    return dealt.df.join(F.broadcast(starts), "__range").withColumn(rank, F.col("__in") + F.col("__before")).drop("__range", "__in", "__before"), dealt


def communication(places: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """(part, shard, n): how many of each partition's places go to each shard; zero entries may be left out.

    places: (part int, at long), one row for each row to be dealt, `at` without repeats within a
    part. Shards get equal numbers, the first ones one more where they do not divide. What is
    gathered is one row a shard; the rows that change shards are ranked by ranges.
    """
    draws = places.select("part", "at", F.pmod(_hash(f"{seed}:draw", "part", "at"), F.lit(shards)).cast("int").alias("shard"))
    counts = Written(draws.groupBy("part", "shard").agg(F.count("*").alias("n")), "counts")
    have = {r["shard"]: r["n"] for r in counts.df.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    total = sum(have.values())
    missing = [total // shards + (j < total % shards) - have.get(j, 0) for j in range(shards)]
    if not any(missing):
        return counts.df
    give, take = {j: -m for j, m in enumerate(missing) if m < 0}, {j: m for j, m in enumerate(missing) if m > 0}
    scale, wanted = 1 << 53, {}
    slack = 1
    while True:
        # so many of a shard's places, by a second hash, that enough are there almost surely; else twice as many
        for j, m in give.items():
            wanted[j] = min(scale, -(-scale * slack * (m + 8 * int(m**0.5) + 16) // have[j]))
        level = F.element_at(F.create_map(*[F.lit(x) for j, w in wanted.items() for x in (j, w)]), F.col("shard"))
        drawn = F.shiftrightunsigned(_hash(f"{seed}:out", "part", "at"), 11)
        near = draws.where(F.col("shard").isin(list(wanted))).select("part", "at", "shard", drawn.alias("drawn")).where(F.col("drawn") < level)
        ranked, kept = _ranked(near, ["shard", "drawn", "part", "at"], "rank")
        found = {r["shard"]: (r["n"], r["first"]) for r in ranked.groupBy("shard").agg(F.count("*").alias("n"), F.min("rank").alias("first")).collect()}
        if all(found.get(j, (0, 0))[0] >= m for j, m in give.items()):
            break
        kept.drop()
        slack *= 2
    last = F.element_at(F.create_map(*[F.lit(x) for j, m in give.items() for x in (j, found[j][1] + m)]), F.col("shard"))
    leaving = ranked.where(F.col("rank") < last).select("part", "shard", _hash(f"{seed}:in", "part", "at").alias("turn"), "at")
    waiting, queued = _ranked(leaving, ["turn", "part", "at"], "turn_rank")
    slots, at = [], 0
    for j, m in take.items():
        slots.append((j, at, at + m - 1))
        at += m
    free = F.array(*[F.struct(F.lit(j).alias("to"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for j, a, b in slots])
    free = places.sparkSession.range(1).select(F.inline(free)).select("to", F.explode(F.sequence("a", "b")).alias("turn_rank"))
    moved = waiting.join(free, "turn_rank").select("part", "shard", "to")
    both = F.array(F.struct(F.col("shard").alias("shard"), F.lit(-1).cast("long").alias("n")), F.struct(F.col("to").alias("shard"), F.lit(1).cast("long").alias("n")))
    changes = moved.select("part", F.inline(both))
    matrix = Written(counts.df.unionByName(changes).groupBy("part", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "matrix")
    for one in (counts, kept, queued):
        one.drop()
    return matrix.df


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, by: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard), uniformly among all such orders.

    Shards differ by at most one row. Every row is dealt once, whatever it holds: rows of null ids,
    empty, very long or equal texts and repeated rows are rows like others, so that a group of copies
    is spread like any other rows, and no task gathers it. The random order depends on the columns
    `by` and the seed, and on which rows are read in one partition: reruns over the same files and
    settings agree. Columns named shard and slot are replaced; other columns keep names and values.
    An empty table gives no rows.

    Rows are written once, in their partition's order, and exchanged once, in buckets of about
    BUCKET_ROWS rows.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"shards must be 1 to {MOST_SHARDS}")
    keep = columns(docs, "shard", "slot")
    part, at, turn = (fresh(docs, s) for s in ("part", "at", "turn"))
    keys = ["`" + c.replace("`", "``") + "`" for c in by]
    dealt = Written(_local(docs.select(*keep, _hash(f"{seed}:local", *keys).alias(turn)), [F.col(turn)], part, at).drop(turn), "dealt").df
    matrix = communication(dealt.select(F.col(part).alias("part"), F.col(at).alias("at")), shards, seed)
    ends = matrix.withColumn("end", F.sum("n").over(W.partitionBy("part").orderBy("shard")))
    cuts = ends.groupBy(F.col("part").alias(part)).agg(F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("__cuts"))
    totals = matrix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("part"), F.lit(0)).alias("last")).first()
    few = (totals["last"] + 1) * shards <= SENT_ENTRIES

    bits = max(0, (-(-totals["rows"] // (shards * BUCKET_ROWS)) - 1).bit_length())
    h = _hash(f"{seed}:slot", part, at)
    bucket = _bits(h, bits).cast("int") if bits else F.lit(0)

    def placed(*carried: Column) -> DataFrame:
        met = dealt.select(*carried, part, at).join(F.broadcast(cuts) if few else cuts, part)
        shard = F.get("__cuts", F.size(F.filter("__cuts", lambda c: c["end"] <= F.col(at))))["shard"]
        return met.select(*carried, part, at, shard.alias("shard"), bucket.alias("__bucket"))

    sizes = placed().groupBy("shard", "__bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", "__bucket", before.alias("__before"))
    place = F.row_number().over(W.partitionBy("shard", "__bucket").orderBy(h, part, at)) - 1
    rows = placed(*keep).join(starts, ["shard", "__bucket"]).withColumn("slot", F.col("__before") + place)
    return rows.select(*keep, "shard", "slot")


def digest(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of shuffle(): size is the text's UTF-8 bytes and one more.

    A null text has no bytes. The law is `rows`: grown_shard is null.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = shuffle(rows, shards, seed, ("doc_id", "text_crc32", "size"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
