"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Each source may give at most `epochs` times its own size. A common level is raised so that
sources at their cap stay there and the others share the rest by weight. A source with target
r times its size gives every document floor(r) times, and some once more, so many that their
sizes add up to the rest. They are found in rounds: a round takes, in the order of a hash, the
documents up to the hash range that would pass what is missing, and the next round, under
another hash, looks among all those left that are small enough. A histogram of hash ranges by
source is all that a round needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Written, columns, fresh, global_rank, text_of, written

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, "mix-1"
ROUNDS, BITS = 4, 12  # rounds, and bits of a round's hash


def n_words(text: str) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _draws(id_col: str, seed: str) -> list[Column]:
    """Hash bits of an id for each round; null ids count as an empty id."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return [F.conv(F.substring(key, 1 + k * BITS // 4, BITS // 4), 16, 10).cast("int").alias(f"draw{k}") for k in range(ROUNDS)]


def _taken(rounds: int, size: Column, draw: Callable[[int], Column], cut: Callable[[int], Column], room: Callable[[int], Column]) -> Column:
    """Whether one of the first rounds took a document."""
    taken = F.lit(False)
    for k in range(rounds):
        taken = taken | ((draw(k) < cut(k)) & (size <= room(k)))
    return taken


def levels(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size, target) for a table of (source, source_size), one row a source.

    Sources take the weights in turn, in code point order with null last; they share the sum of
    all sizes. The level is a scalar that only rises, so each round is one aggregate over the
    sources, however many there are.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    of = written(global_rank(sizes, "source").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(epochs)).alias("cap")), "sources")
    total = of.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("cap")
        got = of.agg(F.count_if(above).alias("n"), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)).alias("capped"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("open")).first()
        if got["n"] == full or not got["open"]:
            break
        level, full = (total - got["capped"]) / got["open"], got["n"]
    return of.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def _with_sources(df: DataFrame, side: DataFrame, few: bool) -> DataFrame:
    side = side.withColumnRenamed("source", "__of")
    return df.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("__of"))).drop("__of")


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS) -> tuple[DataFrame, bool]:
    """(source, source_size, target, whole, cut<k>, room<k> for each round), and whether there are few sources.

    rows has source, size and draw<k>, one row a document. In round k the documents not taken
    before, of size up to room<k>, are taken if draw<k> < cut<k>.
    """
    per = levels(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    last = Written(per.withColumn("whole", whole).withColumn("room0", F.col("target") - F.col("whole") * F.col("source_size")), "plan")
    per = last.df
    few = per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    for k in range(ROUNDS):
        open_ = _with_sources(rows, per.drop("source_size", "target", "whole"), few)
        left = open_.where((F.col("size") <= F.col(f"room{k}")) & (F.col("size") > 0) & ~_taken(k, F.col("size"), lambda j: F.col(f"draw{j}"), lambda j: F.col(f"cut{j}"), lambda j: F.col(f"room{j}")))
        held = left.groupBy("source", f"draw{k}").agg(F.sum("size").alias("held"), F.first(f"room{k}").alias("room"))
        upto = W.partitionBy("source").orderBy(f"draw{k}").rowsBetween(W.unboundedPreceding, 0)  # 2**BITS rows a source at most
        fits = held.withColumn("sum", F.sum("held").over(upto)).where("sum <= room").groupBy(F.col("source").alias("__of")).agg((F.max(f"draw{k}") + 1).alias("cut"), F.max("sum").alias("sum"))
        new = per.join(F.broadcast(fits) if few else fits, F.col("source").eqNullSafe(F.col("__of")), "left")
        now = Written(new.select(*per.columns, F.coalesce("cut", F.lit(0)).alias(f"cut{k}"), (F.col(f"room{k}") - F.coalesce("sum", F.lit(0))).alias(f"room{k + 1}")), "plan")
        last.drop()
        last, per = now, now.df
    return per, few


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED, carry: bool = True) -> DataFrame:
    """One row for each input row: its columns (just the id if not carry), size, source_size, target, times.

    times is how often the mix takes the document. It depends on the seed, the ids and the
    sizes alone, so that reruns agree. Null texts have size 0, null sources form one source,
    rows with the same id are taken alike. An empty table, or one without words, has targets 0.
    Sources' plans are broadcast only up to BROADCAST_ROWS sources and joined by shuffle beyond.
    """
    size, source, draws = n_words(text_col), F.col(source_col).cast("string"), _draws(id_col, seed)
    rows = written(docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), size.alias("size"), *draws), "sizes")
    of, few = plan(rows, weights, epochs)
    made, mine, its = ["size", "source_size", "target", "times"], fresh(docs, "doc"), fresh(docs, "plan")
    if carry:
        keep = columns(docs, *made)
        df = docs.select("*", F.struct(source.alias("source"), size.alias("size"), *draws).alias(mine))
    else:
        keep = [F.col("doc_id")]
        df = rows.select("doc_id", F.struct(*[c for c in rows.columns if c != "doc_id"]).alias(mine))
    of = of.select(F.struct(*of.columns).alias(its))
    df = df.join(F.broadcast(of) if few else of, F.col(f"{mine}.source").eqNullSafe(F.col(f"{its}.source")))
    d, o = (lambda c: F.col(f"{mine}.{c}")), (lambda c: F.col(f"{its}.{c}"))
    more = _taken(ROUNDS, d("size"), lambda k: d(f"draw{k}"), lambda k: o(f"cut{k}"), lambda k: o(f"room{k}")) & (d("size") > 0)
    return df.select(*keep, d("size").alias("size"), o("source_size").alias("source_size"), o("target").alias("target"), (o("whole") + more.cast("long")).alias("times"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus itself: each row as many times as the mix takes it, with all of the input's columns and values, whatever their names."""
    row = F.struct(*columns(docs)).alias("row")
    mixed = mix(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), row), **options)
    return mixed.where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")
