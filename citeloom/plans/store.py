"""A store of snapshots: tables are kept in parts by ranges of their keys' hashes, a commit writes the parts it touches, and one pointer makes them current."""

from __future__ import annotations

import contextlib
import threading
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import PLACES, TABLES, assert_unique, conform, empty
from .pointers import Pointers

#: Rows of a part up to which it is not divided; snapshots that stay readable; times that a change is made anew after another commit came first.
PART_ROWS, KEEP, TRIES = 1_000_000, 20, 5
#: Rows that a task writes, about, in any number of parts; counts of ranges that a part to be divided is cut by, for each part that comes of it.
TASK_ROWS, CUTS = 250_000, 16
#: Shares of `part_rows` that parts of a whole new table, and of a part that is divided, are filled to.
WHOLE, DIVIDED = 0.9, 0.6
_TOP, _LISTING = 1 << 62, threading.Lock()


class ConcurrentCommitError(RuntimeError):
    """Another commit came first."""


class Part(NamedTuple):
    """Rows of one table whose positions are lo <= position < hi; a part without rows has no path."""

    path: str
    lo: int
    hi: int
    rows: int


@dataclass(frozen=True)
class Change:
    """What a commit does to a table, in this order: rows equal to a row of `delete` in all of its columns go; `upsert` replaces
    rows of its keys; `insert` comes in where its keys are absent; `add` comes in, and a key that is there stops the commit.

    `whole` puts rows in place of all that the table had.
    """

    delete: DataFrame | None = None
    upsert: DataFrame | None = None
    insert: DataFrame | None = None
    add: DataFrame | None = None
    whole: DataFrame | None = None


def position(table: str) -> Column:
    """0 to 2^62 - 1: hash bits of the place that writes are scoped by, then of the key, so that a place of many rows can be divided too."""
    place, key = F.xxhash64(F.col(PLACES[table])), F.xxhash64(*TABLES[table][1])
    return F.shiftleft(F.shiftrightunsigned(place, 33), 31).bitwiseOR(F.shiftrightunsigned(key, 33))


def _parts(pointer: dict | None) -> dict[str, list[Part]]:
    return {name: [Part(*p) for p in parts] for name, parts in (pointer or {}).items()}


def _longs(values: Iterable[int]) -> Column:
    """An array of given numbers as one literal, however many they are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _at_or_below(position: Column, lows: list[int]) -> Column:
    """The number of the last of some rising bounds, of which the first is not above the position, that is not above it; found by halving."""
    bounds, steps = _longs(lows), [1 << b for b in reversed(range(len(lows).bit_length()))]
    go_on = lambda at, step: F.when(F.get(bounds, at + step) <= position, at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), go_on) if len(lows) > 1 else F.lit(0)


def _index(position: Column, parts: list[Part]) -> Column:
    """The number of the part that a position lies in."""
    return _at_or_below(position, [p.lo for p in parts])


@contextlib.contextmanager
def _listed_by_few(spark: SparkSession) -> Iterator[None]:
    """Meanwhile folders are listed by a few tasks a core, instead of by one for each folder; the session is left as it was."""
    key, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism
    with _LISTING:
        before = spark.conf.get(key)
        spark.conf.set(key, str(min(int(before), tasks)))
        try:
            yield
        finally:
            spark.conf.set(key, before)


class Store:
    """Tables under one folder, read and written by Spark, so that the folder may lie in any store.

    A table is a list of parts that tile the positions of its keys. A commit finds the parts that
    its changes fall in, writes these anew, checks their keys, and creates the next pointer file,
    which lists all parts. Parts that outgrow `part_rows` are divided. A commit that fails leaves
    the last pointer as it was. Of two writers the second finds its pointer's number taken; a
    change is then made anew over the other's snapshot. The last `keep` snapshots stay readable,
    older ones go with the parts that only they have.
    """

    def __init__(self, spark: SparkSession, folder: str, part_rows: int = PART_ROWS, keep: int = KEEP):
        self.spark, self.folder, self.part_rows, self.keep = spark, folder.rstrip("/"), part_rows, keep
        self.pointers = Pointers(spark, f"{self.folder}/_current")
        self._listed: dict[str, tuple[tuple[str, ...], DataFrame]] = {}

    def _latest(self) -> tuple[int, dict[str, list[Part]]]:
        number, found = self.pointers.latest()
        return number, _parts(found)

    def current(self) -> dict[str, list[Part]]:
        return self._latest()[1]

    def _read(self, name: str, parts: Iterable[Part]) -> DataFrame:
        """Rows of parts; files are listed once for the parts last asked for, as they never change."""
        paths = tuple(f"{self.folder}/{p.path}" for p in parts if p.path)
        if not paths:
            return empty(self.spark, name)
        if self._listed.get(name, ((), None))[0] != paths:
            schema = empty(self.spark, name).schema
            with _listed_by_few(self.spark):
                self._listed[name] = paths, self.spark.read.schema(schema).parquet(*paths)
        return self._listed[name][1]

    def table(self, name: str) -> DataFrame:
        return self._read(name, self.current().get(name, ()))

    def at(self, name: str, value: str) -> DataFrame:
        """Rows of one place, from the parts it may lie in."""
        low = self.spark.range(1).select(F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.lit(value)), 33), 31)).first()[0]
        parts = [p for p in self.current().get(name, ()) if p.lo < low + (1 << 31) and low < p.hi]
        return self._read(name, parts).where(F.col(PLACES[name]) == value)

    def tables(self) -> dict[str, DataFrame]:
        now = self.current()
        return {name: self._read(name, now.get(name, ())) for name in TABLES}

    def commit(self, changed: dict[str, DataFrame]) -> None:
        """Puts whole tables in place of what they were; a key held twice stops the commit before the flip.

        The tables are made from what the caller has read, so a commit that came in between raises.
        """
        self._flip({name: Change(whole=df) for name, df in changed.items()}, 1)

    def change(self, changes: dict[str, Change] | Callable[[dict[str, DataFrame]], dict[str, Change]]) -> None:
        """Makes changes in one commit, anew if another commit came first; a function gets the tables of the snapshot they are made to."""
        self._flip(changes, TRIES)

    def _flip(self, changes, tries: int) -> None:
        for left in reversed(range(tries)):
            number, now = self._latest()
            made = changes({name: self._read(name, now.get(name, ())) for name in TABLES}) if callable(changes) else changes
            tag = uuid.uuid4().hex
            new = now | {name: self._written(name, now.get(name, []), change, tag) for name, change in made.items()}
            if self.pointers.create(number + 1, new):
                self._forget(number + 1 - self.keep)
                return
            for name in made:  # what was staged is of no use over another snapshot
                self._delete(f"{name}/{tag}")
            if not left:
                raise ConcurrentCommitError(f"commit {number + 1} was made by another writer")

    def _written(self, name: str, parts: list[Part], change: Change, tag: str) -> list[Part]:
        """The table's parts after a change: those it touches are written anew, the others stay.

        What the touched parts hold then is computed once, and put beside the store while it is counted and dealt out.
        """
        key = list(TABLES[name][1])
        new = [conform(df, name) for df in (change.upsert, change.insert, change.add) if df is not None]
        if change.whole is None and not new and not any(p.rows for p in parts):
            return parts  # nothing that could go
        if change.whole is not None or not parts:
            parts = [Part("", 0, _TOP, 0)]
        staged: list[str] = []

        def stage(df: DataFrame) -> DataFrame:
            staged.append(f"_staged/{name}-{tag}-{len(staged)}")
            df.write.parquet(f"{self.folder}/{staged[-1]}")
            return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{staged[-1]}")

        try:
            delete = None if change.delete is None or change.whole is not None else stage(change.delete)
            touched = [0] if change.whole is not None else self._touched(name, parts, delete, new)
            if not touched:
                return parts
            rows = self._read(name, [parts[i] for i in touched])
            if delete is not None:
                rows = rows.join(delete, delete.columns, "left_anti")
            if change.upsert is not None:
                rows = upsert(rows, conform(change.upsert, name), tuple(key))
            if change.insert is not None:
                rows = insert_absent(rows, conform(change.insert, name), tuple(key))
            for df in (change.add, change.whole):
                rows = rows if df is None else rows.unionByName(conform(df, name))
            return self._dealt(name, parts, touched, stage(rows.withColumn("__at", position(name))), tag, WHOLE if change.whole is not None else DIVIDED)
        finally:
            for path in staged:
                self._delete(path)

    def _touched(self, name: str, parts: list[Part], delete: DataFrame | None, new: list[DataFrame]) -> list[int]:
        """Numbers of the parts that new rows or rows that go may lie in."""
        place = PLACES[name]
        spots = [df.select(_index(position(name), parts).alias("i")) for df in new]
        if delete is not None:
            columns = set(delete.columns)
            if set(TABLES[name][1]) | {place} <= columns:
                gone = delete.select(_index(position(name), parts).alias("i"))
            elif place in columns:  # a place may go over several parts
                low = F.shiftleft(F.shiftrightunsigned(F.xxhash64(place), 33), 31)
                gone = delete.select(F.explode(F.sequence(_index(low, parts), _index(low + ((1 << 31) - 1), parts))).alias("i"))
            else:
                gone = self._read(name, parts).join(delete, delete.columns, "left_semi").select(_index(position(name), parts).alias("i"))
            spots.append(gone)
        every = spots[0] if spots else self.spark.range(0).select(F.col("id").alias("i"))
        for s in spots[1:]:
            every = every.unionAll(s)
        found = sorted(r["i"] for r in every.distinct().collect())  # a row a part
        return found if new else [i for i in found if parts[i].rows]

    def _dealt(self, name: str, parts: list[Part], touched: list[int], rows: DataFrame, tag: str, fill: float) -> list[Part]:
        """The parts after the touched ones are written, divided where they outgrow `part_rows`; a key held twice raises."""
        own = [parts[i] for i in touched]
        lows = self._cuts(rows, own, max(1, int(fill * self.part_rows)))
        tasks = max(1, min(len(lows), max(self.spark.sparkContext.defaultParallelism, -(-sum(n for _, n in lows) // TASK_ROWS))))
        key = TABLES[name][1]
        order = W.partitionBy("__part").orderBy("__at", *key)
        dealt = rows.withColumn("__part", _at_or_below(F.col("__at"), [lo for lo, _ in lows])).repartition(tasks, "__part")
        seen = Observation()  # equal keys are neighbours in this order
        met = dealt.withColumn("__met", F.lag(F.struct(*key)).over(order).eqNullSafe(F.struct(*key))).observe(seen, F.count_if("__met").alias("n"))
        met.drop("__met").write.partitionBy("__part").parquet(f"{self.folder}/{name}/{tag}")
        if seen.get["n"]:
            assert_unique(rows, key, name)  # says which
        made: dict[int, list[Part]] = {i: [] for i in touched}
        for k, (lo, n) in enumerate(lows):
            i = touched[bisect_right([p.lo for p in own], lo) - 1] if len(own) > 1 else touched[0]
            hi = min(parts[i].hi, lows[k + 1][0] if k + 1 < len(lows) else _TOP)
            made[i].append(Part(f"{name}/{tag}/__part={k}" if n else "", lo, hi, n))
        return [q for i, p in enumerate(parts) for q in (made[i] if i in made else [p])]

    def _cuts(self, rows: DataFrame, parts: list[Part], most: int) -> list[tuple[int, int]]:
        """(lo, rows) of what parts become: as they are, or in ranges of up to `most` rows if they outgrow `part_rows`.

        Rows are counted by ranges of equal width; one that alone outgrows `part_rows`, as a place of many rows makes
        it, is counted again by ranges between its first and its last position. Only counts come to the driver.
        """
        settled = []
        counted = {r["i"]: (r["n"], r["a"], r["b"]) for r in rows.groupBy(_index(F.col("__at"), parts).alias("i")).agg(F.count("*").alias("n"), F.min("__at").alias("a"), F.max("__at").alias("b")).collect()}  # a row a part
        todo = []
        for i, p in enumerate(parts):
            n, a, b = counted.get(i, (0, 0, 0))
            if n > self.part_rows and a < b:
                todo.append((a, b, n, p.lo))
            else:
                settled.append((p.lo, n, p.lo))
        while todo:
            todo.sort()
            shifts = [max(0, ((b - a) // (CUTS * -(-n // most))).bit_length()) for a, b, n, _ in todo]
            at = F.col("__at")
            j = _at_or_below(at, [a for a, _, _, _ in todo])
            within = rows.select("__at").where(at >= todo[0][0]).withColumn("j", j).where(at <= F.get(_longs([b for _, b, _, _ in todo]), F.col("j")))
            cell = F.call_function("shiftright", at - F.get(_longs([a for a, _, _, _ in todo]), F.col("j")), F.get(_longs(shifts), F.col("j")).cast("int"))
            found = within.groupBy("j", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("__at").alias("a"), F.max("__at").alias("b")).collect()  # some rows a part
            again = []
            for r in found:
                if r["n"] > self.part_rows and r["a"] < r["b"]:
                    again.append((r["a"], r["b"], r["n"], todo[r["j"]][3]))
                else:
                    settled.append((r["a"], r["n"], todo[r["j"]][3]))
            todo = again
        out: list[tuple[int, int]] = []
        last = None
        for lo, n, own in sorted(settled):
            if own != last:  # a part's first range begins where the part does
                out.append((own, n))
            elif out[-1][1] + n > most:
                out.append((lo, n))
            else:
                out[-1] = out[-1][0], out[-1][1] + n
            last = own
        return out

    def _forget(self, number: int) -> None:
        """Removes a snapshot and the parts that the one after it no longer has."""
        numbers = self.pointers.numbers()
        if number not in numbers or number + 1 not in numbers:
            return
        old, kept = (_parts(self.pointers.read(n)) for n in (number, number + 1))
        stay = {p.path for parts in kept.values() for p in parts}
        for path in {p.path for parts in old.values() for p in parts if p.path} - stay:
            self._delete(path)
        self.pointers.remove(number)

    def _delete(self, path: str) -> None:
        fs, p = self.pointers.fs(f"{self.folder}/{path}")
        fs.delete(p, True)

    def is_empty(self) -> bool:
        """Documents alone count."""
        return self.table("document").isEmpty()

    def clear(self) -> dict[str, int]:
        """Empties every table; how many rows of each were there, which the parts tell."""
        had = {name: sum(p.rows for p in parts) for name, parts in self.current().items()}
        self.commit({name: empty(self.spark, name) for name in had})
        return {name: n for name, n in had.items() if n}


def upsert(stored: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """New rows replace stored ones of their key."""
    return new.unionByName(stored.join(new.select(*key), list(key), "left_anti"))


def insert_absent(stored: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Stored rows stay as they are; new ones come in where their key is absent. Stored keys that are new are found first, so that not all are shuffled where there are few new rows."""
    there = stored.select(*key).join(new.select(*key), list(key), "left_semi")
    return stored.unionByName(new.join(there, list(key), "left_anti"))


def created(stored: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """One row: how many keys of new are absent from stored."""
    return new.select(*key).distinct().join(stored.select(*key), list(key), "left_anti").agg(F.count("*").alias("created"))


def insert_edges(stored: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """Edges of which both documents exist, without repeats."""
    have = documents.select("slug")
    ok = new.join(have.withColumnRenamed("slug", "source_slug"), "source_slug", "left_semi").join(have.withColumnRenamed("slug", "target_slug"), "target_slug", "left_semi")
    return stored.unionByName(ok.select("source_slug", "target_slug")).distinct()


def replace_where(stored: DataFrame, new: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows of the given values of a column make way for the new ones."""
    return stored.where(~F.col(column).isin(values) | F.col(column).isNull()).unionByName(new)


def deletion(t: dict[str, DataFrame], slug: str) -> dict[str, Change]:
    """delete_document() as changes: only parts that hold what goes are written."""
    spark = t["document"].sparkSession
    own = spark.createDataFrame([(slug,)], "slug string")
    gone = t["document_version"].where(F.col("slug") == slug).select("version_id")
    edges = t["references_edge"].where((F.col("source_slug") == slug) | (F.col("target_slug") == slug))
    lost = t["anchored_in"].join(t["chunk"].join(gone, "version_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi")
    return {
        "document": Change(delete=own),
        "describes": Change(delete=own),
        "references_edge": Change(delete=edges),
        "document_version": Change(delete=own),
        "issued_by": Change(delete=gone),
        "chunk": Change(delete=gone),
        "anchored_in": Change(delete=lost),
    }


def delete_document(t: dict[str, DataFrame], slug: str) -> dict[str, DataFrame]:
    """A document, its edges, editions and chunks go. Its obligations stay, as they do where this operation comes from."""
    gone = t["document_version"].where(F.col("slug") == slug).select("version_id")
    lost = t["chunk"].join(gone, "version_id", "left_semi").select("chunk_id")
    return {
        "document": t["document"].where(F.col("slug") != slug),
        "describes": t["describes"].where(F.col("slug") != slug),
        "references_edge": t["references_edge"].where((F.col("source_slug") != slug) & (F.col("target_slug") != slug)),
        "document_version": t["document_version"].where(F.col("slug") != slug),
        "issued_by": t["issued_by"].join(gone, "version_id", "left_anti"),
        "chunk": t["chunk"].join(gone, "version_id", "left_anti"),
        "anchored_in": t["anchored_in"].join(lost, "chunk_id", "left_anti"),
    }


def new_reference(spark: SparkSession, source: str, target: str) -> DataFrame:
    """One edge, for a change; a document does not cite itself."""
    if source == target:
        raise ValueError("a document does not cite itself")
    return spark.createDataFrame([(source, target)], "source_slug string, target_slug string")


def add_reference(edges: DataFrame, source: str, target: str) -> DataFrame:
    if source == target:
        raise ValueError("a document does not cite itself")
    return edges.unionByName(edges.sparkSession.createDataFrame([(source, target)], edges.schema)).distinct()


def remove_reference(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.where(~((F.col("source_slug") == source) & (F.col("target_slug") == target)))


