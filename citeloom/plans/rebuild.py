"""Rebuilding what is derived from an edition: jobs with progress, a deadline and retention, and the commit that a rebuild ends in."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking, embedding, links, obligations
from ..operators.search import IndexMismatchError
from ..sources.shared import dropped, new_folder, written
from .store import Change, Store

#: Seconds that a job may take, and that its rows are kept; chunks of a batch of extraction, after each of which progress is told.
JOB_TIMEOUT, RESULT_TTL, BATCH = 1_800, 86_400, 16
JOB = "run_id string, version_id string, state string, done int, total int, error string"
OPEN = ("queued", "started")


class UnknownEditionError(LookupError):
    """The store has no such edition."""


class BusyError(RuntimeError):
    """A rebuild of this edition is queued or running."""


class LateError(TimeoutError):
    """A rebuild took longer than it may."""


class CancelledError(RuntimeError):
    """A rebuild was cancelled."""


def status(jobs: DataFrame) -> DataFrame:
    """The latest state of each run."""
    return jobs.groupBy("run_id").agg(F.max_by(F.struct("version_id", "state", "done", "total", "error", "at"), F.struct("at", "done", "state")).alias("j")).select("run_id", "j.*")


def live(jobs: DataFrame, now: str | None = None, ttl: int = RESULT_TTL) -> DataFrame:
    """Job rows within the time for which results are kept."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    return jobs.where(F.col("at") >= at - F.make_dt_interval(secs=F.lit(ttl).cast("decimal(18,6)")))


def running(jobs: DataFrame, timeout: float = JOB_TIMEOUT) -> DataFrame:
    """Runs that are queued or started and have told of themselves within the time a job may take; others are lost."""
    return status(live(jobs, ttl=int(timeout) + 1)).where(F.col("state").isin(*OPEN))


def enqueue(store: Store, version_id: str, timeout: float = JOB_TIMEOUT) -> str:
    """A new run of an edition that the store has, unless one is queued or started."""
    if store.table("document_version").where(F.col("version_id") == version_id).isEmpty():
        raise UnknownEditionError(version_id)
    run = uuid.uuid4().hex
    row = _row(store, run, version_id, "queued", 0, 0)

    def queued(t: dict[str, DataFrame]) -> dict[str, Change]:  # looks again if another commit came first
        if not running(t["job"], timeout).where(F.col("version_id") == version_id).isEmpty():
            raise BusyError(version_id)
        return {"job": Change(insert=row)}

    store.change(queued)
    return run


def expire(store: Store, ttl: int = RESULT_TTL) -> None:
    """Removes the rows of runs that ended longer ago than results are kept."""
    old = status(store.table("job")).join(live(store.table("job"), ttl=ttl).select("run_id").distinct(), "run_id", "left_anti").select("run_id")
    store.change({"job": Change(delete=old)})


def _row(store: Store, run: str, version_id: str, state: str, done: int, total: int, error: str | None = None) -> DataFrame:
    return store.spark.createDataFrame([(run, version_id, state, done, total, error)], JOB).withColumn("at", F.current_timestamp())


def _log(store: Store, *row) -> None:
    store.change({"job": Change(upsert=_row(store, *row))})


def _extracted(store: Store, run: str, version_id: str, chunks: DataFrame, total: int, extractor: obligations.Extractor, batch: int, workers: int | None, on_progress: Callable[[int, int], None], stop: threading.Event) -> None:
    """Brings what the chunks need into the cache, as a stream of batches: each is a commit of its answers and of its progress.

    What a batch has brought stays if a later one fails, and its chunks are not asked for again.
    """
    spark = store.spark
    folder = new_folder(spark, "extraction")
    chunks.repartitionByRange(-(-total // batch), "ordinal").write.option("maxRecordsPerFile", batch).parquet(f"{folder}/chunks")
    done = 0

    def one(df: DataFrame, _: int) -> None:
        if stop.is_set():
            return
        with dropped():
            batch_done(df)

    def batch_done(df: DataFrame) -> None:
        nonlocal done
        df = df.persist()
        try:
            n = df.count()
            new = written(obligations.missing(df, extractor, store.table("extraction_cache"), workers), "answers")
            done += n
            store.change({"extraction_cache": Change(insert=new), "job": Change(upsert=_row(store, run, version_id, "started", done, total))})
            on_progress(done, total)
        finally:
            df.unpersist()

    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/chunks")
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    try:
        while not query.awaitTermination(1):
            if stop.is_set():
                break
    finally:
        query.stop()


@dropped()
def rebuild(
    store: Store, run: str, version_id: str, pages: DataFrame, extractor: obligations.Extractor, candidates: list[str] | None = None, on_progress: Callable[[int, int], None] = lambda done, total: None,
    batch: int = BATCH, workers: int | None = None, stop: threading.Event | None = None,
) -> dict[str, int]:
    """Chunks, obligations, anchors and proposals of an edition anew; decisions are replayed. A failure leaves all but the cache of extractions as it was.

    Progress is told after each batch of chunks, rising to their number. Proposals at this edition's
    old obligations go too; approvals stay, as they are decisions.
    """
    stop = stop or threading.Event()
    done = total = 0

    def told(d: int, n: int) -> None:
        nonlocal done
        done = d
        on_progress(d, n)

    try:
        new_chunks = written(chunking.chunks(pages.withColumn("version_id", F.lit(version_id))), "chunks")
        total = new_chunks.count()
        if not total:
            raise ValueError(f"{version_id} has no text")
        _log(store, run, version_id, "started", 0, total)
        _extracted(store, run, version_id, new_chunks, total, extractor, batch, workers, told, stop)
        if stop.is_set():
            raise CancelledError(run)
        found, anchors, _ = obligations.extract(new_chunks, extractor, store.table("extraction_cache"), keep=lambda df: df)
        found = written(found, "obligations")
        anchors = written(obligations.checked_anchors(found, anchors, new_chunks), "anchors")
        counts = store_derived(store, version_id, new_chunks, found, anchors, extractor.adapter_id, candidates, stop)
        _log(store, run, version_id, "finished", total, total)
        return counts
    except Exception as e:
        _log(store, run, version_id, "failed", done, total, ("cancelled" if stop.is_set() else str(e))[:500])
        raise


def store_derived(store: Store, version_id: str, chunks: DataFrame, found: DataFrame, anchors: DataFrame, proposer: str, candidates: list[str] | None = None, stop: threading.Event | None = None) -> dict[str, int]:
    """One commit of all that is derived from an edition; how many rows of each there are now."""
    spark, result = store.spark, {}
    own = spark.createDataFrame([(version_id,)], "version_id string")

    def changes(t: dict[str, DataFrame]) -> dict[str, Change]:
        old = t["obligation"].where(F.col("version_id") == version_id).select("obligation_id")
        stay = t["obligation"].where(F.col("version_id") != version_id)
        others = stay if candidates is None else stay.where(F.col("version_id").isin(candidates))
        proposed = written(links.proposals(found, others, proposer), "proposals")
        at = lambda c: old.withColumnRenamed("obligation_id", c)
        gone = lambda df: df.join(at("source_id"), "source_id", "left_semi").unionByName(df.join(at("target_id"), "target_id", "left_semi")).distinct()
        kept = t["implements"].join(at("source_id"), "source_id", "left_anti").join(at("target_id"), "target_id", "left_anti")
        after, counts = links.replay(kept, t["link_decision"], stay.unionByName(found))
        after = written(after, "links")
        result.update(counts.first().asDict() | {"chunks": chunks.count(), "obligations": found.count(), "proposals": proposed.count()})
        if stop is not None and stop.is_set():
            raise CancelledError(version_id)
        key = ["source_id", "target_id"]
        return {
            "chunk": Change(delete=own, upsert=chunks),
            "obligation": Change(delete=own, upsert=found),
            "anchored_in": Change(delete=t["anchored_in"].join(old, "obligation_id", "left_semi"), upsert=anchors),
            "implements_proposed": Change(delete=gone(t["implements_proposed"]).select(*key), upsert=proposed),
            "implements": Change(delete=t["implements"].join(after, key, "left_anti"), insert=after),
            "change": Change(delete=t["change"].where((F.col("from_version_id") == version_id) | (F.col("to_version_id") == version_id)).select("change_id", "to_version_id")),
        }

    store.change(changes)
    return result


class Jobs:
    """Runs rebuilds in threads of the driver, each with a deadline; a run that is late or cancelled stops its Spark jobs and is told as failed."""

    def __init__(self, store: Store, timeout: float = JOB_TIMEOUT, ttl: int = RESULT_TTL):
        self.store, self.timeout, self.ttl = store, timeout, ttl
        self._stops: dict[str, threading.Event] = {}
        self._threads: dict[str, InheritableThread] = {}

    def submit(self, version_id: str, pages: DataFrame, extractor: obligations.Extractor, **options) -> str:
        """A new run, begun in its own thread."""
        run = enqueue(self.store, version_id, self.timeout)
        stop = self._stops[run] = threading.Event()
        sc = self.store.spark.sparkContext

        def work() -> None:
            sc.setJobGroup(run, f"rebuild of {version_id}", interruptOnCancel=True)
            deadline = threading.Timer(self.timeout, self.cancel, (run,))
            deadline.start()
            try:
                rebuild(self.store, run, version_id, pages, extractor, stop=stop, **options)
            except Exception:  # noqa: S110  told in the job's row
                pass
            finally:
                deadline.cancel()

        thread = self._threads[run] = InheritableThread(target=work, daemon=True)
        thread.start()
        return run

    def cancel(self, run: str) -> None:
        """Stops a run of this driver; its row says so, and its edition can be queued again."""
        if (stop := self._stops.get(run)) is not None:
            stop.set()
            self.store.spark.sparkContext.cancelJobGroup(run)

    def wait(self, run: str, seconds: float | None = None) -> dict:
        """The run's state once it has ended, or after so many seconds."""
        began = time.time()
        if (thread := self._threads.get(run)) is not None:
            thread.join(seconds)
        while (row := self.status(run).first()) is not None and row["state"] in OPEN and seconds is not None and time.time() - began < seconds:
            time.sleep(0.2)
        return row.asDict() if row is not None else {}

    def status(self, run: str) -> DataFrame:
        """The run's latest state, while results are kept."""
        return status(live(self.store.at("job", run), ttl=self.ttl))


@dropped()
def decide(store: Store, source: str, target: str, verdict: str, actor: str, rationale: str = "") -> dict[str, int]:
    """Records a verdict and replays all, in one commit."""
    new = store.spark.createDataFrame([(source, target, verdict, actor, rationale)], "source_obligation_id string, target_obligation_id string, verdict string, actor string, rationale string").withColumn("at", F.current_timestamp())
    result = {}

    def changes(t: dict[str, DataFrame]) -> dict[str, Change]:
        decisions = written(links.decide(t["link_decision"], new), "decisions")
        after, counts = links.replay(t["implements"], decisions, t["obligation"])
        after = written(after, "links")
        result.update(counts.first().asDict())
        latest = decisions.where((F.col("source_obligation_id") == source) & (F.col("target_obligation_id") == target))
        return {"link_decision": Change(upsert=latest), "implements": Change(delete=t["implements"].join(after, ["source_id", "target_id"], "left_anti"), insert=after)}

    store.change(changes)
    return result


@dropped()
def embed(store: Store, embedder: embedding.Embedder, index: str = "chunk") -> int:
    """Vectors for all chunks that lack the model's, written back with the index's identity; how many were written.

    Vectors of another width than the port's raise before anything is written; of no dimensions there is nothing to do.
    """
    if not embedder.dimensions:
        return 0
    chunks = store.table("chunk")
    new = written(embedding.missing(chunks, embedder), "vectors")
    n = new.count()
    if not n:
        return 0
    if not new.where(F.size("embedding") != embedder.dimensions).isEmpty():
        raise IndexMismatchError(f"vectors are not of {embedder.dimensions} dimensions")
    full = chunks.drop("embedding", "embedding_model").join(new, ["chunk_id", "version_id"])
    identity = store.spark.createDataFrame([(index, embedder.model_id, embedder.dimensions)], "name string, model_id string, dimensions int")
    store.change({"chunk": Change(upsert=full), "embedding_index": Change(upsert=identity)})
    return n


@dropped()
def keep_changes(store: Store, changed: DataFrame, before: str, after: str) -> DataFrame:
    """The changes between two editions, stored in place of earlier ones."""
    changed = written(changed, "changes")
    pair = lambda t: t["change"].where((F.col("from_version_id") == before) & (F.col("to_version_id") == after))
    store.change(lambda t: {"change": Change(delete=pair(t).select("change_id", "to_version_id"), upsert=changed)})
    return store.at("change", after).where(F.col("from_version_id") == before)
