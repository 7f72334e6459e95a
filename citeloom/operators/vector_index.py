"""An inverted-file index over vectors: cells around sampled centroids, as files by cell, so that a search reads the cells it probes.

Centroids come from k-means over a bounded sample of the vectors; every vector is then put into the
cell of the centroid it is nearest to by angle. How many cells a search probes is found when the
index is built: held-out vectors are searched exactly, and so many cells are probed as find the
wanted share of their neighbours. Each cell keeps the largest angle between its centroid and a
vector, which bounds what an unprobed cell can hold: exact() reads those cells too that may hold
something better.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import IndexMismatchError, cosine

#: Vectors that centroids are fitted to at most, those of the least hashes; held-out ones that probes are calibrated on; neighbours they look for.
SAMPLE, HELD, NEIGHBOURS = 20_000, 200, 10
#: Cells at most, whatever the number of vectors; share of true neighbours that probes must find.
MOST_CELLS, RECALL = 4_096, 0.97
ROUNDS = 6


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


@dataclass
class VectorIndex:
    """What is known of an index without reading its rows: as much as there are cells."""

    spark: SparkSession
    folder: str
    ident: str
    model_id: str
    dimensions: int
    probes: int
    recall: float
    kind: str
    centroids: np.ndarray
    radii: np.ndarray
    rows: np.ndarray

    def table(self) -> DataFrame:
        """(cell, id, embedding) of all indexed vectors, partitioned by cell."""
        return self.spark.read.schema(f"{self.ident} {self.kind}, embedding array<float>, cell int").parquet(f"{self.folder}/rows")

    def _angles(self, vector: list[float], model_id: str | None) -> np.ndarray | None:
        if (model_id is not None and model_id != self.model_id) or len(vector) != self.dimensions:
            raise IndexMismatchError(f"the index is of {self.model_id} with {self.dimensions} dimensions")
        v = np.asarray(vector, dtype=np.float64)
        size = np.linalg.norm(v)
        return np.arccos(np.clip(self.centroids @ (v / size), -1, 1)) if size > 0 else None

    def _best(self, cells: np.ndarray, vector: list[float], k: int) -> DataFrame:
        query = F.array(*[F.lit(float(x)) for x in vector])
        found = self.table().where(F.col("cell").isin([int(c) for c in cells]))
        return found.select(self.ident, cosine(F.col("embedding"), query).alias("score")).orderBy(F.desc("score"), self.ident).limit(k)

    def near(self, vector: list[float], k: int, model_id: str | None = None, probes: int | None = None) -> DataFrame:
        """(id, score) of the k nearest by cosine among the vectors of the nearest cells, `probes` of them."""
        angles = self._angles(vector, model_id)
        if angles is None:
            return self.table().select(self.ident, F.lit(0.0).alias("score")).limit(0)
        return self._best(np.argsort(angles, kind="stable")[: probes or self.probes], vector, k)

    def exact(self, vector: list[float], k: int, model_id: str | None = None) -> DataFrame:
        """(id, score) of the k nearest of all: cells that cannot hold one of them by their radius are not read."""
        angles = self._angles(vector, model_id)
        if angles is None:
            return self.table().select(self.ident, F.lit(0.0).alias("score")).limit(0)
        order = np.argsort(angles, kind="stable")
        first = self._best(order[: self.probes], vector, k).collect()  # k rows
        least = first[-1]["score"] if len(first) == k else -2.0
        bound = np.cos(np.maximum(angles - self.radii - 1e-6, 0.0))
        cells = sorted(set(order[: self.probes]) | set(np.flatnonzero(bound >= least - 1e-9)))
        return self._best(np.array(cells), vector, k)

    def near_many(self, queries: DataFrame, k: int, ident: str = "query_id", embedding: str = "embedding", probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): near() for a table of queries, joined with the index by cell; each task keeps its own best k of a query."""
        centroids, take = self.centroids, probes or self.probes
        kind = queries.schema[ident].dataType.simpleString()

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    order = np.argsort(-(_unit(_vectors(b, "v")) @ centroids.T), axis=1, kind="stable")[:, :take]
                    each = pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))
                    yield pa.RecordBatch.from_arrays([b.column("q").take(each), b.column("v").take(each), pa.array(order.reshape(-1).astype(np.int32))], ["q", "v", "cell"])

        own = usable(queries, embedding, self.dimensions).select(F.col(ident).alias("q"), F.col(embedding).cast("array<float>").alias("v"))
        met = own.mapInArrow(probed, f"q {kind}, v array<float>, cell int").join(self.table(), "cell")
        scored = met.select(F.col("q").alias(ident), self.ident, cosine(F.col("v"), F.col("embedding")).alias("score"))
        rank = F.row_number().over(W.partitionBy(ident).orderBy(F.desc("score"), self.ident))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def usable(vectors: DataFrame, embedding: str, dimensions: int) -> DataFrame:
    """Rows whose vector has the width, no null and no other than finite entry, and a length."""
    v = F.col(embedding)
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.where(F.coalesce((F.size(v) == dimensions) & (square > 0) & (square < F.lit(math.inf)), F.lit(False)))


def build(vectors: DataFrame, folder: str, model_id: str, ident: str = "chunk_id", embedding: str = "embedding", cells: int | None = None, recall: float = RECALL, sample: int = SAMPLE, seed: int = 1) -> VectorIndex | None:
    """Indexes every usable vector of the most frequent width in a new folder; None if there is none.

    Two passes read the vectors: one counts and samples, one assigns and writes. The calibration
    reads the index once. A cell that many vectors fall into, such as copies of one, is written in
    several files by several tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    widths = vectors.where(F.size(embedding) > 0).groupBy(F.size(embedding).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not widths:
        return None
    d, n = widths[0]["d"], widths[0]["n"]
    good = usable(vectors, embedding, d).select(ident, F.col(embedding).cast("array<float>").alias("embedding"))
    kind = good.schema[ident].dataType.simpleString()
    # a hash range that holds about twice the sample, of which the least hashes are taken
    share = min(1.0, 2 * (sample + HELD) / n)
    drawn = F.xxhash64(F.lit("sample"), F.col(ident).cast("string"))
    some = good.withColumn("h", drawn).where(F.shiftrightunsigned("h", 11) <= int(share * ((1 << 53) - 1))).orderBy("h", ident).limit(sample + HELD).drop("h").collect()
    if not some:
        return None
    held, fitted = some[:HELD], some[min(HELD, len(some) // 2) :]
    wanted = max(1, min(cells or math.ceil(math.sqrt(n)), MOST_CELLS, len(fitted)))
    points = spark.createDataFrame([(_unit(np.array([r["embedding"]], dtype=float))[0].tolist(),) for r in fitted], "v array<double>").select(array_to_vector("v").alias("features"))
    if wanted > 1:
        model = KMeans(k=wanted, distanceMeasure="cosine", initMode="random", maxIter=ROUNDS, seed=seed).fit(points)
        centroids = _unit(np.array(model.clusterCenters()))
    else:
        centroids = _unit(np.array([np.mean([r["embedding"] for r in fitted], axis=0) + 1e-9]))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = _unit(_vectors(b, "embedding")) @ centroids.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle)], [ident, "embedding", "cell", "angle"])

    placed = good.mapInArrow(assigned, f"{ident} {kind}, embedding array<float>, cell int, angle double")
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{folder}/rows")
    found = spark.read.schema("angle double, cell int").parquet(f"{folder}/rows").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("rows")).collect()  # a row a cell
    radii, rows = np.full(len(centroids), -math.inf), np.zeros(len(centroids), dtype=np.int64)
    for r in found:
        radii[r["cell"]], rows[r["cell"]] = r["radius"], r["rows"]
    index = VectorIndex(spark, folder, ident, model_id, d, len(centroids), 1.0, kind, centroids, radii, rows)
    index.probes, index.recall = _calibrated(index, held, recall)
    spark.createDataFrame([(c, centroids[c].tolist(), float(radii[c]), int(rows[c])) for c in range(len(centroids))], "cell int, centroid array<double>, radius double, rows long").coalesce(1).write.parquet(f"{folder}/cells")
    told = {"ident": ident, "model_id": model_id, "dimensions": d, "probes": index.probes, "recall": index.recall, "kind": kind}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{folder}/about")
    return index


def _calibrated(index: VectorIndex, held: list, recall: float) -> tuple[int, float]:
    """The fewest probes that find the wanted share of held-out vectors' true neighbours, and the share they find."""
    ids, points = [r[index.ident] for r in held], _unit(np.array([r["embedding"] for r in held], dtype=float))
    ident = index.ident

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's own nearest for each held-out vector: NEIGHBOURS + 1 each, as one is the vector itself."""
        kept: list[tuple] = [() for _ in ids]
        for b in batches:
            if not b.num_rows:
                continue
            near = points @ _unit(_vectors(b, "embedding")).T
            most = min(NEIGHBOURS + 1, b.num_rows)
            top = np.argpartition(-near, most - 1, axis=1)[:, :most]
            names, cells = b.column(ident).to_pylist(), b.column("cell").to_pylist()
            for i in range(len(ids)):
                kept[i] = tuple(sorted((*kept[i], *((-near[i, j], names[j], cells[j]) for j in top[i] if names[j] != ids[i])), key=lambda x: x[0])[:NEIGHBOURS])
        out = [(i, c, s, v) for i, one in enumerate(kept) for s, v, c in one]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.float64())], ["i", "cell", "s"])

    rank = F.row_number().over(W.partitionBy("i").orderBy("s", "cell"))
    near = index.table().mapInArrow(best, "i int, cell int, s double").withColumn("rank", rank).where(F.col("rank") <= NEIGHBOURS).select("i", "cell").collect()  # NEIGHBOURS a held-out vector
    if not near:
        return len(index.centroids), 1.0
    order = np.argsort(-(points @ index.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    at = np.sort([place[r["i"], r["cell"]] for r in near])
    probes = int(at[min(len(at) - 1, math.ceil(recall * len(at)) - 1)]) + 1
    return probes, float((at < probes).mean())


def load(spark: SparkSession, folder: str) -> VectorIndex:
    about = json.loads(spark.read.text(f"{folder}/about").first()["value"])
    cells = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # a row a cell
    return VectorIndex(spark, folder, **about, centroids=np.array([r["centroid"] for r in cells]), radii=np.array([r["radius"] for r in cells]), rows=np.array([r["rows"] for r in cells]))
