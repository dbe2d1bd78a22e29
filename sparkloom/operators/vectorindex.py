"""A stored inverted file of vectors: cells around centroids, each a folder of its own, so that a query reads the cells near it and no others.

Centroids come from Spark's distributed k-means by cosine over all vectors. Of each cell the index knows how many vectors it holds and the largest angle
between one of them and the centroid. A query may read its nearest cells only (``probes``), or be exact: angles obey the triangle
inequality, so no vector of a cell is nearer than the centroid's angle less the cell's radius, and cells beyond the k-th best angle are left out with proof.

Vectors without length have no direction; they make up a cell of their own, and their cosine with anything is 0.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..functions import codecs, vectors
from ..session import map_arrow
from ..store import GraphStore, read_small, write_once
from .segments import segments_of, touched_after
from .textindex import fingerprint

#: Bytes of all centroids, at the most: they travel to every task and stay on the driver while an index is open.
CENTROID_BYTES = 32 << 20
MOST_CELLS = 65_536
#: How many cells a query reads is fitted when the index is built: so many rows, the first by a hash of their keys, are searched by brute force, and
#: their nearest CALIBRATION_TOP rows must lie in the cells read but for the rest of TARGET_RECALL.
CALIBRATION_ROWS, CALIBRATION_TOP, TARGET_RECALL = 64, 10, 0.95
LEAST_PROBES = 4
ROUNDS, SEED = 8, 17
#: The cell of vectors without length.
NOWHERE = -1
#: Angles this much beyond the bound are still read: rounding must not lose a vector.
SLACK = 1e-6


def number_of_cells(rows: int, dim: int) -> int:
    """The square root of the rows, as far as the centroids stay within CENTROID_BYTES."""
    return max(1, min(round(math.sqrt(rows)), MOST_CELLS, CENTROID_BYTES // (8 * max(1, dim))))


def _train(units: DataFrame, cells: int) -> np.ndarray:
    """Unit centroids of ``v``, arrays of unit length."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    means = KMeans(k=cells, distanceMeasure="cosine", maxIter=ROUNDS, seed=SEED, initMode="k-means||").fit(units.select(array_to_vector("v").alias("features")))
    return codecs.split_magnitude(np.asarray(means.clusterCenters(), np.float64))[1]


def write_segment(df: DataFrame, touched: DataFrame | None, key: str, vector: str, folder: str, earlier: list[dict] = (), cells: int | None = None) -> dict:
    """Write the rows of ``df`` by cell, what is known of the cells, and the touched keys. Later segments use the centroids of the first."""
    spark = df.sparkSession
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    if earlier:
        centroids = _centroids(spark, earlier[0])
    else:
        length = vectors.magnitude(F.col("v"))
        n, least, most = rows.where(length > 0).agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
        if least != most:
            raise ConfigurationError(f"Vectors have from {least} to {most} components")
        centroids = _train(rows.where(length > 0).select(vectors.direction(F.col("v"), length).alias("v")), cells or number_of_cells(n, most)) if n else np.zeros((0, 0))
        named = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>")
        named.coalesce(1).write.parquet(f"{folder}/centroids")
    # a large cell is dealt to as many files as its size asks for
    assigned = _assign(rows, centroids)
    assigned.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{folder}/rows")
    there = spark.read.schema("angle double, cell int").parquet(f"{folder}/rows")
    there.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).coalesce(1).write.parquet(f"{folder}/cells")
    if touched is not None:
        touched.distinct().write.parquet(f"{folder}/touched")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in assigned.schema.fields)
    return {"folder": folder, "schema": schema, "probes": earlier[0]["probes"] if earlier else _calibrate(rows, centroids, folder)}


def _calibrate(rows: DataFrame, centroids: np.ndarray, folder: str) -> int:
    """How many cells must be read for TARGET_RECALL."""
    if not len(centroids):
        return 0
    length = vectors.magnitude(F.col("v"))
    few = rows.where(length > 0).orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(CALIBRATION_ROWS).select("v").collect()
    asked = [(k, list(r["v"])) for k, r in enumerate(few)]
    truth = codecs.batch_top_k(rows, "key", "v", asked, CALIBRATION_TOP)
    there = rows.sparkSession.read.parquet(f"{folder}/rows").select("key", "cell")
    found = truth.select("query", "key").join(there, "key").select("query", "cell").collect()  # CALIBRATION_ROWS * CALIBRATION_TOP rows
    near = np.argsort(np.argsort(-(codecs.split_magnitude(np.array([v for _, v in asked]))[1] @ centroids.T), axis=1, kind="stable"), axis=1)
    places = np.sort([near[r["query"], r["cell"]] for r in found if r["cell"] != NOWHERE])
    return int(places[math.ceil(TARGET_RECALL * len(places)) - 1]) + 1


def _centroids(spark: SparkSession, segment: dict) -> np.ndarray:
    rows = spark.read.parquet(f"{segment['folder']}/centroids").orderBy("cell").collect()  # within CENTROID_BYTES
    return np.array([r["centroid"] for r in rows], np.float64)


class VectorIndex:
    """``segments``: as :func:`write_segment` describes them, in order."""

    def __init__(self, spark: SparkSession, segments: list[dict]):
        self.spark, self.segments = spark, segments
        self.centroids = _centroids(spark, segments[0])
        self.cells = np.arange(len(self.centroids))
        self.sizes: dict[int, int] = {}
        self.radii = np.full(len(self.cells), -math.inf)  # an empty cell is never near
        for segment in segments:
            for r in spark.read.parquet(f"{segment['folder']}/cells").collect():  # as many as there are centroids
                self.sizes[r["cell"]] = self.sizes.get(r["cell"], 0) + r["n"]
                if r["cell"] != NOWHERE:
                    self.radii[r["cell"]] = max(self.radii[r["cell"]], r["radius"])
        self._rows: DataFrame | None = None

    # reading

    def rows(self) -> DataFrame:
        """``key``, ``v``, ``angle`` (to the centroid), ``cell`` of the rows that no later segment has touched."""
        if self._rows is None:
            parts = []
            for number, segment in enumerate(self.segments):
                there = self.spark.read.schema(segment["schema"]).parquet(f"{segment['folder']}/rows")  # a segment may be empty
                later = touched_after(self.spark, self.segments, number)
                parts.append(there if later is None else there.join(later, "key", "left_anti"))
            self._rows = reduce(DataFrame.unionByName, parts)
        return self._rows

    def _angles(self, query: list[float]) -> np.ndarray:
        unit = codecs.split_magnitude(np.asarray(query, np.float64)[None, :])[1][0]
        return np.arccos(np.clip(self.centroids @ unit, -1, 1)) if len(self.cells) else np.zeros(0)

    def probes(self) -> int:
        """Cells that a query reads unless it says."""
        return max(LEAST_PROBES, self.segments[0]["probes"])

    def nearest_cells(self, query: list[float], probes: int | None = None) -> list[int]:
        return self.cells[np.argsort(self._angles(query), kind="stable")[: probes or self.probes()]].tolist()

    def exact_cells(self, query: list[float], k: int) -> list[int]:
        """Cells that can hold one of the ``k`` nearest vectors: those within the k-th best angle of the nearest cells."""
        angles, near = self._angles(query), self.nearest_cells(query, LEAST_PROBES)
        best = [r["score"] for r in self._top(near, query, k).collect()]  # k rows
        reach = math.acos(max(-1.0, min(1.0, best[-1]))) if len(best) == k else math.pi
        found = self.cells[angles - self.radii <= reach + SLACK].tolist()
        if NOWHERE in self.sizes and reach >= math.pi / 2 - SLACK:
            found.append(NOWHERE)
        return sorted({*near, *found})

    def _top(self, cells: list[int], query: list[float], k: int) -> DataFrame:
        rows = self.rows().where(F.col("cell").isin(cells))
        return rows.select("key", vectors.cosine_with(F.col("v"), query).alias("score")).orderBy(F.desc("score"), "key").limit(k)

    def search(self, query: list[float], k: int, exact: bool = True, probes: int | None = None) -> DataFrame:
        """``key``, ``score`` of the ``k`` nearest rows by cosine; of the nearest cells only unless ``exact``."""
        if not any(query):
            return self._top([], query, k).limit(0)
        return self._top(self.exact_cells(query, k) if exact else self.nearest_cells(query, probes), query, k)

    def search_many(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``query``, ``key``, ``score``, ``rank`` for a table of queries (``query``, ``vector``): each is compared with the rows of its nearest cells."""
        number, centroids, cells = probes or self.probes(), self.spark.sparkContext.broadcast(self.centroids), self.cells

        def near(units: np.ndarray) -> np.ndarray:
            picked = np.argsort(-(units @ centroids.value.T), axis=1, kind="stable")[:, :number]
            out = np.zeros((len(units), len(cells)), bool)
            np.put_along_axis(out, picked, True, axis=1)
            return out

        return codecs.nearest_pairs(self.rows().select("key", F.col("v").alias("value"), "cell"), queries, k, near=near)


def _assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` with the nearest centroid (``cell``) and the ``angle`` to it."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, units = codecs.split_magnitude(codecs.rows_of(batch.column(1)))
            cells, angles = np.full(len(units), NOWHERE, np.int32), np.zeros(len(units))
            some = np.flatnonzero(lengths > 0)
            for at in range(0, len(some), 1024):  # bounds the matrix of cosines
                part = some[at : at + 1024]
                cosines = units[part] @ shared.value.T
                cells[part] = cosines.argmax(axis=1)
                angles[part] = np.arccos(np.clip(cosines.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(angles), pa.array(cells)], ["key", "v", "angle", "cell"])

    key, v = (rows.schema[c].dataType.simpleString() for c in ("key", "v"))
    return map_arrow(rows, run, f"key {key}, v {v}, angle double, cell int")


_open: dict[tuple[str, str], VectorIndex] = {}


def index_for(df: DataFrame, key: str, vector: str, root: str | None, cells: int | None = None) -> VectorIndex | None:
    """The index of a table made of files, below ``root``, written on first use; None where nothing can be kept."""
    if root is None or (name := fingerprint(df, [vector, str(cells)], key)) is None:
        return None
    spark = df.sparkSession
    place = (spark.sparkContext.applicationId, f"{root.rstrip('/')}/vectors-{name}")
    if place not in _open:
        text = read_small(spark, f"{place[1]}/current")
        if text is None:  # of several writers the first to finish names the segment that all use
            made = write_segment(df, None, key, vector, f"{place[1]}/{uuid.uuid4().hex}", cells=cells)
            text = write_once(spark, f"{place[1]}/current", json.dumps(made))
        _open[place] = VectorIndex(spark, [json.loads(text)])
    return _open[place]


def index_of(store: GraphStore, label: str, vector: str = "embedding") -> VectorIndex:
    """The index of a store's table as it is now: what has changed since the last search becomes a segment in the cells that there are."""
    key = store.keys(label)[0]
    write = lambda rows, touched, folder, earlier: write_segment(rows, touched, key, vector, folder, earlier)
    name = hashlib.sha256(vector.encode()).hexdigest()[:16]
    return VectorIndex(store.spark, segments_of(store, label, f"{store.path}/indexes/vectors-{label}-{name}", write))
