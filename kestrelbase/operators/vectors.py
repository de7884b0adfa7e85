"""Vector distances, exact top-k, and a stored inverted-file index.

Distances to a fixed query are computed on Arrow batches: the vectors of a batch are one numpy matrix without a copy
by row.  All arithmetic is double, and a row's result doesn't depend on the rows around it.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kestrelbase.sources.shared import shared_dir

METRICS = ("cosine", "l2", "l2_squared", "dot")
#: Vectors that are doubles at a time; queries of a batch search that are broadcast at a time.
ROWS, QUERY_BLOCK = 2048, 4096


def matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of ``dims`` elements, which rows have one); rows that are null, of another dimension or hold a null have none."""
    known = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dims
    values = column.filter(pa.array(known)).flatten()
    if values.null_count:
        whole = ~values.is_null().to_numpy(zero_copy_only=False).reshape(-1, dims).any(1)
        known[np.flatnonzero(known)[~whole]] = False
        values = column.filter(pa.array(known)).flatten()
    return values.to_numpy(zero_copy_only=False).reshape(int(known.sum()), dims), known


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the rows of ``x`` to ``q``."""
    out = np.empty(len(x))
    own = float(np.sqrt((q * q).sum()))
    for i in range(0, len(x), ROWS):
        m = x[i : i + ROWS].astype(np.float64)
        if metric in ("l2", "l2_squared"):
            d = ((m - q) ** 2).sum(1)
            out[i : i + ROWS] = np.sqrt(d) if metric == "l2" else d
            continue
        dot = (m * q).sum(1)
        if metric == "dot":
            out[i : i + ROWS] = -dot
            continue
        norm = np.sqrt((m * m).sum(1))
        zero = (norm == 0) | (own == 0)
        out[i : i + ROWS] = np.where(zero, 1.0, 1 - dot / np.where(zero, 1.0, norm * own))
    return out


def distance(vector: Column, query: list[float], metric: str = "cosine") -> Column:
    """Lower is nearer: 1 - cosine (1.0 where a norm is zero), Euclidean or its square, or the negated dot product; null for another dimension."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    q = np.array(query, np.float64)

    @F.arrow_udf("double")
    def near(column: pa.Array) -> pa.Array:
        x, known = matrix(column, len(q))
        out = np.zeros(len(column))
        out[known] = distances(x, q, metric)
        return pa.array(out, mask=~known)

    return near(vector)


def similarity_percent(d: Column) -> Column:
    """100 for distance 0 or less, falling to 0 at 1, and 100 / (1 + d) beyond."""
    return F.when(d <= 0, 100.0).when(d <= 1, (1 - d) * 100).otherwise(100 / (1 + d))


def top_k(df: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "vec_id", metric: str = "cosine") -> DataFrame:
    """The k nearest rows with their ``distance``; vectors of another dimension or null ones are left out; ties go by key."""
    near = df.filter(F.size(vector) == len(query)).withColumn("distance", distance(F.col(vector), query, metric))
    return near.filter("distance is not null").orderBy("distance", key).limit(k)


@dataclass
class InvertedFile:
    """Approximate search: every vector is stored in the cell of its nearest centroid; a search reads the nearest cells only and ranks exactly."""

    centroids: np.ndarray
    cells: DataFrame
    vector: str
    key: str
    metric: str

    def nearest_cells(self, q: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells of each row of ``q``."""
        return np.argsort(_to_centroids(q, self.centroids, self.metric), axis=1, kind="stable")[:, :probes]

    def search(self, query: list[float], k: int, probes: int = 12) -> DataFrame:
        """The nearest k of the rows in the ``probes`` nearest cells; other cells' files aren't read."""
        near = self.nearest_cells(np.array([query], np.float64), probes)[0]
        return top_k(self.cells.filter(F.col("cell").isin([int(c) for c in near])), query, k, self.vector, self.key, self.metric).drop("cell")

    def search_all(self, queries: DataFrame, k: int, probes: int = 12) -> DataFrame:
        """(query_id, key, distance, rank from 1) of the nearest k for every row (query_id, vector) of ``queries``.

        The queries are the stated set: blocks of QUERY_BLOCK are broadcast, each for a pass over the cells.  A task keeps
        the nearest k of a batch for each query, so what is shuffled is a few rows a query and batch.
        """
        schema = f"query_id long, {self.key} {self.cells.schema[self.key].dataType.simpleString()}, distance double"
        out, block = None, []
        rows = queries.filter(F.size(queries.columns[1]) == self.centroids.shape[1]).toLocalIterator()
        for r in rows:
            block.append((int(r[0]), r[1]))
            if len(block) == QUERY_BLOCK:
                part = self._block(block, k, probes, schema)
                out, block = part if out is None else out.union(part), []
        if block or out is None:
            part = self._block(block, k, probes, schema)
            out = part if out is None else out.union(part)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", self.key))
        return out.withColumn("rank", rank).filter(F.col("rank") <= k)

    def _block(self, block: list[tuple[int, list[float]]], k: int, probes: int, schema: str) -> DataFrame:
        dims, key, vector, metric = self.centroids.shape[1], self.key, self.vector, self.metric
        q = np.array([v for _, v in block], np.float64).reshape(len(block), dims)
        own = self.nearest_cells(q, probes)
        shared = self.cells.sparkSession.sparkContext.broadcast((np.array([i for i, _ in block], np.int64), q, own))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, own = shared.value
            for rb in batches:
                x, known = matrix(rb.column(vector), dims)
                names, cell = rb.column(key).filter(pa.array(known)), rb.column("cell").to_numpy()[known]
                for c in np.unique(cell).tolist():
                    inside = np.flatnonzero(cell == c)
                    for i in np.flatnonzero((own == c).any(1)).tolist():
                        d = distances(x[inside], q[i], metric)
                        # all that tie with the k-th stay: ties go by key
                        best = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), ids[i])), names.take(pa.array(inside[best])), pa.array(d[best])], names=["query_id", key, "distance"])

        return self.cells.filter(F.col("cell").isin([int(c) for c in np.unique(own)])).select(key, vector, "cell").mapInArrow(run, schema)


def _to_centroids(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)[None]


def inverted_file(df: DataFrame, vector: str = "embedding", key: str = "vec_id", metric: str = "cosine", cells: int = 16, sample: int = 10_000, rounds: int = 10, path: str | None = None) -> InvertedFile:
    """Fit centroids on at most ``sample`` vectors (picked by a hash of the key) and store every vector in its cell's folder.

    Null vectors and those of another dimension aren't stored.  The table is written to ``path``, or into the shared folder, partitioned by cell.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key)).limit(sample).select(vector).collect()
    # the dimension that most vectors of the sample have; others aren't indexed
    sizes = Counter(len(r[0]) for r in rows)
    dims = min(sizes, key=lambda n: (-sizes[n], n)) if sizes else 0
    x = np.array([r[0] for r in rows if len(r[0]) == dims and None not in r[0]] or np.zeros((1, dims)), np.float64)
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(5)
    centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = _to_centroids(x, centroids, "l2").argmin(1)
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = x[own == c].mean(0)

    @F.arrow_udf("int")
    def cell(column: pa.Array) -> pa.Array:
        m, known = matrix(column, dims)
        out = np.zeros(len(column), np.int32)
        out[known] = _to_centroids(m.astype(np.float64), centroids, metric).argmin(1)
        return pa.array(out, mask=~known)

    to = path or f"{shared_dir(spark)}/kestrelbase-index-{uuid.uuid4().hex}"
    placed = df.filter(F.size(vector) == dims).withColumn("cell", cell(F.col(vector))).filter("cell is not null")
    placed.write.partitionBy("cell").parquet(to)
    return InvertedFile(centroids, spark.read.schema(placed.schema).parquet(to), vector, key, metric)
