"""What the training-data operators share: tables in the shared folder, folds, broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kestrelbase.sources.shared import shared_dir

def keep(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` into the shared folder and return the written table.

    The files outlive any executor and go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kestrelbase-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with the rank from 0 of every row within ``group`` by ``order``; of rows that tie either may come first.

    One sort of the whole by ranges, so neither a group nor rows that tie are ever a single task's.  A row's
    place in its range is then moved by how many of its group lie in earlier ranges: a table of as many rows as
    there are ranges and groups.
    """
    placed = keep(
        df.withColumn("__row", F.monotonically_increasing_id())
        .repartitionByRange(group, *order, "__row")
        .sortWithinPartitions(group, *order, "__row")
        .drop("__row")
        .withColumn("__at", F.monotonically_increasing_id())
    ).withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)})
    earlier = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    moved = (
        placed.groupBy(group, "__range")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
        .select(F.col(group).alias("__group"), F.col("__range").alias("__in"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("__moved"))
    )
    joined = placed.join(F.broadcast(moved), (F.col(group) == F.col("__group")) & (F.col("__range") == F.col("__in")))
    return joined.select(*df.columns, (F.col("__at") + F.col("__moved")).alias(name))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator works on, so that others can't clash with its own."""
    return docs.select("doc_id", "text", *more)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1: labels of these rows are never learned from. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[str], np.ndarray]:
    """At most ``most`` labelled texts that aren't held out, picked by a hash of the id, and their labels.

    The ids are picked from the narrow labels alone, so what reaches the driver is
    bounded by ``most`` texts.  An id labelled more than once counts once, with its
    highest label; null ids and labels don't count.
    """
    picked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .filter(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64(F.lit(label), "doc_id"), "doc_id")
        .limit(most)
        .select(F.col("doc_id").cast("long").alias("doc_id"), "y")
        .toArrow()
    )
    if not picked.num_rows:
        return [], np.zeros(0, np.int32)
    # an Arrow table, as rows of Python objects would start workers of another kind on every executor, which stay
    ids = docs.sparkSession.createDataFrame(picked)
    rows = (
        texts(docs)
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("y").alias("y"))
        .toArrow()
    )
    order = np.argsort(rows["doc_id"].to_numpy())
    found = rows["text"].to_pylist()
    return [found[i] for i in order], rows["y"].to_numpy()[order]


def map_texts(df: DataFrame, score: Callable[[pa.Array], dict[str, np.ndarray]], columns: dict[str, pa.DataType], schema: str) -> DataFrame:
    """Add columns that ``score`` computes from the column ``text``, which is then dropped.

    All other columns of ``df`` pass through as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            out = score(rb.column("text"))
            rest = [n for n in rb.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [rb.column(n) for n in rest] + [pa.array(out[c], t) for c, t in columns.items()],
                names=rest + list(columns),
            )

    return df.mapInArrow(run, schema)


#: Edges that a task reduces at a time.
EDGES = 1 << 19


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, labels) of the components of edges; a label is the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        low = np.minimum(up[x], up[y])
        np.minimum.at(up, up[x], low)
        np.minimum.at(up, up[y], low)
        while not np.array_equal(far := up[up], up):
            up = far
        apart = up[x] != up[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[up]


#: Columns of what ``stars`` yields.
STARS = "node long, label long"


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of edges of longs, reduced EDGES at a time to a spanning forest of stars."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def close() -> Iterator[pa.RecordBatch]:
        nodes, labels = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(labels[i : i + (1 << 16)])], names=["node", "label"])

    for rb in batches:
        held.append((rb.column(0).to_numpy(), rb.column(1).to_numpy()))
        n += rb.num_rows
        if n > EDGES:
            yield from close()
            held, n = [], 0
    if held:
        yield from close()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of an undirected graph given as edges (a, b) of longs; label: the smallest node reachable."""
    return connected_stars(edges.select("a", "b").mapInArrow(stars, STARS))


def connected_stars(found: DataFrame) -> DataFrame:
    """``connected`` of the edges that ``stars`` reduced to ``found``.

    Where the edges come from Python, ``stars`` runs in the same worker: of two in a row each core would have two workers, and keep them.
    Labels spread along the stars and jump to their label's label until none changes.  Every
    round is a join and a partial aggregation; no group is collected.  Nodes whose label moves on are broadcast where they are
    few, so that the many nodes of one label aren't gathered at it.
    """
    found = keep(found.distinct())
    labels = keep(found.groupBy("node").agg(F.min("label").alias("label")))
    links = found.filter("node != label")
    links = links.select(F.col("node").alias("a"), F.col("label").alias("b"))
    both = links.union(links.select("b", "a"))
    while True:
        told = both.join(labels.withColumnsRenamed({"node": "a"}), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("told"))
        nearer = keep(labels.join(told, "node", "left").select("node", "label", F.least("label", F.coalesce("told", "label")).alias("next")))
        jump = nearer.filter("node != next").select(F.col("node").alias("next"), F.col("next").alias("far"))
        few = jump.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        new = keep(nearer.join(F.broadcast(jump) if few else jump, "next", "left").select("node", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label")))
        changed = new.filter("old != label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


#: Ids that may be broadcast: 8 MB of longs.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``ids`` (doc_id); a null id is never in it.

    Up to BROADCAST_IDS distinct ids are broadcast and no text is shuffled; beyond that both sides are
    shuffled by id.
    """
    ids = keep(ids.select(F.col("doc_id").alias("__gone")).filter("__gone is not null").distinct())
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("__gone"), "left_anti")
