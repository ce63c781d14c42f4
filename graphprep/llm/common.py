"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as a regular expression class: what separates words.
SPACE = r"[\x20\x09-\x0D]"
#: Edges that one task joins into components at once.
TASK_EDGES = 1 << 18

_LOCAL_DIR: str | None = None
_SHIPPED: dict[str, str] = {}
#: What materialize() has written, by application: folders and the threads that wrote them.
_WRITTEN: dict[str, dict[str, int]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can write: spark.checkpoint.dir. In a local session it may be unset: then a temporary one."""
    global _LOCAL_DIR
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="graphprep-")
    return "file://" + _LOCAL_DIR


def fresh(name: str, df: DataFrame) -> str:
    """The name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, name: str, codec: str = "snappy", group_bytes: int = 0) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back. Survives the loss of executors. zstd takes less room and
    more time than snappy. group_bytes, for rows of megabytes: about what a row group holds, so that a reader never has more at once;
    else one holds 100 rows at least, and its reader all of them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, {})[path] = threading.get_ident()
    grouped = {"parquet.block.size": group_bytes, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1} if group_bytes else {}
    df.write.options(compression=codec, **grouped).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._graphprep_path = path
    return out


def written(spark: SparkSession) -> set[str]:
    """The folders that materialize() has written for this application in this thread and that are still there: queries that run
    beside it in other threads keep theirs."""
    return {path for path, thread in _WRITTEN.get(spark.sparkContext.applicationId, {}).items() if thread == threading.get_ident()}


def discard(spark: SparkSession, paths: set[str]) -> None:
    """Delete folders of materialize() that nothing reads any more."""
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths & written(spark):
        where = hadoop(path)
        where.getFileSystem(conf).delete(where, True)
        del _WRITTEN[spark.sparkContext.applicationId][path]


def drop(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete what materialize() has written for frames that nothing reads any more."""
    discard(spark, {f._graphprep_path for f in frames})


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python may not have the repository on its path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="graphprep-"), "graphprep.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = path


def worker_cache(name: str, limit: int = 0) -> dict:
    """A dictionary that lives as long as the Python worker. With a limit it is emptied once it has that many entries."""
    import sys

    caches = sys.__dict__.setdefault("_graphprep_caches", {})
    cache = caches.setdefault(name, {})
    if limit and len(cache) >= limit:
        cache.clear()
    return cache


def give_back() -> None:
    """Return free memory to the system: workers outlive tasks, and what their allocators keep counts as theirs."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, caches: str = "-") -> DataFrame:
    """mapInArrow. Of the worker's caches only those whose names begin with `caches` stay: workers outlive the operators."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        for name, cache in sys.__dict__.get("_graphprep_caches", {}).items():
            if not name.startswith(caches):
                cache.clear()
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def words_of(raw: bytes) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z lower-cased. bytes.lower and bytes.split know ASCII only, as wanted."""
    return raw.lower().split()


def ranked(df: DataFrame, group: list[str], order: list[str], bucket: F.Column, out: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order of (bucket, order), with no task holding a whole group.

    bucket deals a group's rows into parts that each fit a task; the parts' counts give the offsets.
    df must give the same rows whenever it is read.
    """
    b, first = "_rank_bucket", "_rank_offset"
    parts = df.withColumn(b, bucket)
    counts = parts.groupBy(*group, b).agg(F.count(F.lit(1)).alias("_rank_n"))
    offsets = counts.select(*group, b, (F.sum("_rank_n").over(Window.partitionBy(*group).orderBy(b)) - F.col("_rank_n")).alias(first)) if group else counts.select(b, (F.sum("_rank_n").over(Window.partitionBy(F.lit(0)).orderBy(b)) - F.col("_rank_n")).alias(first))
    number = F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)) - 1
    return parts.withColumn("_rank_in", number).join(offsets, [*group, b]).withColumn(out, (F.col(first) + F.col("_rank_in")).cast("long")).drop(b, first, "_rank_in")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n-1 with edges i-j the least node that each is connected to."""
    label = np.arange(n)
    while i.size:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        for at in (i, j, before[i], before[j]):  # the labels themselves too, else news goes one edge a turn
            np.minimum.at(label, at, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _stars(edges: DataFrame, task_edges: int) -> DataFrame:
    """Edges (x, y) that connect the same: those that a task reads, joined into components, each node with the least of its own.
    A task holds task_edges edges and a batch at most; with more it passes on what it has and begins anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, held = [], [], 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            ends, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
            head = ends[forest(len(ends), at[:held], at[held:])]
            return ends[ends != head], head[ends != head]

        for b in batches:
            if held and held + b.num_rows > task_edges:
                one, two = joined()
                x, y, held = [one], [two], len(one)
                if held > task_edges // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["x", "y"])
                    x, y, held = [], [], 0
            x.append(b.column(0).to_numpy())
            y.append(b.column(1).to_numpy())
            held += b.num_rows
        if held:
            one, two = joined()
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], names=["x", "y"])

    return map_batches(edges, run, "x long, y long")


def components(edges: DataFrame, most_rounds: int = 100, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b), longs: rows (id, component), component the smallest id reachable.

    Each task first joins the edges it has, so that what is left are few stars. While these are more than task_edges, large-star
    and small-star steps alternate until the edges stay the same. Each step is an aggregate and a join, so that a node with
    very many edges is spread over tasks. What one task can hold needs no further step. Nodes without edges to others get no row.
    """
    now = materialize(_stars(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")), task_edges), "edges")
    seen = None
    for turn in range(most_rounds):
        sign = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first())
        if sign[0] <= task_edges:
            now = materialize(_stars(now.coalesce(1), task_edges), "edges")
            break
        if sign == seen:
            break
        seen = sign if turn else None  # at first several tasks may have the same edge
        both = now.union(now.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("u"), F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, F.col("x") == F.col("u")).select(F.col("y").alias("x"), F.col("m").alias("y")).where("x > y").distinct()
        small = large.groupBy("x").agg(F.min("y").alias("m")).withColumnRenamed("x", "u")
        linked = large.join(small, F.col("x") == F.col("u"))
        now = materialize(linked.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(linked.select("x", F.col("m").alias("y"))).distinct(), "edges")
    else:
        raise RuntimeError(f"components: not settled after {most_rounds} rounds")
    return now.select(F.col("x").alias("id"), F.col("y").alias("component"))
