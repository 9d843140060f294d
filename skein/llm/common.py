"""Shared helpers: shared-folder tables, Arrow batch plumbing, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent (unit tests on one machine) a temporary
    folder is made, once per application.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="skein-")
    return _LOCAL_FALLBACK[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI: one without a scheme is in the default filesystem."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def stage_table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what came
    before, because the rows are in files that every executor can read.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        hadoop = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        hadoop.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def is_table(df: DataFrame) -> bool:
    """True for Parquet files that are scanned, projected and filtered, no more:
    rows come in the order of the files, and each has an address in them."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter") and plan.deterministic():
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().getClass().getSimpleName() == "ParquetFileFormat"


def as_table(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` itself if its rows have addresses, else a staged copy."""
    return df if is_table(df) else stage_table(df, name)


def address(table: DataFrame) -> list[Column]:
    """``file`` and ``place`` of each row: a hash of its file's name, and its
    number there.  Unlike ids, every row has its own, in every run and split."""
    at = table.metadataColumn("_metadata")
    return [F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("place")]


@contextmanager
def pinned(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (dots as two underscores) for the time of a block."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; behind the last one, memory that is free goes back to the
    system.

    A worker serves one task after the other, and an executor has up to two
    workers a core.  What all of them once needed stays theirs otherwise, and
    counts as the executor's beside the task that runs."""
    try:
        yield from batches
    finally:
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
        pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow``, after which a task's worker keeps no memory for itself."""
    return df.mapInArrow(lambda batches: freed(fn(batches)), schema)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; ``None`` drops the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return map_batches(df, run, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 byte strings, without decoding."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; the same on every machine and in every run."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


#: Odd multipliers, one for each place in a shingle or window.
_PLACES = np.array(
    [xxhash.xxh3_64_intdigest(b"place", seed=k) | 1 for k in range(64)],
    dtype=np.uint64,
)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive items; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * _PLACES[0]
    for i in range(1, k):
        out += h[i : i + n] * _PLACES[i]
    return mix(out)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: ``(id, component)``.

    ``component`` is the smallest id that can be reached.  Each round points
    every node at its smallest neighbour, hands its other smaller neighbours
    to that one, and jumps pointers; the rows never grow beyond the edge list.
    A hub is only ever a join key on a side that AQE may split, and minima are
    combined before the shuffle.  Rounds are cut by shared-folder tables.
    Nodes without an edge to another node are not returned.
    """
    e = stage_table(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct(), "edges")
    while True:
        by_node = e.select("a", "b").repartition("a")
        first = by_node.groupBy("a").agg(F.min("b").alias("p"))
        up = first.select(F.col("a").alias("q"), F.col("p").alias("pp"))
        jumped = first.join(up, first.p == up.q, "left").select(
            "a", F.coalesce("pp", "p").alias("b"), F.col("pp").isNotNull().alias("moved")
        )
        rest = by_node.join(first, "a").where("b != p").select(
            F.greatest("b", "p").alias("a"), F.least("b", "p").alias("b"), F.lit(True).alias("moved")
        )
        before, e = e, stage_table(jumped.unionByName(rest).groupBy("a", "b").agg(F.max("moved").alias("moved")), "edges")
        unstage(before)
        if not e.where("moved").take(1):
            roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
