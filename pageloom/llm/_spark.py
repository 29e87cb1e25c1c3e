"""Spark-side helpers: shared-folder tables, packed exchange, bitmaps, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernels as K

#: Rows held back before a packed exchange writes them out.
FLUSH_ROWS = 1_000_000
#: Edges of a forest that one task joins; more take distributed rounds.
ALONE = 2_000_000
#: Whether Spark deletes the shuffle files of a command as soon as it has run, not when the driver collects its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def give_back() -> None:
    """Return memory that this process has freed, but its allocators keep, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(docs: DataFrame) -> int:
    """Buckets of a packed exchange: the session's partitions, and no fewer than the scan has, so that they grow with the bytes read."""
    return max(partitions(docs.sparkSession), docs.rdd.getNumPartitions())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="pageloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Store:
    """Tables written to the shared folder, so that a lost executor costs a read and no recomputation.

    ``drop`` deletes a table that nothing reads any more; what a result still
    reads stays until the driver ends. Shuffle files behind a table go as soon as
    it is written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._at = spark, f"{shared_dir(spark)}/pageloom-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._delete, self._at)

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self._at}/{self._n}"
        before = self.spark.conf.get(CLEAN, "false")
        self.spark.conf.set(CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pageloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete kept tables; plans that read them must have run."""
        for df in tables:
            self._delete(df._pageloom_path)

    def _delete(self, at: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None or sc._jsc.sc().isStopped():
            return
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


PACKED = "bucket int, n int, payload binary"


class Packer:
    """Collects rows of fixed-width columns and emits them as one blob per bucket.

    A bucket is a range of the 64-bit key; the exchange then moves a few large
    rows instead of one JVM row per element.
    """

    def __init__(self, buckets: int, narrow: bool = False):
        """narrow: pack the low half of the key only; buckets and low half tell most keys apart."""
        self.buckets, self._narrow, self._held, self._rows = buckets, narrow, [], 0

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return (((key >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)).astype(np.int32)

    def add(self, key: np.ndarray, *columns: np.ndarray, spread: bool = False) -> Iterator[pa.RecordBatch]:
        """spread: rows that needn't meet go to buckets in turn, so that no key is hot."""
        if len(key):
            bucket = ((self._rows + np.arange(len(key))) // 256 % self.buckets).astype(np.int32) if spread else self.bucket(key)
            self._held.append((bucket, key.astype(np.uint32) if self._narrow else key, *columns))
            self._rows += len(key)
        if self._rows >= FLUSH_ROWS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self._held:
            return
        bucket, *columns = (np.concatenate(x) for x in zip(*self._held))
        self._held, self._rows = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[cut[:-1]], pa.int32()),
                pa.array(np.diff(cut).astype(np.int32), pa.int32()),
                pa.array([b"".join(c[s:e].tobytes() for c in columns) for s, e in zip(cut[:-1], cut[1:])], pa.binary()),
            ],
            ["bucket", "n", "payload"],
        )


def unpack(batches: Iterator[pa.RecordBatch], *kinds: type) -> list[np.ndarray]:
    """The columns of all packed rows of a partition."""
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for batch in batches:
        for n, blob in zip(batch.column(1).to_pylist(), batch.column(2)):
            at, view = 0, blob.as_buffer()
            for held, kind in zip(out, kinds):
                held.append(np.frombuffer(view, kind, n, at))
                at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in out]


def runs(sorted_key: np.ndarray) -> np.ndarray:
    """Offsets (n+1) of the runs of equal values."""
    if not len(sorted_key):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1, [len(sorted_key)]))


class Bitmap:
    """A bitmap over 64-bit keys, to skip most rows that a join would drop.

    It never rejects a member. It has about 16 bits a key, between 1 KiB and
    ``MOST`` words (16 MiB), so that broadcasting it is safe at any scale; when
    there are more keys than that, it only skips less.
    """

    MOST = 1 << 21

    def __init__(self, df: DataFrame, column: str):
        n = df.agg(F.approx_count_distinct(column)).first()[0]
        size = 1 << 7
        while size < self.MOST and 4 * size < n:
            size *= 2
        rows = (
            df.select(F.expr(f"shiftrightunsigned({column}, 6) & {size - 1}").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
            .groupBy("w").agg(F.bit_or("b").alias("b"))
        )
        self.words = np.zeros(size, np.int64)
        # As blobs, so that the driver holds no object for each word.
        for r in rows.mapInArrow(self._blobs, "w binary, b binary").collect():
            self.words[np.frombuffer(r["w"], np.int64)] = np.frombuffer(r["b"], np.int64)

    @staticmethod
    def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for k in range(2)], ["w", "b"])

    def __call__(self, key: np.ndarray) -> np.ndarray:
        k = key.astype(np.uint64, copy=False)
        word = self.words.view(np.uint64)[((k >> np.uint64(6)) & np.uint64(len(self.words) - 1)).astype(np.int64)]
        return ((word >> (k & np.uint64(63))) & np.uint64(1)) == 1


class IdBitmap(Bitmap):
    """A bitmap over mixed ids, as running numbers alone would crowd into few words."""

    def __init__(self, df: DataFrame, column: str):
        mix = self._mix

        def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(mix(K.int_column(batch, column)).view(np.int64))], ["m"])

        super().__init__(df.select(column).mapInArrow(mixed, "m long"), "m")

    @staticmethod
    def _mix(ids: np.ndarray) -> np.ndarray:
        return K.mix(ids.astype(np.uint64))

    def ids(self, ids: np.ndarray) -> np.ndarray:
        return self(self._mix(ids))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, and of each node the least one that it reaches."""
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while len(u):
        x, y = root[u], root[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return node, node[root]


def _forest(loops: bool):
    """The edges ``(u, v)`` of a partition as one star a component, ``v`` its least node; ``loops``: with ``(v, v)`` too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, least = [], 0, FLUSH_ROWS
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size > least:
                node, root = forest(*(np.concatenate(x) for x in zip(*held)))
                held, size, least = [[node, root]], len(node), max(FLUSH_ROWS, 2 * len(node))
        if held:
            node, root = forest(*(np.concatenate(x) for x in zip(*held)))
            keep = np.ones(len(node), bool) if loops else node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], ["u", "v"])

    return run


def components(store: Store, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: every node with its least reachable node, ``(node, root)``.

    Each task joins its own edges first. What is left goes to one task if it has
    ``ALONE`` edges at most; more are joined by distributed union-find, alternating
    large-star and small-star rounds, each a table in the shared folder. Null ends
    and loops are left out.
    """
    from pyspark.sql import Window

    e = store.keep(edges.where("a <> b").select("a", "b").mapInArrow(_forest(False), "u long, v long"))
    if e.count() <= ALONE:
        out = store.keep(e.coalesce(1).mapInArrow(_forest(True), "u long, v long"))
        store.drop(e)
        return out.select(F.col("u").alias("node"), F.col("v").alias("root"))
    signature = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        root = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.withColumn("m", root).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = m.select("u", F.col("m").alias("v")).union(m.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = store.keep(small)
        store.drop(e)
        e = new
        row = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if tuple(row) == signature:
            break
        signature = tuple(row)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
