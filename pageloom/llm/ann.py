"""Operator 6: approximate nearest neighbours by a permutation index.

Pivots are the ``PIVOTS`` vectors of least hashed id. A vector is represented by
its ``PREFIX`` nearest pivots in order. Vectors are spread over blocks of about
``BLOCK`` by a hash of the id; a block posts its members in the inverted files of
their pivots, with the place of the pivot in the member's order. The queries are
the vectors whose id is divisible by ``EVERY``. A query visits every block, adds
up the files of its own pivots to the Spearman footrule distance of the truncated
permutations, and the ``SHARE`` of the block that is nearest by footrule is
reranked by cosine; no other cosine is computed.

Every vector is indexed, once. The queries are a stated set against all rows, in
blocks: a query is sent once a block, and what is reranked is the same share of
a table of any size, so recall doesn't change with size but work grows with the
number of queries times the number of vectors. Recall at ``K_NEAREST`` is tested
to be at least 0.9 against brute force, on vectors without any clusters, which
are the hardest case.

Defined results: vectors that are null, empty, of zero length, hold nulls or not
finite values, or are of another dimension than most are left out as queries and
as answers; equal vectors are neighbours of each other, ties go to the lesser id;
a table of n vectors gives each query at most n-1 neighbours; repeated ids count
once, with the least vector; null ids are left out; an empty table gives no row;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Store, table

K_NEAREST = 10
#: The queries are the ids divisible by this.
EVERY = 20
PIVOTS = 256
PREFIX = 64
#: Share of a block that is reranked.
SHARE = 0.2
BLOCK = 32_768
_FOUND = "id long, neighbour long, cosine double"


def permutations(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The nearest pivots of every vector, nearest first; ties go to the lesser pivot."""
    near = -(vectors @ pivots.T)
    keep = min(prefix, len(pivots))
    return np.argsort(near, axis=1, kind="stable")[:, :keep].astype(np.uint16)


def inverted_files(perms: np.ndarray, pivots: int) -> np.ndarray:
    """File of each pivot over the members of a block: the prefix length less the pivot's place, 0 where it isn't posted."""
    width = perms.shape[1]
    files = np.zeros((pivots, len(perms)), np.uint8)
    files[perms.T.astype(np.int64), np.arange(len(perms))] = (width - np.arange(width, dtype=np.int64))[:, None]
    return files


def footrule_gain(query: np.ndarray, files: np.ndarray) -> np.ndarray:
    """What lowers a query's footrule to each member of a block: twice this, from a constant.

    A pivot at places i and j of two prefixes of length w lowers it by ``2 * min(w - i, w - j)``
    against a pivot that only one of them has.
    """
    out = np.zeros(files.shape[1], np.uint16)
    width = len(query)
    for j, pivot in enumerate(query.tolist()):
        out += np.minimum(files[pivot], np.uint8(width - j))
    return out


def _search(ids: np.ndarray, vectors: np.ndarray, perms: np.ndarray, asked: Iterator[tuple[int, np.ndarray, np.ndarray]], pivots: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one block: for each query the best k of the share that is nearest by footrule."""
    files = inverted_files(perms, pivots)
    some = min(len(ids), max(k + 1, int(np.ceil(SHARE * len(ids)))))
    for who, v, perm in asked:
        gain = footrule_gain(perm, files)
        cut = np.partition(gain, len(ids) - some)[len(ids) - some]
        at = np.flatnonzero((gain >= cut) & (ids != who))
        if not len(at):
            continue
        near = vectors[at] @ v
        if len(at) > k:
            least = np.partition(near, len(at) - k)[len(at) - k]
            at, near = at[near >= least], near[near >= least]
        yield np.full(len(at), who), ids[at], near.astype(np.float64)


def _blocks(pivots: int, k: int):
    """Rows of a partition, sorted by block with members first: results of each block."""

    def emit(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        joined = [np.concatenate([np.zeros(0, t), *(f[i] for f in found)]) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in joined], ["id", "neighbour", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            block, asks, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            blob = lambda i, kind: np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).reshape(batch.num_rows, -1)
            if not batch.num_rows:
                continue
            vectors, perms = blob(3, np.float32), blob(4, np.uint16)
            edge = np.flatnonzero((np.diff(block) != 0) | (np.diff(asks) != 0)) + 1
            for s, e in zip([0, *edge], [*edge, batch.num_rows]):
                if block[s] != at:
                    at, held, index = block[s], [], None
                if not asks[s]:
                    held.append((ids[s:e], vectors[s:e], perms[s:e]))
                    continue
                if not held:
                    continue
                index = index or tuple(np.concatenate(x) for x in zip(*held))
                yield emit(list(_search(*index, zip(ids[s:e].tolist(), vectors[s:e], perms[s:e]), pivots, k)))

    return run


def neighbours(vectors: DataFrame, id_name: str = "vec_id", vector: str = "embedding", k: int = K_NEAREST, every: int = EVERY, store: Store | None = None) -> DataFrame:
    """``(vec_id, neighbour, cosine, rank)`` of the k nearest vectors of every query."""
    spark = vectors.sparkSession
    store = store or Store(spark)
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col(id_name).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    clean = clean.groupBy("id").agg(F.min("v").alias("v")).select("id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("len")).where("len > 0")
    clean = store.keep(clean.select("id", F.transform("v", lambda x: (x / F.col("len")).cast("float")).alias("v")))
    sizes = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], f"{id_name} long, neighbour long, cosine double, rank int")
    clean, n = clean.where(F.size("v") == sizes[0]["d"]), sizes[0]["count"]
    blocks = max(1, -(-n // BLOCK))
    pivots = np.array([r["v"] for r in clean.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("v").collect()], np.float32)
    sent = spark.sparkContext.broadcast(pivots)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.float32)
                stored = [pa.array([x.tobytes() for x in y], pa.binary()) for y in (own, permutations(own, sent.value))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *stored], ["id", "v", "perm"])

    rows = clean.mapInArrow(order, "id long, v binary, perm binary")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    members = rows.select(block.alias("block"), F.lit(0).alias("asks"), "id", "v", "perm")
    asked = rows.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "id", "v", "perm")
    found = members.union(asked).repartition(max(blocks, 1), "block").sortWithinPartitions("block", "asks").mapInArrow(_blocks(len(pivots), k), _FOUND)
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(F.col("id").alias(id_name), "neighbour", "cosine", "rank")


def op6_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours, among all embeddings, of every embedding whose id is divisible by 20."""
    return neighbours(table(spark, sf_dir, "embeddings"))
