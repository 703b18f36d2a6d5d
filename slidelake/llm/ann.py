"""Operator 10: approximate nearest neighbours by a permutation index.

Every vector is represented by its PREFIX nearest of PIVOTS pivots, in order. A shard of vectors posts them in one inverted
file per pivot (vector, position of the pivot in its order). A query reads the files of its own nearest pivots, adds up the
footrule distance between the two orders (a pivot that one of them lacks counts as if it stood at the end), and the nearest
of the shard's vectors by footrule, as many as budget() says, are reranked by the measure itself.

Equal vectors are one entry of the index, so copies neither fill a shard nor its budget; each entry carries the smallest ids
of its copies, as many as any answer can need.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

K, PIVOTS, PREFIX = 20, 256, 64
#: A shard of n vectors reranks REACH * n ** POWER of them for each query; a rule of one piece, for every n.
REACH, POWER = 1.6, 0.78
#: Vectors of a shard and queries of a block: 8,192 vectors of 64 components are 4 MB.
SHARD, BLOCK, SAMPLED = 8_192, 8_192, 8


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: with an id, not null, not zero, all components finite."""
    df = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    wild = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return df.where(~F.exists("v", wild) & F.exists("v", lambda x: x != 0)).select("vec_id", F.col("v").cast("array<double>").alias("v"))


def entries(df: DataFrame, k: int) -> DataFrame:
    """(v, ids): the distinct vectors, each with the k + 1 smallest ids of its copies: enough for k without the query's own.

    The limit by rank is applied before the shuffle, so a vector that a third of all rows share is k + 1 rows per task.
    """
    first = Window.partitionBy("v").orderBy("vec_id")
    some = df.distinct().withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= k + 1)
    return some.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def budget(n: int, reach: float = REACH, power: float = POWER) -> int:
    return min(n, math.ceil(reach * n**power))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with a coordinate that brings all norms to most, so that nearness of directions is largest inner product."""
    return np.hstack([x, np.sqrt(np.maximum(0.0, most * most - (x * x).sum(axis=1)))[:, None]])


def apart(sample: np.ndarray, n: int, most_alike: float = 0.8) -> np.ndarray:
    """The first n rows of a sample that are not too alike one taken before; alike pivots would say the same thing twice."""
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    taken: list[int] = []
    for i in range(len(sample)):
        if len(taken) == n:
            break
        if not taken or (unit[taken] @ unit[i]).max() < most_alike:
            taken.append(i)
    return sample[taken]


def order_of(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The prefix nearest pivots of each row, nearest first; equally near ones by number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def postings(order: np.ndarray, n_pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot, the rows that have it in their order, and where."""
    n, k = order.shape
    flat = order.ravel()
    by = np.argsort(flat, kind="stable")
    ends = np.searchsorted(flat[by], np.arange(n_pivots + 1))
    return [(by[a:b] // k, (by[a:b] % k).astype(np.int32)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def search_shard(ids: list[list[int]], x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, most: float, k: int, prefix: int, reach: float) -> tuple[list, list, list]:
    """(query ids, vector ids, scores) of each query's k best in one shard, whose entries are sorted by their first id."""
    files = postings(order_of(lifted(x, most), pivots, prefix), len(pivots))
    q_order = order_of(np.hstack([q, np.zeros((len(q), 1))]), pivots, prefix)
    n = len(x)
    most_found = budget(n, reach)
    place = np.arange(n, dtype=np.int64)
    out: tuple[list, list, list] = ([], [], [])
    for qid, vec, order in zip(q_ids.tolist(), q, q_order, strict=True):
        foot = np.full(n, prefix * len(order), np.int32)
        for pos, p in enumerate(order):
            at, where = files[p]
            foot[at] += np.abs(where - pos) - prefix
        near = np.argpartition(foot * np.int64(n) + place, most_found - 1)[:most_found] if most_found < n else place  # ties to smaller ids
        score = x[near] @ vec
        top = min(k + 1, len(near))  # one entry may be the query alone
        floor = np.partition(score, len(near) - top)[len(near) - top] - 1e-9
        best = near[score >= floor]
        found = sorted((-math.fsum(x[i] * vec), i) for i in best.tolist())
        answers = sorted((s, other) for s, i in found for other in ids[i] if other != qid)[:k]
        out[0].extend([qid] * len(answers))
        out[1].extend(i for _, i in answers)
        out[2].extend(-s for s, _ in answers)
    return out


def nearest(vectors: DataFrame, every: int = 20, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding", n_pivots: int = PIVOTS, prefix: int = PREFIX, reach: float = REACH, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by every, their k nearest found among all others.

    Nearness is the largest inner product in double precision, ties to the smaller id. Pivots are a bounded sample, by
    hash of the vector; all vectors are indexed. Queries in blocks meet entries in shards, each group of bounded size
    whatever the input's; what is shuffled is a row per entry and block and one per query and shard. reach sets the recall
    (measured in the tests and the README).

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id. Rows with
    the query's id are its own; of rows equal in id and vector one counts. Vectors of another length have no inner product
    with a query and are no candidates of it: each length has an index of its own. Without valid vectors there are no rows.
    Columns other than the two are ignored.
    """
    df = cut(valid(vectors, vec_id, embedding))
    lengths = sorted(r.n for r in df.select(F.size("v").alias("n")).distinct().collect())  # the few shapes of a table
    parts = [_of_length(df.where(F.size("v") == n) if len(lengths) > 1 else df, every, k, n_pivots, prefix, reach, shard, block) for n in lengths]
    if not parts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def _of_length(df: DataFrame, every: int, k: int, n_pivots: int, prefix: int, reach: float, shard: int, block: int) -> DataFrame:
    index = cut(entries(df, k))
    queries = df.where(F.col("vec_id") % every == 0).distinct()
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = index.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).first()
    n_shards, n_blocks = max(1, math.ceil(size.n / shard)), max(1, math.ceil(queries.count() / block))
    most = math.sqrt(size.m or 0.0)
    sample = index.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLED * n_pivots).collect()  # bounded
    pivots = apart(lifted(np.array([r.v for r in sample]), most), n_pivots) if sample else np.zeros((0, 1))
    prefix = min(prefix, max(1, len(pivots)))
    own = index.select(F.lit(0).alias("role"), F.pmod(F.xxhash64("v"), F.lit(n_shards).cast("long")).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "ids", "v")
    asks = queries.select(F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks).cast("long")).cast("int").alias("block"), F.array("vec_id").alias("ids"), "v")

    def run(t: pa.Table) -> pa.Table:
        role, v = t.column("role").to_numpy(), matrix(t.column("v"))
        ids = t.column("ids").to_pylist()
        first = np.array([i[0] for i in ids], np.int64)
        a, b = np.nonzero(role == 0)[0], np.nonzero(role == 1)[0]
        if not len(a) or not len(b):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b = a[np.argsort(first[a], kind="stable")], b[np.argsort(first[b], kind="stable")]
        q, i, s = search_shard([ids[j] for j in a], np.ascontiguousarray(v[a]), first[b], v[b], pivots, most, k, prefix, reach)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    found = own.unionByName(asks).groupBy("block", "shard").applyInArrow(run, "query_id long, vec_id long, score double")
    # An id that has several vectors is one candidate, by its best.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
