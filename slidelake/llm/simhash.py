"""Operator 6: SimHash near-duplicates through vantage-point trees.

Fingerprints are partitioned by their Hamming distance from vantage points. A node splits its fingerprints at a distance
mu: the inner side holds d <= mu, the outer side d > mu. Two fingerprints within r bits of each other that a node parts
have, by the triangle inequality, the outer one at d <= mu + r; so the outer ones of mu < d <= mu + r are sent to the inner
side as well and every other branch is pruned. After any number of splits each linked pair meets in at least one leaf. The
top of the tree deals fingerprints to shards, and within a shard the same rule goes on down to leaves that are compared in
full. Only distinct fingerprints enter the tree, so copies cost nothing there, and a fingerprint has at most 2,080 others
within two bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, table, text_runs
from .components import components

WIDTH, RADIUS, SEED = 3, 2, 42
SHARD, PER_SHARD, MOST_SAMPLE, LEAF = 16_384, 64, 1 << 20, 192
#: Bytes of ids of dropped rows that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 16_000_000

#: Bits of each byte value, least significant first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def fingerprints_of(texts: list[bytes | None], width: int = WIDTH) -> np.ndarray:
    """The 64-bit SimHash of each text. Bits are counted for many texts at once, by byte values of the hashes."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    hashes: list[np.ndarray] = []
    at: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not at:
            return
        sizes = np.array([len(h) for h in hashes])
        flat = np.concatenate(hashes)
        doc = np.repeat(np.arange(len(at)), sizes) * 2048
        counts = np.zeros(len(at) * 2048, np.int64)
        for byte in range(8):
            value = ((flat >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
            counts += np.bincount(doc + byte * 256 + value, minlength=len(counts))
        ones = (counts.reshape(-1, 256) @ _BITS).reshape(len(at), 64)
        bits = ones * 2 > sizes[:, None]
        out[at] = (bits.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        hashes.clear()
        at.clear()
        held = 0

    for i, text in enumerate(texts):
        words = (text or b"").lower().split()
        n = len(words) - width + 1
        if not words:
            continue
        if n < 1:
            h = np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
        else:
            h = np.fromiter((xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))), np.uint64, n)
        hashes.append(h)
        at.append(i)
        held += len(h)
        if held > 100_000 or len(at) >= 256:
            flush()
    flush()
    return out


def fingerprints_in(column: pa.Array, width: int) -> np.ndarray:
    parts = [fingerprints_of(texts, width) for _, texts in text_runs(column)]
    return np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_in(b.column(1), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return src.mapInArrow(run, f"doc_id {kind}, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def split(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 4) -> tuple[np.uint64, int] | None:
    """The vantage point and distance that part the points with least overlap; None if none of those tried parts them."""
    best = None
    for v in rng.choice(points, min(tries, len(points)), replace=False):
        d = distance(points, v)
        mu = int(np.median(d))
        for m in (mu - 1, mu, mu + 1):
            inner, outer = int((d <= m + radius).sum()), int((d > m).sum())
            worst = max(inner, outer) + (inner + outer) / 4
            if inner < len(points) and outer < len(points) and outer and (best is None or worst < best[0]):
                best = (worst, v, m)
    return best and (best[1], best[2])


def top_tree(sample: np.ndarray, per_shard: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, mu, inner child, outer child) over a sample; a child of -1 - k is shard k. Node 0 is the root."""
    rng, nodes, shards = np.random.default_rng(7), [], 0
    todo: list[tuple[np.ndarray, int, int]] = [(sample, -1, 0)]
    while todo:
        points, parent, side = todo.pop()
        parted = split(points, radius, rng) if len(points) > per_shard else None
        if parted is None:
            me, shards = -1 - shards, shards + 1
        else:
            me = len(nodes)
            nodes.append([int(parted[0]), parted[1], 0, 0])
            d = distance(points, parted[0])
            todo += [(points[d <= parted[1]], me, 2), (points[d > parted[1]], me, 3)]
        if parent >= 0:
            nodes[parent][side] = me
    return [tuple(n) for n in nodes]


def route(points: np.ndarray, nodes: list, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, indices of points) for each shard that points belong to or overlap."""
    if not nodes:
        yield 0, np.arange(len(points))
        return
    todo = [(0, np.arange(len(points)))]
    while todo:
        me, at = todo.pop()
        if me < 0:
            yield -1 - me, at
            continue
        v, mu, inner, outer = nodes[me]
        d = distance(points[at], np.uint64(v))
        for child, part in ((inner, at[d <= mu + radius]), (outer, at[d > mu])):
            if len(part):
                todo.append((child, part))


def links(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """For distinct points, the index of the root of each one's group under links of at most radius bits."""
    root = np.arange(len(points))

    def compress() -> None:
        nonlocal root
        while True:
            up = root[root]
            if (up == root).all():
                return
            root = up

    def join(i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            ri, rj = root[i], root[j]
            apart = ri != rj
            i, j, ri, rj = i[apart], j[apart], ri[apart], rj[apart]
            if not len(i):
                return
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            compress()

    rng = np.random.default_rng(11)
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) < 2:
            continue
        own = points[at]
        parted = split(own, radius, rng) if len(at) > leaf else None
        if parted is not None:
            d = distance(own, parted[0])
            inner, outer = at[d <= parted[1] + radius], at[d > parted[1]]
            if len(inner) + len(outer) < 1.7 * len(at):
                todo += [inner, outer]
                continue
        step = max(1, 4_000_000 // len(at))  # a dense leaf is compared in blocks of bounded memory
        for k in range(0, len(at), step):
            i, j = np.nonzero(np.bitwise_count(own[k : k + step, None] ^ own[None, k:]) <= radius)
            near = i < j
            join(at[k + i[near]], at[k + j[near]])
    return root


def near_links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, per_shard: int = PER_SHARD, most_sample: int = MOST_SAMPLE) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of (fp) that span the groups under links of at most radius bits.

    The tree's top is fitted to a sample of per_shard fingerprints for each shard of about shard fingerprints, bounded by
    most_sample; it decides where fingerprints meet, never whether they do. A shard returns at most one edge per
    fingerprint it holds, however dense its groups are.
    """
    n = distinct.count()
    want = min(most_sample, max(1, round(n / shard * per_shard)))
    every = max(1, n // want) if n > shard else 0
    sample = [r[0] for r in distinct.where(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).select("fp").limit(2 * most_sample).collect()] if every else []
    nodes = top_tree(np.sort(np.array(sample, np.int64)).view(np.uint64), per_shard, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s, at in route(fp, nodes, radius):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s, np.int64)), pa.array(fp[at].view(np.int64))], names=["shard", "fp"])

    def pair(t: pa.Table) -> pa.Table:
        fp = np.unique(t.column("fp").to_numpy()).view(np.uint64)
        root = links(fp, radius)
        linked = np.nonzero(root != np.arange(len(fp)))[0]
        return pa.table({"a": fp[linked].view(np.int64), "b": fp[root[linked]].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(pair, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    component_id: the smallest doc_id among the documents that are reached over links of at most radius differing bits,
    itself included. Null and empty texts have fingerprint zero and link like any other. Null ids keep their rows and link
    others, but name no component unless nothing else does (then null). Repeated ids are one document seen more often.
    """
    fps = cut(fingerprint(docs, doc_id, text, width))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))  # combined before the shuffle: hot copies are one row per task
    roots = components(near_links(reps.select("fp"), radius))
    linked = reps.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id")).select(F.col("root").alias("c_root"), "component_id")
    groups = linked.join(least, F.col("root") == F.col("c_root")).select(F.col("fp").alias("g_fp"), "component_id")
    out = fps.join(groups, F.col("fp") == F.col("g_fp"))  # unique on the right: AQE splits a hot fingerprint on the left
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest id; all columns as they are.

    Rows are told apart by id and fingerprint. Of rows equal in both one stays. Rows with a null id stay only if their
    group has no id at all, one for each fingerprint.
    """
    groups = cut(near_duplicates(docs, doc_id, text, width, radius))
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    if not groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null").limit(1).count():
        gone = gone.select(F.col("doc_id").alias("__g_id"))
        size = gone.agg(F.sum(F.octet_length(F.col("__g_id").cast("string")) + 16).alias("b")).first().b or 0
        return docs.join(F.broadcast(gone) if size <= MOST_BROADCAST else gone, F.col(doc_id) == F.col("__g_id"), "left_anti")
    # Ids that are null or repeated do not tell rows apart: fingerprints do, which are computed once more.
    at, kind = docs.columns.index(text), docs.schema
    gone = gone.select(F.col("doc_id").alias("__g_id"), F.conv("fingerprint", 16, -10).cast("long").alias("__g_fp")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = fingerprints_in(b.column(at).cast(pa.binary()), width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps)], names=[*b.schema.names, "__fp"])

    keyed = docs.mapInArrow(run, StructType(list(kind.fields)).add("__fp", "long"))
    out = keyed.join(gone, F.col(doc_id).eqNullSafe(F.col("__g_id")) & (F.col("__fp") == F.col("__g_fp")), "left_anti")
    return out.dropDuplicates([doc_id, "__fp"]).select(*docs.columns)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
