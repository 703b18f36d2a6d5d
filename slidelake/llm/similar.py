"""Near-duplicates by the exact similarity of shingle sets, candidates from SimHashes of sampled shingles.

Two texts of Jaccard similarity 0.8 differ in about 10 of a SimHash's 64 bits. Within such a radius a vantage-point tree prunes
nothing, as unrelated fingerprints lie 32 bits apart, give or take 4: every branch overlaps every other. So each text has
TABLES fingerprints here, each the SimHash of the SAMPLED shingles that are smallest under a hash of that table. Two texts
draw the same ones with a chance of about the cube of their similarity, at 0.8 in half of the tables, and none of the 16 with
a chance of 1 in 100,000; unrelated texts hardly ever do. Texts with a fingerprint in common are first compared with two of
the texts that share it, by their whole shingle sets. Where that leaves the texts of a fingerprint in several groups, an exact
join of their sets by rare shingles finds the links that are left (rest_links), so no text is compared with all others. Where
many texts share even rare shingles, all of them are compared inside tasks, in blocks, and links that span their groups come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, small, text_runs, written
from .components import components

WIDTH, LEAST, TABLES, SAMPLED = 5, 0.8, 16, 3
#: Ids of dropped rows that may be broadcast, in bytes; more are joined by a shuffle.
MOST_BYTES = 16_000_000
#: Buckets of shingle counts: they only order shingles, so any number gives the same links.
BUCKETS = 1 << 20
#: Keys that share a rare shingle, up to which their pairs are rows; where more do, they are compared inside tasks.
MOST_LIST = 8
#: About so many keys, and bytes of their sets, make a block of those that are compared inside tasks, two blocks at a time.
BLOCK, BLOCK_BYTES = 512, 8_000_000

_SEEDS = np.random.default_rng(23).integers(1, 2**63, TABLES, dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def shingles_of(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending. Fewer words than width: all of them as one; none: nothing."""
    from xxhash import xxh3_64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    if n < 1:
        return np.array([xxh3_64_intdigest(b" ".join(words))], np.uint64)
    return np.unique(np.fromiter((xxh3_64_intdigest(s) for s in map(b" ".join, zip(*[words[k:] for k in range(width)], strict=False))), np.uint64, n))


def sampled_fingerprints(shingles: np.ndarray) -> np.ndarray:
    """A SimHash per table, of the SAMPLED shingles that come first under the table's hash: bits that most of them have.

    Each is marked with its table's number by an exclusive or, so that tables hardly ever name each other's.
    """
    if not len(shingles):
        return np.zeros(TABLES, np.int64)
    with np.errstate(over="ignore"):
        h = (shingles[None] ^ _SEEDS[:, None]) * _M1
        h = (h ^ (h >> np.uint64(33))) * _M2
        h ^= h >> np.uint64(33)
    n = min(SAMPLED, len(shingles))
    low = np.partition(h, n - 1, axis=1)[:, :n]
    if n < 3:
        return (np.bitwise_and.reduce(low, axis=1) ^ _SEEDS).view(np.int64)
    a, b, c = low[:, 0], low[:, 1], low[:, 2]
    return (((a & b) | (a & c) | (b & c)) ^ _SEEDS).view(np.int64)


def key_of(shingles: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def set_rows(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, key, n, fps) per row: a hash of its shingle set, the set's size and its fingerprints."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in text_runs(b.column(1)):
                sets = [shingles_of(t, width) for t in texts]
                fps = pa.array([sampled_fingerprints(s).tolist() for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array([key_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), fps], names=["doc_id", "key", "n", "fps"])

    return src.mapInArrow(run, f"doc_id {kind}, key long, n long, fps array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(key, set), one row per key of (key, rep): the shingle sets of the texts with these ids, made from the texts again.

    Few texts share a fingerprint with another one, so this reads their texts twice instead of storing every text's set.
    """
    ids = wanted.select(F.col("rep").alias("w_id")).distinct()
    size = ids.agg(F.sum(F.octet_length(F.col("w_id").cast("string")) + 16).alias("b")).first().b or 0
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    src = src.join(F.broadcast(ids) if size <= MOST_BYTES else ids, F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in text_runs(b.column(0)):
                sets = [shingles_of(t, width) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "set"])

    made = src.mapInArrow(run, "key long, set binary")
    return written(made.join(wanted.select(F.col("key").alias("w_key")), F.col("key") == F.col("w_key"), "left_semi").dropDuplicates(["key"]))


def near_size(a: Column, b: Column, least: float) -> Column:
    """Whether sets of a and b elements can be so similar."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(least)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of least or more."""
    one, two = (sets.select(F.col("key").alias(f"k_{c}"), F.col("set").alias(f"set_{c}")) for c in "ab")
    both = pairs.join(one, F.col("a") == F.col("k_a")).join(two, F.col("b") == F.col("k_b")).select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = shared >= least * (len(x) + len(y) - shared) - 1e-9
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a long, b long")


def hub_links(classes: DataFrame, docs: DataFrame, least: float, doc_id: str, text: str, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to the keys that fingerprints name, the keys of each shared fingerprint, and the sets of these.

    Each fingerprint names two of its keys, by two orders that differ from fingerprint to fingerprint, and the others are
    compared with these: a row per key, fingerprint and named key at most, however many keys share one.
    """
    posts = classes.where("n > 0").select("key", "n", "rep", F.explode("fps").alias("fp"))
    order = F.xxhash64("key", "fp")
    named = posts.groupBy("fp").agg(F.min_by(F.struct("key", "n"), order).alias("one"), F.max_by(F.struct("key", "n"), order).alias("two"), F.count(F.lit(1)).alias("c")).where("c > 1")
    named = named.select(F.col("fp").alias("n_fp"), "one", "two")
    met = written(posts.join(named, F.col("fp") == F.col("n_fp")).drop("n_fp"))  # AQE splits a fingerprint that very many keys share
    sets = sets_of(docs, met.select("key", "rep").distinct(), doc_id, text, width)
    asked = met.select("key", "n", F.explode(F.array("one", "two")).alias("hub")).where((F.col("key") != F.col("hub.key")) & near_size(F.col("n"), F.col("hub.n"), least))
    pairs = asked.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()
    return cut(verified(pairs, sets, least)), met, sets


def shingle_counts(sets: DataFrame, buckets: int) -> np.ndarray:
    """How many shingles of (set) fall into each of a fixed number of buckets, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for v in b.column(0):
                total += np.bincount((np.frombuffer(v.as_buffer(), np.uint64) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "c"])

    counts = sets.select("set").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[counts["bucket"].to_numpy()] = counts["c"].to_numpy()
    return out


def links_within(keys: np.ndarray, roots: np.ndarray, side: np.ndarray | None, sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """(a, b), a < b: links of similarity least or more between keys of different roots, and of different sides if given.

    All of them up to four a key; beyond that only those that join what is not joined yet, which lead as far. What two sets
    share is counted over an inverted index of all elements, so no pair is left out.
    """
    m = len(keys)
    n = np.fromiter(map(len, sets), np.int64, m)
    inverse, lengths = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    who = np.repeat(np.arange(m), n)[np.argsort(inverse, kind="stable")]
    start, first = np.cumsum(lengths) - lengths, np.cumsum(n) - n
    up = {r: r for r in roots.tolist()}
    name = roots.tolist()

    def find(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    a: list[int] = []
    b: list[int] = []
    for i in range(m - 1):
        lists = inverse[first[i] : first[i] + n[i]]
        c = lengths[lists]
        shared = np.bincount(who[np.repeat(start[lists] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))], minlength=m)[i + 1 :]
        good = (shared >= least * (n[i + 1 :] + n[i] - shared) - 1e-9) & (roots[i + 1 :] != roots[i])
        if side is not None:
            good &= side[i + 1 :] != side[i]
        for j in (np.flatnonzero(good) + i + 1).tolist():
            x, y = find(name[i]), find(name[j])
            if x != y or len(a) < 4 * m:
                a.append(min(int(keys[i]), int(keys[j])))
                b.append(max(int(keys[i]), int(keys[j])))
                up[x] = y
    return a, b


def crowd_links(crowds: DataFrame, some: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links between keys of different roots within each crowd (key, lead), the keys that lists of a shingle connect.

    A crowd is dealt by hash into blocks, every two of which meet in one task with their sets (key, root, set): a row per key
    and block of its crowd, and links that span the groups, however many pairs are alike.
    """
    of = components(crowds.select(F.col("key").alias("a"), F.col("lead").alias("b"))).select("node", F.col("root").alias("crowd"))
    held = written(some.join(of, F.col("key") == F.col("node")).select("crowd", "key", "root", "set"))
    sizes = held.groupBy(F.col("crowd").alias("s_crowd")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum(F.octet_length("set")) / BLOCK_BYTES)).cast("int").alias("n"))
    own = held.join(sizes, F.col("crowd") == F.col("s_crowd")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("n")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select("crowd", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "key", "root", "set")

    def run(t: pa.Table) -> pa.Table:
        key, root, side = (t.column(c).to_numpy() for c in ("key", "root", "block"))
        a, b = [], []
        if (root != root[0]).any():
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in t.column("set").combine_chunks()]
            a, b = links_within(key, root, None if t.column("lo")[0] == t.column("hi")[0] else side, sets, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("crowd", "lo", "hi").applyInArrow(run, "a long, b long")


def rest_links(groups: DataFrame, met: DataFrame, sets: DataFrame, least: float, buckets: int = BUCKETS, most_list: int = MOST_LIST) -> DataFrame:
    """(a, b): every link that hub_links leaves out between keys of different groups (node, root) that share a fingerprint.

    Only fingerprints whose keys, the named two aside, lie in several groups can hide a link. Over the keys of these the join
    is exact: two sets of n and m elements that are least alike share one of the first n - ceil(least * n) + 1 of the one and of
    the first m - ceil(least * m) + 1 of the other, whatever the order. Elements go rare first, by counts of a fixed number
    of buckets, so what many texts share is hardly ever among the first. Pairs are rows only where at most most_list keys
    share an element, so their number is in proportion to the keys; the keys of longer lists go to crowd_links, which
    compares them all and tells links that lead as far as all of theirs.
    """
    own = met.where((F.col("key") != F.col("one.key")) & (F.col("key") != F.col("two.key"))).select("fp", "key")
    own = own.join(groups, F.col("key") == F.col("node"), "left").select("fp", "key", F.coalesce("root", "key").alias("root"))
    open_fp = own.groupBy("fp").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select(F.col("fp").alias("o_fp"))
    left = own.join(open_fp, F.col("fp") == F.col("o_fp"), "left_semi").select(F.col("key").alias("l_key"), "root").distinct()
    some = written(sets.join(left, F.col("key") == F.col("l_key")).select("key", "root", "set"))
    counts = sets.sparkSession.sparkContext.broadcast(np.minimum(shingle_counts(some, buckets), 2**31 - 1).astype(np.int32))  # 4 bytes a bucket
    names = ["key", "root", "n", "at", "shingle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            for key, root, v in zip(*b.columns, strict=True):
                x = np.frombuffer(v.as_buffer(), np.uint64)
                first = len(x) - int(np.ceil(least * len(x) - 1e-9)) + 1
                rare = np.lexsort((x, counts.value[(x % np.uint64(buckets)).astype(np.int64)]))[:first]
                alike = (np.full(first, c, np.int64) for c in (key.as_py(), root.as_py(), len(x)))
                held.append(np.stack([*alike, np.arange(first), x[rare].view(np.int64)]))
                if sum(h.shape[1] for h in held) > 50_000 or len(held) > 500:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.hstack(held)], names=names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.hstack(held)], names=names)

    posts = written(some.mapInArrow(run, ", ".join(f"{c} long" for c in names)))
    lists = posts.groupBy(F.col("shingle").alias("l_shingle")).agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("x"), F.max("root").alias("y"), F.min("key").alias("lead"))
    lists = written(lists.where("x <> y").select("l_shingle", "lead", (F.col("c") > most_list).alias("long")))  # others hide no link
    short = posts.join(lists.where("not long"), F.col("shingle") == F.col("l_shingle"), "left_semi")
    one, two = (short.select(*[F.col(c).alias(f"{side}_{c}") for c in posts.columns]) for side in "ab")
    ahead = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))  # the first shared element has all the others behind it
    enough = ahead * (1 + least) >= (F.col("a_n") + F.col("b_n")) * least - 1e-6
    other = (F.col("a_key") < F.col("b_key")) & (F.col("a_root") != F.col("b_root")) & near_size(F.col("a_n"), F.col("b_n"), least)
    pairs = one.join(two, (F.col("a_shingle") == F.col("b_shingle")) & other & enough).select(F.col("a_key").alias("a"), F.col("b_key").alias("b")).distinct()
    found = verified(pairs, sets, least)
    if not lists.where("long").limit(1).count():
        return found
    crowds = posts.join(lists.where("long"), F.col("shingle") == F.col("l_shingle")).select("key", "lead").distinct()
    return found.unionByName(crowd_links(crowds, some, least)).distinct()


def similar_groups(classes: DataFrame, docs: DataFrame, least: float = LEAST, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(node, root): keys of (key, n, fps, rep) with the smallest key that links of similarity least or more lead to.

    Equal sets are one key. Keys without any link are left out.
    """
    hubs, met, sets = hub_links(classes, docs, least, doc_id, text, width)
    groups = components(hubs)
    rest = rest_links(groups, met, sets, least)
    return components(groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))


def keep_one_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """docs with one document of each group of near-duplicates, that of the smallest id; all columns as they are.

    Texts are near-duplicates if their sets of width-word shingles (words lower-cased, A-Z) are equal or have a Jaccard
    similarity of least or more; groups are what such links connect. Null and empty texts have no shingle and are equal.
    A null id comes after all others; of rows equal in id and set one stays. Extra columns pass through, whatever their
    names; an empty table gives no rows.
    """
    rows = written(set_rows(docs, doc_id, text, width))
    classes = written(rows.groupBy("key").agg(F.first("n").alias("n"), F.first("fps").alias("fps"), F.min("doc_id").alias("rep")))
    roots = similar_groups(classes, docs, least, doc_id, text, width).select(F.col("node").alias("r_key"), "root")
    keys = classes.select("key", "rep").join(roots, F.col("key") == F.col("r_key"), "left").withColumn("root", F.coalesce("root", "key"))
    first = F.struct(F.col("rep").isNull().alias("none"), "rep", "key")
    best = keys.groupBy(F.col("root").alias("b_root")).agg(F.min(first).alias("best"))
    # A row stays if its set is its group's best and its id that set's first.
    won = keys.join(best, F.col("root") == F.col("b_root")).select(F.col("key").alias("w_key"), F.when(F.col("key") == F.col("best.key"), F.col("rep")).alias("w_rep"), (F.col("key") == F.col("best.key")).alias("w_best"))
    judged = cut(rows.select("doc_id", "key").join(won, F.col("key") == F.col("w_key")).select("doc_id", "key", (F.col("w_best") & F.col("doc_id").eqNullSafe(F.col("w_rep"))).alias("stays")))
    if not judged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null").limit(1).count():
        gone = judged.where(~F.col("stays")).select(F.col("doc_id").alias("__gone"))
        size = gone.agg(F.sum(F.octet_length(F.col("__gone").cast("string")) + 16).alias("b")).first().b or 0
        return docs.join(F.broadcast(gone) if size <= MOST_BYTES else gone, F.col(doc_id) == F.col("__gone"), "left_anti")
    # Ids that are null or repeated do not tell rows apart: their sets do, which are hashed once more.
    at, schema = docs.columns.index(text), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [key_of(shingles_of(t, width)) for _, texts in text_runs(b.column(at).cast(pa.binary())) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], names=[*b.schema.names, "__key"])

    keyed = docs.mapInArrow(run, StructType(list(schema.fields)).add("__key", "long"))
    stays = judged.where("stays").select(F.col("doc_id").alias("__id"), F.col("key").alias("__s_key")).distinct()
    stays = F.broadcast(stays) if small(stays, 100_000) else stays
    out = keyed.join(stays, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__s_key")), "left_semi")
    return out.dropDuplicates([doc_id, "__key"]).select(*docs.columns)
