"""Operator 4: remove word passages that occur more than once, found with suffix automata of reference shards.

A window of SIZE words is known by its anchor: the smallest hash among its runs of GRAM words. Equal windows have equal
anchors at the same place, so all occurrences of a window fall to the same anchor, and neighbouring windows mostly share
one: a maximal run of windows with one anchor occurrence is a segment. Reference shards are sets of anchors, an anchor of
very many distinct segments being several: each shard's distinct segments are built into a suffix automaton, weighted by how
often they occur, and segments are streamed through it for matching statistics. A window goes if the automata of its anchor
hold it twice or more; every window that is removed is found so, word by word.

The automata are co-partitioned with the segments rather than broadcast: broadcasting every shard to every document would
cost the square of the corpus. Hashes only prune: an anchor that occurs once has no repeat, and segments that are equal by
anchor and digest (128 bits together) are streamed once for all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .bloom import bloom_of, sift
from .common import short_batches, table, text_runs, tidy, written

SIZE, GRAM = 35, 6
#: Distinct segments that one automaton holds, and segments that are streamed through it in one group: an anchor with more is
#: dealt to several automata, and what they count is added up.
MOST_IN_SHARD, MOST_IN_STREAM = 2_000, 20_000

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ODD = 0x5851F42D4C957F2D


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


class WordIds(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest

        if len(self) > 150_000:
            self.clear()
        out = self[word] = xxh3_64_intdigest(word)
        return out


def segments(ids: np.ndarray, sizes: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, first window, windows, anchor, digest) of every segment of the texts, which lie in ids end to end.

    The digest is of the segment's words, by a polynomial over their hashes.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    total = len(ids)
    if total < size:
        return none
    with np.errstate(over="ignore"):
        rolled = np.zeros(total - gram + 1, np.uint64)
        for k in range(gram):
            rolled = rolled * _M1 + ids[k : total - gram + 1 + k]
        rolled = _mix(rolled)
    reach = size - gram + 1
    n = total - size + 1
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)[:n]
    inside = np.arange(n) - first[doc] <= sizes[doc] - size  # windows that stay in their text
    # leftmost least hash in each window, by doubling
    at = np.arange(len(rolled))
    step, width = at, 1
    while width * 2 <= reach:
        a, b = step[: len(step) - width], step[width:]
        step = np.where(rolled[b] < rolled[a], b, a)
        width *= 2
    a, b = step[:n], step[reach - width : reach - width + n]
    anchor = np.where(rolled[b] < rolled[a], b, a)
    starts = np.nonzero(inside)[0]
    if not len(starts):
        return none
    key = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (key[1:] != key[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[starts[1:]] != doc[starts[:-1]])
    lead = np.nonzero(new)[0]
    count = np.diff(np.append(lead, len(starts)))
    begin = starts[lead]
    end = begin + count - 1 + size
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(total + 1, _ODD, np.uint64))
        run = np.concatenate([[np.uint64(0)], np.cumsum(_mix(ids) * power[:total])])
        inverse = np.uint64(pow(_ODD, -1, 1 << 64))
        back = np.cumprod(np.full(total + 1, inverse, np.uint64))
        digest = _mix((run[end] - run[begin]) * back[begin] + count.astype(np.uint64))
    return doc[begin], begin - first[doc[begin]], count, rolled[anchor[begin]], digest


def segment_rows(docs: DataFrame, size: int) -> DataFrame:
    """(row, at, n, anchor, digest) of (row, text): segments of at least one window."""
    kind = docs.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in batches:
            for k, run_ in text_runs(b.column(1)):
                texts = [(t or b"").split() for t in run_]
                sizes = np.array([len(t) for t in texts], np.int64)
                flat = np.fromiter((ids[w] for t in texts for w in t), np.uint64, int(sizes.sum()))
                doc, at, n, anchor, digest = segments(flat, sizes, size)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + k)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64))], names=["row", "at", "n", "anchor", "digest"])
        tidy()

    return docs.mapInArrow(run, f"row {kind}, at int, n int, anchor long, digest long")


def runs_of(starts: list[int]) -> list[dict[str, int]]:
    """Ascending starts as runs of neighbours: first and number."""
    out: list[dict[str, int]] = []
    for i in starts:
        if out and i == out[-1]["at"] + out[-1]["n"]:
            out[-1]["n"] += 1
        else:
            out.append({"at": i, "n": 1})
    return out


#: Roles of a segment in its group: built into the automaton, streamed through it, or both.
BUILT, STREAMED, BOTH = 0, 1, 2


def near(docs: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """docs of (row, text) whose row may be among keys, and the surely others. Texts are shuffled for the former only."""
    keys = keys.select(F.xxhash64(key).alias("h"))
    bloom = bloom_of(keys, keys.count())
    keyed = docs.withColumn("h", F.xxhash64("row"))
    return sift(keyed, "h", bloom).drop("h"), sift(keyed, "h", bloom, inside=False).drop("h")


def repeats(docs: DataFrame, size: int = SIZE, most_in_shard: int = MOST_IN_SHARD, most_in_stream: int = MOST_IN_STREAM) -> DataFrame:
    """(row, at, n): runs of windows (first window, number) of (row, text) whose words also start elsewhere."""
    with short_batches(docs.sparkSession):
        occ = written(segment_rows(docs, size))
    # Equal segments are combined before the shuffle, so a passage that a third of all documents hold is one row per task.
    kinds = occ.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("times"))
    per = kinds.groupBy("anchor").agg(F.sum("times").alias("all_times"), F.count(F.lit(1)).alias("n_kinds")).where("all_times > 1").select(F.col("anchor").alias("p_anchor"), "n_kinds")
    kinds = kinds.join(per, F.col("anchor") == F.col("p_anchor")).select(F.col("anchor").alias("k_anchor"), F.col("digest").alias("k_digest"), "times", "n_kinds")
    # Unique on the kinds' side: AQE splits an anchor that very many rows hold.
    met = written(occ.join(kinds, (F.col("anchor") == F.col("k_anchor")) & (F.col("digest") == F.col("k_digest"))).select("row", "at", "n", "anchor", "digest", "times", "n_kinds"))
    # The words are fetched once per kind, from one text that holds it.
    single = met.where("times = 1").select("anchor", "digest", "times", "n_kinds", F.struct("row", "at", "n").alias("one"))
    more = met.where("times > 1").groupBy("anchor", "digest", "times", "n_kinds").agg(F.min(F.struct("row", "at", "n")).alias("one"))
    asks = single.unionByName(more).select(F.col("one.row").alias("a_row"), F.struct(F.col("one.at").alias("at"), F.col("one.n").alias("n"), "anchor", "digest", "times", "n_kinds").alias("ask"))
    asks = written(asks.groupBy("a_row").agg(F.collect_list("ask").alias("asks")))  # at most one ask per segment of a text
    asked = near(docs, asks, "a_row")[0].join(asks, F.col("row") == F.col("a_row")).select("text", "asks")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for b in batches:
            for first, texts in text_runs(b.column(0)):
                cols: list[list] = [[], [], [], [], []]
                for text, wants in zip(texts, b.column(1).slice(first, len(texts)).to_pylist(), strict=True):
                    words = (text or b"").split()
                    for a in wants:
                        for c, v in zip(cols, (a["anchor"], a["digest"], a["times"], a["n_kinds"], b" ".join(words[a["at"] : a["at"] + a["n"] + size - 1])), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["anchor", "digest", "times", "n_kinds", "words"])

    fetched = asked.mapInArrow(fetch, "anchor long, digest long, times long, n_kinds long, words binary")
    shards, blocks = F.ceil(F.col("n_kinds") / most_in_shard), F.ceil(F.col("n_kinds") / most_in_stream)
    any_hot = bool(met.where(F.col("n_kinds") > most_in_shard).limit(1).count())
    dealt = lambda df, shard, block, role: df.select("anchor", shard.cast("long").alias("shard"), block.cast("long").alias("block"), F.lit(role).alias("role"), "digest", "times", "words")
    if any_hot:  # what several groups read is computed once
        fetched = written(fetched)
    groups = dealt(fetched.where(F.col("n_kinds") <= most_in_shard) if any_hot else fetched, F.lit(0), F.lit(0), BOTH)
    if any_hot:
        hot = fetched.where(F.col("n_kinds") > most_in_shard)
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
        built = dealt(hot.withColumn("__block", every(blocks)), F.pmod("digest", shards), F.col("__block"), BUILT)
        streamed = dealt(hot.withColumn("__shard", every(shards)), F.col("__shard"), F.pmod(F.xxhash64("digest"), blocks), STREAMED)
        groups = groups.unionByName(built).unionByName(streamed)
    groups = groups.repartition("anchor", "shard", "block").sortWithinPartitions("anchor", "shard", "block", "role")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's automaton is built from its first rows; the rows after them are streamed one by one."""
        out: list[list] = [[], [], [], [], []]

        def add(anchor: int, digest: int, words: bytes, shard: SuffixAutomaton, whole: bool) -> None:
            found = shard.matches(words.split(), size)
            if whole:
                runs, found = runs_of([i for i, n in found if n > 1]), []
            else:
                runs = []
            if runs or found:
                for c, v in zip(out, (anchor, digest, runs, [i for i, _ in found], [n for _, n in found]), strict=True):
                    c.append(v)

        def flush() -> pa.RecordBatch:
            run = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
            kinds = (pa.int64(), pa.int64(), run, pa.list_(pa.int32()), pa.list_(pa.int64()))
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["anchor", "digest", "runs", "starts", "counts"])
            for c in out:
                c.clear()
            return batch

        held, rows, shard = None, [], SuffixAutomaton()
        for b in batches:
            for anchor, part, block, role, digest, times, words in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if (anchor, part, block) != held:
                    if rows:
                        shard.close()
                        for d, w in rows:
                            add(held[0], d, w, shard, True)
                    held, rows, shard, closed = (anchor, part, block), [], SuffixAutomaton(), False
                if role != STREAMED:
                    shard.add(words.split(), times)
                if role == BOTH:
                    rows.append((digest, words))
                if role == STREAMED:
                    if not closed:
                        shard.close()
                        closed = True
                    add(anchor, digest, words, shard, False)
            if len(out[0]) > 5_000:
                yield flush()
        if rows:
            shard.close()
            for d, w in rows:
                add(held[0], d, w, shard, True)
        yield flush()

    found = groups.mapInArrow(match, "anchor long, digest long, runs array<struct<at: int, n: int>>, starts array<int>, counts array<long>")
    if any_hot:
        found = written(found)
    parts = found.where(F.size("runs") > 0).select(F.col("anchor").alias("s_anchor"), F.col("digest").alias("s_digest"), "runs")
    if any_hot:  # what the automata of one anchor count is added up
        windows = found.where(F.size("starts") > 0).select("anchor", "digest", F.explode(F.arrays_zip("starts", "counts")).alias("w"))
        windows = windows.groupBy("anchor", "digest", F.col("w.starts").alias("at")).agg(F.sum("w.counts").alias("n")).where("n > 1")
        windows = windows.groupBy(F.col("anchor").alias("s_anchor"), F.col("digest").alias("s_digest")).agg(F.collect_list(F.struct("at", F.lit(1).alias("n"))).alias("runs"))
        parts = parts.unionByName(windows)
    marked = met.join(parts, (F.col("anchor") == F.col("s_anchor")) & (F.col("digest") == F.col("s_digest"))).select("row", "at", F.explode("runs").alias("run"))
    return marked.select("row", (F.col("at") + F.col("run.at")).alias("at"), F.col("run.n").alias("n"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, most_in_shard: int = MOST_IN_SHARD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row per input row.

    Removed is each word covered by a window of size words whose words also start anywhere else, in the same document
    too; windows are judged on the input. kept: the other words, joined by one space. Words are what bytes.split() gives.

    A null text has no words, a text of fewer than size words no window, and nothing is removed from either. Null and
    repeated ids are documents of their own, and so are equal rows: with size words or more they remove each other entirely. Empty tables give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = numbered(rows)
    marks = repeats(rows.select("row", "text"), size, most_in_shard)
    marks = written(marks.groupBy(F.col("row").alias("m_row")).agg(F.collect_list(F.struct("at", "n")).alias("marks")))
    touched, whole = near(rows, marks, "m_row")
    joined = touched.join(marks, F.col("row") == F.col("m_row"), "left").select("doc_id", "text", "marks")
    kind = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marked = b.num_columns > 2
            if marked:
                ends = b.column(2).offsets.to_numpy()
                at, n = (b.column(2).values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for first, texts in text_runs(b.column(1)):  # a run of bounded bytes is a batch of its own
                n_words, n_removed, kept = [], [], []
                for i, t in enumerate(texts, start=first):
                    words = (t or b"").split()
                    gone = 0
                    if marked and ends[i + 1] > ends[i]:
                        edge = np.zeros(len(words) + 1, np.int64)
                        a, k = at[ends[i] : ends[i + 1]], n[ends[i] : ends[i + 1]]
                        np.add.at(edge, a, 1)
                        np.add.at(edge, a + k + size - 1, -1)
                        keep = np.cumsum(edge)[:-1] == 0
                        gone = len(words) - int(keep.sum())
                        words = [words[j] for j in np.nonzero(keep)[0]]
                    n_words.append(len(words) + gone)
                    n_removed.append(gone)
                    kept.append(b" ".join(words))
                text_out = pa.array(kept, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), text_out], names=["doc_id", "n_words", "n_removed", "kept"])

    schema = f"doc_id {kind}, n_words long, n_removed long, kept string"
    return joined.mapInArrow(run, schema).unionByName(whole.select("doc_id", "text").mapInArrow(run, schema))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with a key, row, that is a function of the row: its id where ids are unique, else a digest of id and text.

    Rows of equal id and text then share a key. All their windows repeat anyway, so nothing need tell them apart.
    """
    if rows.schema["doc_id"].dataType.simpleString() == "bigint":
        if not rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null").limit(1).count():
            return rows.withColumn("row", F.col("doc_id"))
    tag = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit("").cast("binary"))))
    return rows.withColumn("row", F.unhex(F.md5(tag.cast("binary"))))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM x) WHERE c > 1),
p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT p.r, p.i, word, coalesce(sum(CASE WHEN m.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS hit
      FROM p LEFT JOIN m ON p.r = m.r AND p.i = m.i),
g AS (SELECT r, count(*) FILTER (hit > 0) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (hit = 0) AS kept FROM k GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.r = g.r
"""
