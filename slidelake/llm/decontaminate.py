"""Operator 3: benchmark decontamination, with DataFrame functions only.

Size-partitioned MinHash containment search. Test items are dealt into size classes, and each class fixes how many of an
item's smallest shingle hashes (its bottom-k sketch) are indexed: an item of n shingles that is contained to a share t
lacks at most n - ceil(t n) of them, so of any n - ceil(t n) + 1 shingles a document must hold at least one. A sketch of
that size, taken for the largest n of the class, therefore finds every document with no miss, and does so with a small
part of the postings. Exact shingle containment then verifies the candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small, table

WIDTH, SHARE, MOST_BROADCAST = 5, 0.8, 200_000


def normal_words(text: Column) -> Column:
    """Words for matching: lower case, runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != F.lit(""))


def positions(words: Column, width: int) -> Column:
    """Start positions (from 0) of the shingles of an array of words; none if it is shorter."""
    n = F.size(words)
    return F.when(n >= width, F.sequence(F.lit(0), n - F.lit(width)))


def shingle_rows(df: DataFrame, keep: list[str], width: int) -> DataFrame:
    """A row per shingle: the hash of its words, and the words' array and position to tell the shingle itself later.

    The array stays a variable of the generated code; a shingle costs a hash of width strings and no string of its own.
    """
    rows = df.select(*keep, "words", F.explode_outer(positions(F.col("words"), width)).alias("at")).where(F.col("at").isNotNull())
    return rows.withColumn("h", F.xxhash64(*[F.element_at("words", F.col("at") + i + 1) for i in range(width)]))


def shingle_text(width: int) -> Column:
    return F.concat_ws(" ", *[F.element_at("words", F.col("at") + i + 1) for i in range(width)])


def item_shingles(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(item_id, shingle, h, n): the distinct shingles of each item, n of them; items of equal id are taken together."""
    words = items.select(F.col(item_id).alias("item_id"), normal_words(F.col(text)).alias("words"))
    rows = shingle_rows(words, ["item_id"], width).select("item_id", "h", shingle_text(width).alias("shingle")).distinct()
    n = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("item_id").alias("n_item"), "n")
    return rows.join(n, F.col("item_id").eqNullSafe(F.col("n_item"))).drop("n_item")


def size_class(n: Column) -> Column:
    """Class c holds the sizes from 2^c to 2^(c+1) - 1."""
    return F.floor(F.log2(n.cast("double")) + F.lit(1e-9)).cast("int")


def sketches(shingles: DataFrame, share: float) -> DataFrame:
    """(item_id, h): the bottom-k sketch of each item, k by its size class; never fewer than its own size demands."""
    from pyspark.sql.window import Window

    top = F.pow(F.lit(2.0), size_class(F.col("n")) + 1) - 1
    k = F.floor(top - F.ceil(top * F.lit(share) - F.lit(1e-9)) + 1)
    ranked = shingles.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle")))
    return ranked.where(F.col("rank") <= k).select("item_id", "h").distinct()


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, share: float = SHARE, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles, containment) of each pair whose containment reaches share.

    containment: share of the item's distinct shingles of width words that the document holds. Items with fewer words
    have no shingle of that width; they are sought with shingles of their own number of words (1 to width - 1), so a
    short item inside a long document is found as a whole run of words. Items without any word are never found.

    Null texts hold no words. Documents with equal ids are taken together, null ids as one. Tables without rows give no
    pairs. Other columns are ignored, whatever their names. The result is at most linear in the documents for a given
    benchmark: a document is paired with each item once.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text"))
    sized = items.withColumn("nw", F.size(normal_words(F.col("item_text"))))
    widths = sorted({min(width, r[0]) for r in sized.where("nw > 0").select(F.least("nw", F.lit(width))).distinct().collect()})  # at most width values
    out = None
    for w in widths:
        own = items if widths == [w] else sized.where((F.least("nw", F.lit(width)) == w) & (F.col("nw") > 0))
        found = _leaks(docs, own, w, share, most_broadcast)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_shared long, n_shingles long, containment double")
    return out


def _leaks(docs: DataFrame, items: DataFrame, width: int, share: float, most_broadcast: int) -> DataFrame:
    shingles = item_shingles(items, "item_id", "item_text", width)
    posts = sketches(shingles, share).select("item_id", F.col("h").alias("p_h"))
    fits = small(posts, most_broadcast)
    hint = F.broadcast if fits else (lambda x: x)  # beyond the checked size: a shuffled join, split by AQE where skewed
    words = docs.select("doc_id", normal_words(F.col("text")).alias("words"))
    hits = shingle_rows(words, ["doc_id"], width).select("doc_id", "h").join(hint(posts), F.col("h") == F.col("p_h"))
    candidates = hits.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_hits"))
    # Verification reads the candidate documents again and counts exact shingles, as text.
    wanted = candidates.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_c")).select(F.col("doc_id").alias("w_id"))
    again = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi").select("doc_id", normal_words(F.col("text")).alias("words"))
    exact = shingles.select("item_id", F.col("shingle").alias("i_shingle"), "n", F.col("h").alias("i_h"))
    rows = shingle_rows(again, ["doc_id"], width)
    if fits and small(exact, 20 * most_broadcast):
        held = rows.join(F.broadcast(exact), F.col("h") == F.col("i_h")).where(shingle_text(width) == F.col("i_shingle"))
    else:  # what is shuffled is the shingle, not its document's words
        rows = rows.select("doc_id", "h", shingle_text(width).alias("d_shingle"))
        held = rows.join(exact, (F.col("h") == F.col("i_h")) & (F.col("d_shingle") == F.col("i_shingle")))
    held = held.groupBy("doc_id", "item_id", "n", "i_shingle").agg(F.count(F.lit(1)).alias("times"))
    shared = held.groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("n_shared"))
    shared = shared.where(F.col("n_shared") >= F.ceil(F.col("n") * F.lit(share) - F.lit(1e-9)))
    pairs = shared.join(candidates.select(F.col("doc_id").alias("c_id"), F.col("item_id").alias("c_item")), F.col("doc_id").eqNullSafe(F.col("c_id")) & F.col("item_id").eqNullSafe(F.col("c_item")), "left_semi")
    return pairs.select("doc_id", "item_id", "n_shared", F.col("n").alias("n_shingles"), (F.col("n_shared") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without the rows that hold a test item; all columns as they are. Rows without id are judged together."""
    bad = cut(leaks(docs, items, **how).select(F.col("doc_id").alias("__leak_id")).distinct())
    bad = F.broadcast(bad) if small(bad, 5 * MOST_BROADCAST) else bad
    key = how.get("doc_id", "doc_id")
    return docs.join(bad, F.col(key).eqNullSafe(F.col("__leak_id")), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
ik AS (SELECT item_id, w, least(5, len(w)) AS k FROM iw WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS sh FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM ik)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS sh
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN s ON ds.sh = s.sh AND ds.k = s.k GROUP BY doc_id, item_id)
SELECT doc_id, m.item_id, n_shared, n AS n_shingles, n_shared / n AS containment
FROM m JOIN n ON m.item_id = n.item_id WHERE n_shared >= ceil(n * 0.8e0 - 1e-9)
"""
