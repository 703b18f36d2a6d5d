"""The engine's queries over the driver's tables, and the SQL that says the same.

The driver ships no images, so its tables stand in: a part is a slide, a lineitem row a pixel of a tile, orders a grid of
tiles, events the timings of versions. The operators are the engine's own; only the relations they run on are stand-ins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import pixels as px
from ..functions import sizing
from ..operators import grid, metrics, tissue, validate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- stand-ins, in both languages ---------------------------------------------------------------------------------


def part_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.expr("cast(2048 + (p_size * 97) % 1500 + p_partkey % 700 as bigint)")
    h = F.expr("cast(1500 + (p_size * 131) % 1800 as bigint)")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), w.alias("w"), h.alias("h"))


SLIDES = "SELECT p_partkey AS slide_id, CAST(2048 + (p_size * 97) % 1500 + p_partkey % 700 AS BIGINT) AS w, CAST(1500 + (p_size * 131) % 1800 AS BIGINT) AS h FROM part"


def line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.expr("cast(l_partkey * 37 % 256 as int)"), F.expr("cast(l_suppkey * 53 % 256 as int)"), F.expr("cast((l_orderkey * 7 + l_linenumber * 91) % 256 as int)")
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", r.alias("r"), g.alias("g"), b.alias("b"))
    return df.withColumn("gray", px.luma(F.col("r"), F.col("g"), F.col("b"))).withColumnRenamed("l_orderkey", "tile_id")


PIXELS = """SELECT l_orderkey AS tile_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice, r, g, b, (r * 19595 + g * 38470 + b * 7471 + 32768) >> 16 AS gray
FROM (SELECT *, CAST(l_partkey * 37 % 256 AS INT) AS r, CAST(l_suppkey * 53 % 256 AS INT) AS g, CAST((l_orderkey * 7 + l_linenumber * 91) % 256 AS INT) AS b FROM lineitem)"""


def long_counts(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def kept_tiles(pixels: DataFrame, white: int, reject: float = 0.5) -> DataFrame:
    c = tissue.tile_counts(pixels, ["tile_id"], white=white, black=100)
    return c.where(px.keeps(F.col("white"), F.col("black"), F.col("n"), reject)).select("tile_id")


def kept_sql(white: int) -> str:
    return f"(SELECT tile_id FROM p GROUP BY tile_id HAVING count(*) FILTER (gray > {white}) / count(*) < 0.5e0 AND count(*) FILTER (gray < 100) / count(*) < 0.5e0)"


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("version"), F.to_date("ts").cast("string").alias("d"), F.col("value").alias("t"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- generators, projections, filters -----------------------------------------------------------------------------


@query(f"""SELECT slide_id, x, y FROM ({SLIDES}) s, LATERAL (SELECT unnest(range(0, h - 1024 + 1, 512)) AS y), LATERAL (SELECT unnest(range(0, w - 1024 + 1, 512)) AS x)
WHERE h >= 1024 AND w >= 1024""")
def candidate_grid(spark, sf_dir):
    return grid.candidates(part_slides(spark, sf_dir), 1024, 512).select("slide_id", "x", "y")


@query(f"""SELECT slide_id, CAST(stride AS BIGINT) AS stride, CAST(len(range(0, h - 1024 + 1, stride)) * len(range(0, w - 1024 + 1, stride)) AS BIGINT) AS n
FROM ({SLIDES}) s, (VALUES (256), (512), (1024)) v(stride)""")
def candidate_count_by_stride(spark, sf_dir):
    strides = F.explode(F.array(*[F.lit(s).cast("long") for s in (256, 512, 1024)]))
    out = part_slides(spark, sf_dir).withColumn("stride", strides)
    return out.select("slide_id", "stride", grid.candidate_count(F.col("w"), F.col("h"), 1024, F.col("stride")).alias("n"))


@query(f"SELECT CAST(gray AS BIGINT) AS gray, count(*) AS n FROM ({PIXELS}) GROUP BY gray")
def luma_histogram(spark, sf_dir):
    return line_pixels(spark, sf_dir).groupBy(F.col("gray").cast("long").alias("gray")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT tile_id, count(*) FILTER (gray > 150) AS white, count(*) FILTER (gray < 100) AS black, count(*) AS n FROM ({PIXELS}) GROUP BY tile_id")
def tile_counts(spark, sf_dir):
    return tissue.tile_counts(line_pixels(spark, sf_dir), ["tile_id"], white=150, black=100)


@query(f"""WITH tc AS (SELECT tile_id, count(*) FILTER (gray > 150) AS white, count(*) FILTER (gray < 100) AS black, count(*) AS n FROM ({PIXELS}) GROUP BY tile_id)
SELECT px, py, CAST(sum(coalesce(white, 0)) AS BIGINT) AS white, CAST(sum(coalesce(black, 4)) AS BIGINT) AS black, CAST(sum(coalesce(n, 4)) AS BIGINT) AS total
FROM (SELECT o_orderkey, (o_orderkey % 128) // 2 AS px, (o_orderkey // 128) // 2 AS py FROM orders) o LEFT JOIN tc ON o_orderkey = tile_id GROUP BY px, py""")
def patch_rollup_empty_black(spark, sf_dir):
    cover = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tile_id"), F.expr("(o_orderkey % 128) div 2").alias("px"), F.expr("(o_orderkey div 128) div 2").alias("py"))
    counts = tissue.tile_counts(line_pixels(spark, sf_dir), ["tile_id"], white=150, black=100)
    return tissue.rollup(cover, counts, ["tile_id"], ["px", "py"], 4)


@query("""SELECT vec_id, CAST(len(list_filter(g, lambda v: v > 150)) AS BIGINT) AS white, CAST(len(list_filter(g, lambda v: v < 100)) AS BIGINT) AS black
FROM (SELECT vec_id, list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 200 + 128)) AS g FROM embeddings)""")
def embedding_pixels_hof(spark, sf_dir):
    g = F.transform("embedding", lambda v: F.floor(v.cast("double") * 200 + 128))
    df = table(spark, sf_dir, "embeddings").select("vec_id", g.alias("g"))
    n = lambda c: F.size(c).cast("long")
    return df.select("vec_id", n(F.filter("g", lambda v: px.is_white(v, 150))).alias("white"), n(F.filter("g", lambda v: px.is_black(v, 100))).alias("black"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: (CAST(v AS DOUBLE) - 0.485e0) / 0.229e0)), 3) AS total FROM embeddings")
def normalize_channel(spark, sf_dir):
    values = F.transform("embedding", lambda v: px.normalise(v.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


@query("SELECT o_orderkey, CAST(least(greatest(floor(o_totalprice * 1e5 * 0.35e0 / 884736), 64), 8192) AS BIGINT) AS batch FROM orders")
def auto_batch_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sizing.auto_batch(F.col("o_totalprice") * F.lit(1e5)).alias("batch"))


@query("SELECT o_orderkey, CAST(greatest(floor(floor(o_totalprice / 1e5 * 1e9) / 884736), 32) AS BIGINT) AS batch FROM orders")
def budget_batch_size(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", sizing.budget_batch(F.col("o_totalprice") / F.lit(1e5)).alias("batch"))


@query("""SELECT p_partkey, coalesce(CAST(nullif(regexp_extract(v, '^v(\\d+)(\\w*)', 1), '') AS BIGINT), 999999999) AS num, CASE WHEN nullif(regexp_extract(v, '^v(\\d+)(\\w*)', 1), '') IS NULL THEN v ELSE regexp_extract(v, '^v(\\d+)(\\w*)', 2) END AS suffix
FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE 'v' || p_size || '_' || lower(p_brand) END AS v FROM part)""".replace("\\\\", "\\"))
def natural_version_key(spark, sf_dir):
    v = F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("v"), F.col("p_size"), F.lit("_"), F.lower("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(sizing.version_number(v), F.lit(999999999)).alias("num"), sizing.version_suffix(v).alias("suffix"))


@query("""SELECT * FROM (VALUES (943718, 1048576, true), (943719, 1048576, false), (368639, 409600, true), (368640, 409600, false), (0, 0, false)) v(white, total, kept)""")
def ratio_edges(spark, sf_dir):
    rows = spark.createDataFrame([(943718, 1048576), (943719, 1048576), (368639, 409600), (368640, 409600), (0, 0)], "white int, total int")
    return rows.withColumn("kept", px.keeps(F.col("white"), F.lit(0), F.col("total")))


@query(f"SELECT slide_id, least(i * 1024, w - 1024) AS x, least(i * 1024, h - 1024) AS y FROM ({SLIDES}) s, range(4) r(i)")
def diagonal_sample(spark, sf_dir):
    return grid.diagonal(part_slides(spark, sf_dir), 1024, 4).select("slide_id", "x", "y")


@query(f"SELECT slide_id, CAST(floor((w - 1024) / 2) AS BIGINT) AS x, CAST(floor((h - 1024) / 2) AS BIGINT) AS y FROM ({SLIDES}) s")
def centre_sample(spark, sf_dir):
    return grid.centre(part_slides(spark, sf_dir), 1024).select("slide_id", "x", "y")


@query(f"""SELECT slide_id, CAST(floor((w - 1024) * ix / 3e0) AS BIGINT) AS x, CAST(floor((h - 1024) * iy / 3e0) AS BIGINT) AS y
FROM ({SLIDES}) s, range(4) a(iy), range(4) b(ix) WHERE w >= 1024 AND h >= 1024 AND iy * 4 + ix < 16""")
def sampling_grid(spark, sf_dir):
    return grid.sampling_grid(part_slides(spark, sf_dir), 1024, 16).select("slide_id", "x", "y")


@query("SELECT p_partkey, coalesce(nullif(concat_ws(', ', CASE WHEN p_size % 3 > 0 THEN 'read ' || printf('%.2f', p_size % 3 + 0e0) END, CASE WHEN p_size % 5 > 0 THEN 'decode ' || printf('%.2f', p_size % 5 + 0e0) END), ''), '-') AS stages FROM part")
def stage_string(spark, sf_dir):
    part = lambda m: (F.col("p_size") % m).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", sizing.stage_text({"read": part(3), "decode": part(5)}).alias("stages"))


@query("SELECT p_partkey, round(2 * (p_partkey * 1000e0) * 1000e0 * (p_size * 8) / 8 / 1e9, 6) AS gbs, round(2 * p_size * 128 * (p_partkey * 100e0) * 1000e0 / 1e12, 6) AS tflops FROM part")
def device_limits(spark, sf_dir):
    k, s = F.col("p_partkey").cast("double"), F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sizing.bandwidth_gbs(k * 1000, s * 8), 6).alias("gbs"), F.round(sizing.tera_flops(s, F.lit(128), k * 100), 6).alias("tflops"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages")
def base_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", sizing.base_name(F.col("url")).alias("name"))


# --- flagship -----------------------------------------------------------------------------------------------------


def flagship_counts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    dims = part_slides(spark, sf_dir).withColumn("ntx", F.expr("w div 512")).withColumn("nty", F.expr("h div 512"))
    rows = line_pixels(spark, sf_dir).join(dims, F.col("l_partkey") == F.col("slide_id"))
    tile = F.expr("(tile_id % nty) * ntx + (l_suppkey * 7 + l_linenumber) % ntx")
    counts = tissue.tile_counts(rows.select("slide_id", tile.alias("tile_id"), "gray"), ["slide_id", "tile_id"], white=150, black=100)
    return dims, counts


FLAGSHIP = f"""WITH dims AS (SELECT *, w // 512 AS ntx, h // 512 AS nty FROM ({SLIDES})),
p AS (SELECT slide_id, (tile_id % nty) * ntx + (l_suppkey * 7 + l_linenumber) % ntx AS tile_id, gray FROM ({PIXELS}) JOIN dims ON l_partkey = slide_id),
tc AS (SELECT slide_id, tile_id, count(*) FILTER (gray > 150) AS white, count(*) FILTER (gray < 100) AS black, count(*) AS n FROM p GROUP BY slide_id, tile_id),
cand AS (SELECT * FROM dims, LATERAL (SELECT unnest(range(0, h - 1024 + 1, 512)) AS y), LATERAL (SELECT unnest(range(0, w - 1024 + 1, 512)) AS x) WHERE h >= 1024 AND w >= 1024),
cov AS (SELECT slide_id, x, y, (y // 512 + d // 2) * ntx + x // 512 + d % 2 AS tile_id FROM cand, range(4) r(d)),
s AS (SELECT c.slide_id, c.x, c.y, CAST(sum(coalesce(white, 0)) AS BIGINT) AS white, CAST(sum(coalesce(black, 1)) AS BIGINT) AS black, CAST(sum(coalesce(n, 1)) AS BIGINT) AS total
      FROM cov c LEFT JOIN tc ON c.slide_id = tc.slide_id AND c.tile_id = tc.tile_id GROUP BY c.slide_id, c.x, c.y)
"""


@query(FLAGSHIP + "SELECT * FROM s WHERE white / total < 0.5e0 AND black / total < 0.5e0")
def tissue_filter(spark, sf_dir):
    """The grid cells of each slide that hold tissue: grid, cover, counts per tile, rollup, shares."""
    dims, counts = flagship_counts(spark, sf_dir)
    return tissue.tissue_patches(dims, counts, 1024, 512, 512, empty_pixels=1, reject=0.5)


def hundredths_sql(count: str) -> str:
    """The share of total in hundredths, rounded half up by integers: engines print doubles between two hundredths differently."""
    h = f"((200 * {count} + total) // (2 * total))"
    return f"printf('%d.%02d', CAST({h} // 100 AS BIGINT), CAST({h} % 100 AS BIGINT))"


@query(FLAGSHIP + f"""SELECT slide_id, x, y, CASE WHEN white / total >= 0.5e0 THEN 'discarded (reason: white_ratio ' || {hundredths_sql('white')} || ' >= 0.5)'
WHEN black / total >= 0.5e0 THEN 'discarded (reason: black_ratio ' || {hundredths_sql('black')} || ' >= 0.5)'
ELSE 'selected (white: ' || {hundredths_sql('white')} || ', black: ' || {hundredths_sql('black')} || ')' END AS status FROM s""")
def decision_log(spark, sf_dir):
    """The decision on every patch."""
    dims, counts = flagship_counts(spark, sf_dir)
    cover = grid.tile_cover(grid.candidates(dims, 1024, 512), 1024, 512, 512, "ntx").select("slide_id", "x", "y", "tile_id")
    sums = tissue.rollup(cover, counts, ["slide_id", "tile_id"], ["slide_id", "x", "y"], 1)
    return tissue.decisions(sums, 0.5).select("slide_id", "x", "y", "status")


@query(FLAGSHIP + ", n AS (SELECT slide_id, tile_id, x, y FROM cov) SELECT slide_id, tile_id, count(*) AS n_patches, min(y) AS first_y, min(x) AS first_x FROM n GROUP BY slide_id, tile_id")
def tiles_to_patches(spark, sf_dir):
    dims, _ = flagship_counts(spark, sf_dir)
    cover = grid.tile_cover(grid.candidates(dims, 1024, 512), 1024, 512, 512, "ntx")
    return tissue.tile_use(cover, ["slide_id", "tile_id"])


# --- validation ---------------------------------------------------------------------------------------------------


def two_kept(spark, sf_dir, a: int, b: int) -> tuple[DataFrame, DataFrame]:
    p = line_pixels(spark, sf_dir)
    return kept_tiles(p, a), kept_tiles(p, b)


def compare_sql(a: int, b: int, columns: str) -> str:
    return f"""WITH p AS ({PIXELS}), a AS {kept_sql(a)}, b AS {kept_sql(b)},
c AS (SELECT (SELECT count(*) FROM a) AS n_base, (SELECT count(*) FROM b) AS n_test, (SELECT count(*) FROM a JOIN b USING (tile_id)) AS n_agree),
d AS (SELECT *, n_base - n_agree AS n_missing, n_test - n_agree AS n_extra FROM c),
e AS (SELECT *, coalesce(n_agree / nullif(n_agree + n_missing + n_extra, 0), 1e0) AS jaccard, coalesce(n_agree / nullif(n_test, 0), 1e0) AS precision, coalesce(n_agree / nullif(n_base, 0), 1e0) AS recall FROM d)
SELECT {columns} FROM e"""


@query(compare_sql(150, 140, "n_base, n_test, n_agree, n_missing, n_extra, round(jaccard, 6) AS jaccard, n_missing = 0 AND n_extra = 0 AS passed"))
def validate_kept_sets(spark, sf_dir):
    a, b = two_kept(spark, sf_dir, 150, 140)
    return validate.compare_sets(a, b, ["tile_id"]).select("n_base", "n_test", "n_agree", "n_missing", "n_extra", F.round("jaccard", 6).alias("jaccard"), "passed")


@query(compare_sql(140, 150, "round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0e0), 6) AS f1"))
def precision_recall_f1(spark, sf_dir):
    a, b = two_kept(spark, sf_dir, 140, 150)
    return validate.compare_sets(a, b, ["tile_id"]).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH p AS ({PIXELS}), a AS {kept_sql(200)}, b AS {kept_sql(150)},
x AS (SELECT 'missing' AS side, tile_id FROM a ANTI JOIN b USING (tile_id) UNION ALL SELECT 'extra', tile_id FROM b ANTI JOIN a USING (tile_id))
SELECT side, rank, tile_id FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY tile_id) AS rank FROM x) WHERE rank <= 10""")
def missing_extra_top10(spark, sf_dir):
    a, b = two_kept(spark, sf_dir, 200, 150)
    return validate.first_differences(a, b, ["tile_id"]).select("side", "rank", "tile_id")


@query(f"""WITH p AS ({PIXELS}), a AS {kept_sql(150)}, b AS {kept_sql(140)}
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS n_both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS n_either,
(SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS n_only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS n_only_b""")
def set_algebra(spark, sf_dir):
    a, b = two_kept(spark, sf_dir, 150, 140)
    parts = {"n_both": a.intersect(b), "n_either": a.union(b).distinct(), "n_only_a": a.subtract(b), "n_only_b": b.subtract(a)}
    tagged = [df.select(F.lit(name).alias("part")) for name, df in parts.items()]
    rows = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])
    return rows.agg(*[F.count_if(F.col("part") == n).alias(n) for n in parts])


@query(f"""SELECT max(d) AS max_error, round(avg(d), 6) AS mean_error, round(sqrt(sum(d * d)), 3) AS l2_error, round(avg(CASE WHEN d <= 1 THEN 1e0 ELSE 0e0 END), 6) AS match_rate, bool_and(d = 0) AS exact
FROM (SELECT abs(gray - floor((r + g + b) / 3e0)) AS d FROM ({PIXELS}))""")
def gray_error_stats(spark, sf_dir):
    """Integer luma against the mean of the channels."""
    df = line_pixels(spark, sf_dir).withColumn("mean", F.floor((F.col("r") + F.col("g") + F.col("b")) / 3.0))
    e = validate.array_errors(df, "gray", "mean", 1.0)
    return e.select("max_error", F.round("mean_error", 6).alias("mean_error"), F.round("l2_error", 3).alias("l2_error"), F.round("match_rate", 6).alias("match_rate"), "exact")


@query(f"""WITH a AS (SELECT tile_id, row_number() OVER (ORDER BY tile_id) AS k FROM (SELECT DISTINCT tile_id FROM ({PIXELS}))),
b AS (SELECT tile_id, row_number() OVER (ORDER BY tile_id DESC) AS k FROM (SELECT DISTINCT tile_id FROM ({PIXELS})))
SELECT coalesce(bool_and(a.tile_id IS NOT DISTINCT FROM b.tile_id), true) AS identical_order FROM a FULL JOIN b USING (k)""")
def identical_order(spark, sf_dir):
    t = line_pixels(spark, sf_dir).select("tile_id").distinct()
    return validate.identical_order(t, t, ["tile_id"], F.col("tile_id"), -F.col("tile_id"))


# --- windows ------------------------------------------------------------------------------------------------------


@query(f"""WITH p AS ({PIXELS}), a AS {kept_sql(150)}
SELECT tile_id, tile_id % 100 AS slide_id, row_number() OVER (PARTITION BY tile_id % 100 ORDER BY tile_id // 1000, tile_id // 100) - 1 AS idx FROM a""")
def kept_index(spark, sf_dir):
    k = kept_tiles(line_pixels(spark, sf_dir), 150).select("tile_id", (F.col("tile_id") % 100).alias("slide_id"), F.expr("tile_id div 1000").alias("y"), F.expr("tile_id div 100").alias("x"))
    return grid.kept_index(k).select("tile_id", "slide_id", "idx")


@query("""SELECT slot, chunk, o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 2048 AS chunk,
((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 2048) % 2 AS slot FROM orders) GROUP BY slot, chunk, o_orderstatus""")
def batch_slots(spark, sf_dir):
    out = grid.batch_slots(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderkey", 2048, 2)
    return out.groupBy("slot", "chunk", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_partkey, dense_rank() OVER (ORDER BY first_at) - 1 AS compact FROM (SELECT l_partkey, min(l_orderkey * 8 + l_linenumber) * 1000000 + min(l_partkey) AS first_at FROM lineitem GROUP BY l_partkey)""")
def tile_dedupe_first_seen(spark, sf_dir):
    firsts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg((F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.min("l_partkey")).alias("at"))
    return grid.first_seen(firsts, "l_partkey", F.col("at")).select("l_partkey", "compact")


@query("""SELECT doc_id, CAST(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id) - octet_length(encode(text)) AS BIGINT) AS at FROM documents""")
def blob_offsets(spark, sf_dir):
    """Where each text of a source begins if they lie end to end: prefix sums that no source's size can overload."""
    return grid.prefix_sums(table(spark, sf_dir, "documents"), "doc_id", ["source"], F.octet_length("text").cast("long"), name="at").select("doc_id", "at")


@query("""SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 128 AS BIGINT) AS batch FROM orders
QUALIFY row_number() OVER (ORDER BY o_orderkey) <= 128 * least(5, (SELECT (count(*) + 127) // 128 - 1 FROM orders))""")
def first_batches(spark, sf_dir):
    """The first five batches: a top-k, not a sort of all rows."""
    out = grid.first_batches(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 128)
    return grid.prefix_sums(out, "o_orderkey", name="place").select("o_orderkey", F.floor(F.col("place") / 128).cast("long").alias("batch"))


@query(f"""SELECT tile_id, l_linenumber, l_partkey, l_extendedprice, CAST(sum(r - 128) OVER (PARTITION BY tile_id ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dc FROM ({PIXELS})""")
def dc_prediction(spark, sf_dir):
    w = Window.partitionBy("tile_id").orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return line_pixels(spark, sf_dir).select("tile_id", "l_linenumber", "l_partkey", "l_extendedprice", F.sum(F.col("r") - 128).over(w).alias("dc"))


# --- timings ------------------------------------------------------------------------------------------------------

TIMINGS = "SELECT event_type AS version, strftime(ts, '%Y-%m-%d') AS d, value AS t FROM events"


@query(f"SELECT version, min(t) AS min_t, round(avg(t), 6) AS mean_t, round(stddev_pop(t), 6) AS std_t, max(t) AS max_t, count(t) AS n FROM ({TIMINGS}) GROUP BY version")
def perf_metrics(spark, sf_dir):
    return metrics.summary(timings(spark, sf_dir), ["version"], "t").select("version", "min_t", F.round("mean_t", 6).alias("mean_t"), F.round("std_t", 6).alias("std_t"), "max_t", "n")


BEST = "min(CASE WHEN t > 0 THEN t END)"


@query(f"""WITH b AS (SELECT d, version, {BEST} AS min_t FROM ({TIMINGS}) GROUP BY d, version)
SELECT d, version, min_t, round(max(CASE WHEN version = 'click' THEN min_t END) OVER (PARTITION BY d) / nullif(min_t, 0), 6) AS speedup, row_number() OVER (PARTITION BY d ORDER BY min_t, version) AS rank FROM b WHERE min_t IS NOT NULL""")
def speedup_vs_baseline(spark, sf_dir):
    best = metrics.best(timings(spark, sf_dir), ["d", "version"], "t").where("min_t is not null").drop("n")
    return metrics.speedups(best, "click", within=["d"]).select("d", "version", "min_t", F.round("speedup", 6).alias("speedup"), "rank")


@query(f"SELECT version, count(t) AS n, round(coalesce(count(t) / nullif({BEST}, 0), 0), 6) AS rate FROM ({TIMINGS}) GROUP BY version")
def throughput(spark, sf_dir):
    """Candidates by the least time; 0 without times."""
    out = metrics.best(timings(spark, sf_dir), ["version"], "t")
    return out.select("version", "n", F.round(metrics.throughput(F.col("n"), F.col("min_t")), 6).alias("rate"))


#: A stand-in for a kernel's part of a time: a share that differs from event to event.
KERNEL = "t * (1 + user_id % 7) / 10"


@query(f"""SELECT version, total, kernel, round(total - kernel, 6) AS overhead, round(100 * kernel / total, 6) AS kernel_pct
FROM (SELECT version, {BEST} AS total, round(min(CASE WHEN t > 0 THEN {KERNEL} END), 9) AS kernel FROM (SELECT event_type AS version, value AS t, user_id FROM events) GROUP BY version)""")
def kernel_share(spark, sf_dir):
    """Overhead: the least total less the least kernel time."""
    times = table(spark, sf_dir, "events").select(F.col("event_type").alias("version"), F.col("value").alias("t"), "user_id").where("t > 0")
    out = times.groupBy("version").agg(F.min("t").alias("total"), F.round(F.min(F.expr(KERNEL)), 9).alias("kernel"))
    out = metrics.kernel_share(out, "total", "kernel")
    return out.select("version", "total", "kernel", F.round("overhead", 6).alias("overhead"), F.round("kernel_pct", 6).alias("kernel_pct"))


@query("SELECT version, min_t, arg_min(event_id, (t, event_id)) AS best_id FROM (SELECT event_type AS version, value AS t, event_id, min(value) OVER (PARTITION BY event_type) AS min_t FROM events WHERE value > 0) GROUP BY version, min_t")
def best_of_n(spark, sf_dir):
    """The repetition with the least positive time of each version; of equal ones the first."""
    rows = table(spark, sf_dir, "events").where("value > 0").groupBy(F.col("event_type").alias("version")).agg(F.min(F.struct("value", "event_id")).alias("best"))
    return rows.select("version", F.col("best.value").alias("min_t"), F.col("best.event_id").alias("best_id"))


@query(f"""WITH b AS (SELECT version, d, greatest(max(t), max(u)) AS peak FROM (SELECT event_type AS version, strftime(ts, '%Y-%m-%d') AS d, value AS t, user_id / 8e0 AS u FROM events) GROUP BY version, d)
SELECT version, d, peak, max(peak) OVER (PARTITION BY version ORDER BY d) AS running_peak FROM b""")
def running_peak(spark, sf_dir):
    """The largest of two sampled attributes so far, day by day."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("version"), F.to_date("ts").cast("string").alias("d"), F.col("value").alias("t"), (F.col("user_id") / F.lit(8.0)).alias("u"))
    return metrics.running_peak(rows, ["version"], "d", ["t", "u"])


STAGES = {"click": "read", "view": "decode", "purchase": "transfer"}


@query(f"""SELECT d, {", ".join(f"round(coalesce(sum(CASE WHEN s = '{s}' THEN t END), 0e0), 4) AS {s}" for s in [*STAGES.values(), "compute"])}
FROM (SELECT d, t, CASE version {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGES.items())} ELSE 'compute' END AS s FROM ({TIMINGS})) GROUP BY d""")
def stage_time_sums(spark, sf_dir):
    """Seconds by stage and day."""
    stage = F.coalesce(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])[F.col("version")], F.lit("compute"))
    names = [*STAGES.values(), "compute"]
    return metrics.stage_sums(timings(spark, sf_dir), ["d"], stage, "t", names).select("d", *[F.round(c, 4).alias(c) for c in names])


SECTION_ROWS = [("cpu", 1, "click"), ("cpu", 1, "view"), ("gpu", 2, "purchase"), ("gpu", 2, "signup"), ("decode", 3, "error"), ("decode", 3, "logout"), ("decode", 3, "absent")]


@query(f"""WITH s AS (SELECT * FROM (VALUES {", ".join(map(str, SECTION_ROWS))}) v(section, ord, version)),
p AS (SELECT section, ord, count(*) AS n FROM (SELECT DISTINCT version FROM ({TIMINGS})) JOIN s USING (version) GROUP BY section, ord)
SELECT section, CAST(ord AS BIGINT) AS ord, n, CAST(coalesce(sum(n) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS boundary FROM p""")
def section_boundaries(spark, sf_dir):
    return metrics.section_boundaries(timings(spark, sf_dir), spark.createDataFrame(SECTION_ROWS, "section string, ord long, version string"))


@query(f"""WITH b AS (SELECT version, {BEST} AS v FROM ({TIMINGS}) GROUP BY version)
SELECT version, round(v - first_value(v) OVER (ORDER BY version), 6) AS vs_first, round(v - lag(v) OVER (ORDER BY version), 6) AS vs_previous FROM b""")
def ablation_steps(spark, sf_dir):
    out = metrics.adjacent(metrics.best(timings(spark, sf_dir), ["version"], "t", "v"), "version", "v")
    return out.select("version", F.round("vs_first", 6).alias("vs_first"), F.round("vs_previous", 6).alias("vs_previous"))


@query(f"SELECT round(sum(CASE WHEN version IN ('click', 'view') THEN t ELSE 0 END) / sum(t), 6) AS load_fraction FROM ({TIMINGS})")
def data_load_fraction(spark, sf_dir):
    is_load = F.col("version").isin("click", "view")
    out = metrics.load_fraction(timings(spark, sf_dir), F.when(is_load, F.col("t")).otherwise(0.0), F.when(~is_load, F.col("t")).otherwise(0.0))
    return out.select(F.round("load_fraction", 6).alias("load_fraction"))


@query(f"""SELECT round(max(CASE WHEN version = 'click' THEN r END), 6) AS single, round(max(CASE WHEN version <> 'click' THEN r END), 6) AS best,
max(CASE WHEN version <> 'click' THEN r END) > 1.5e0 * max(CASE WHEN version = 'click' THEN r END) AS scales FROM (SELECT version, avg(t) AS r FROM ({TIMINGS}) GROUP BY version)""")
def threads_scale(spark, sf_dir):
    rates = timings(spark, sf_dir).groupBy("version").agg(F.avg("t").alias("rate")).withColumn("mode", F.when(F.col("version") == "click", "single").otherwise(F.col("version")))
    return metrics.threads_scale(rates).select(F.round("single", 6).alias("single"), F.round("best", 6).alias("best"), "scales")


@query(f"""WITH p AS (SELECT o_custkey, tile_id, gray FROM ({PIXELS}) JOIN orders ON tile_id = o_orderkey),
z AS (SELECT o_custkey, count(DISTINCT tile_id) AS tiles FROM p GROUP BY o_custkey)
SELECT CASE WHEN tiles >= 16 THEN 'batch' ELSE 'rows' END AS route, count(DISTINCT p.o_custkey) AS groups, count(DISTINCT tile_id) AS tiles, count(*) FILTER (gray > 150) AS white, count(*) FILTER (gray < 100) AS black, count(*) AS n
FROM p JOIN z ON p.o_custkey = z.o_custkey GROUP BY 1""")
def hybrid_routing(spark, sf_dir):
    """Groups of 16 tiles or more are counted in Arrow batches, the others by the relational aggregate: one answer, two routes."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = line_pixels(spark, sf_dir).select("tile_id", "gray").join(orders, F.col("tile_id") == F.col("o_orderkey"))
    out = tissue.routed_counts(rows, "o_custkey", ["tile_id"], 16, white=150, black=100)
    per = out.groupBy("route", "o_custkey").agg(F.count(F.lit(1)).alias("tiles"), *[F.sum(c).alias(c) for c in ("white", "black", "n")])
    return per.groupBy("route").agg(F.count(F.lit(1)).alias("groups"), *[F.sum(c).alias(c) for c in ("tiles", "white", "black", "n")])


@query(f"""WITH a AS (SELECT tile_id, tile_id % 50 AS part FROM ({PIXELS}) GROUP BY tile_id HAVING count(*) FILTER (gray > 150) / count(*) < 0.5e0 AND count(*) FILTER (gray < 100) / count(*) < 0.5e0),
b AS (SELECT tile_id FROM ({PIXELS}) GROUP BY tile_id HAVING count(*) FILTER (gray > 145) / count(*) < 0.5e0 AND count(*) FILTER (gray < 100) / count(*) < 0.5e0)
SELECT part, count(*) AS n, count(*) FILTER (b.tile_id IS NULL) AS n_failed, bool_and(b.tile_id IS NOT NULL) AS passed FROM a LEFT JOIN b ON a.tile_id = b.tile_id GROUP BY part""")
def all_pass(spark, sf_dir):
    """Whether every kept tile of a part is kept under another threshold too."""
    a, b = two_kept(spark, sf_dir, 150, 145)
    b = b.select(F.col("tile_id").alias("other"))
    checks = a.join(b, F.col("tile_id") == F.col("other"), "left").select((F.col("tile_id") % 50).alias("part"), F.col("other").isNotNull().alias("passed"))
    return validate.all_pass(checks, ["part"])


def _plane(spark, sf_dir) -> tuple[DataFrame, Column]:
    p = line_pixels(spark, sf_dir)
    y, cb, cr = (F.col(c).cast("double") for c in ("r", "g", "b"))
    return p, px.luma(*px.rgb_of_ycc(y, cb, cr))


@query(f"""WITH c AS (SELECT r AS y, least(255, greatest(0, floor(r + 1.402e0 * (b - 128) + 0.5e0))) AS r2, least(255, greatest(0, floor(r - 0.344136e0 * (g - 128) - 0.714136e0 * (b - 128) + 0.5e0))) AS g2,
least(255, greatest(0, floor(r + 1.772e0 * (g - 128) + 0.5e0))) AS b2 FROM ({PIXELS})),
l AS (SELECT y, (CAST(r2 AS INT) * 19595 + CAST(g2 AS INT) * 38470 + CAST(b2 AS INT) * 7471 + 32768) >> 16 AS gray FROM c)
SELECT count(*) FILTER ((y > 230) <> (gray > 230)) AS white_flips, count(*) FILTER ((y < 25) <> (gray < 25)) AS black_flips, count(*) AS n FROM l""")
def y_plane_vs_luma(spark, sf_dir):
    """Pixels whose white or black verdict changes if the luma plane is thresholded in place of luma of clamped RGB."""
    p, gray = _plane(spark, sf_dir)
    flips = lambda f: F.count_if(f(F.col("r")) != f(gray))
    return p.agg(flips(px.is_white).alias("white_flips"), flips(px.is_black).alias("black_flips"), F.count(F.lit(1)).alias("n"))


@query(None)
def fp16_luma_flip(spark, sf_dir):
    """Verdicts that half precision changes; half floats are not in SQL."""
    h = px.luma_half()(F.col("r"), F.col("g"), F.col("b"))
    p = line_pixels(spark, sf_dir).select("gray", h.alias("h"))
    return p.agg(F.max(F.abs(F.col("h.half") - F.col("gray"))).alias("max_error"), F.count_if((F.col("h.half") > 230) != (F.col("gray") > 230)).alias("white_flips"), F.count_if((F.col("h.half") < 25) != (F.col("gray") < 25)).alias("black_flips"), F.count_if(F.col("h.rounded") != F.col("gray")).alias("rounded_differs"))


@query(f"""WITH b AS (SELECT version, {BEST} AS m, avg(t) AS a FROM ({TIMINGS}) GROUP BY version),
r AS (SELECT version, CAST(round(m * 1000) AS BIGINT) AS mi, CAST(round(a * 1000) AS BIGINT) AS ai, CAST(round(max(CASE WHEN version = 'click' THEN m END) OVER () / m * 100) AS BIGINT) AS si FROM b)
SELECT version, concat_ws(' | ', version, printf('%d.%03d', mi // 1000, mi % 1000), printf('%d.%03d', ai // 1000, ai % 1000), coalesce(printf('%d.%02dx', si // 100, si % 100), '-')) AS line FROM r""")
def markdown_report(spark, sf_dir):
    """A line per version: least and mean time, speedup over the base version; rounded to what is printed first."""
    t = timings(spark, sf_dir)
    out = metrics.best(t, ["version"], "t").drop("n").join(t.groupBy(F.col("version").alias("m_version")).agg(F.avg("t").alias("mean_t")), F.col("version") == F.col("m_version"))
    out = metrics.speedups(out, "click")
    return metrics.markdown_rows(out.select("version", F.round("min_t", 3).alias("min_t"), F.round("mean_t", 3).alias("mean_t"), F.round("speedup", 2).alias("speedup")))


@query(f"""SELECT d, version, count(t) AS n_times, round(min(t), 6) AS least, round(max(t), 6) AS longest, round(sum(t), 4) AS total, count(t) AS n_candidates, max(t) AS peak FROM ({TIMINGS}) GROUP BY d, version""")
def benchmark_json_roundtrip(spark, sf_dir):
    """A benchmark document per day (meta, results by version) written as JSON text, read back and exploded.

    A document holds the times of one run, so no row grows with the table."""
    per = timings(spark, sf_dir).groupBy("d", "version").agg(F.sort_array(F.collect_list("t")).alias("times"), F.count("t").alias("n"))
    stats = F.struct(F.array_min("times").alias("min"), (F.aggregate("times", F.lit(0.0), lambda a, x: a + x) / F.size("times")).alias("mean"), F.array_max("times").alias("max"), "times", F.transform("times", lambda x: x / 2).alias("kernel_times"), F.col("n").cast("int").alias("n_candidates"), F.array_max("times").alias("peak"))
    whole = per.groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("version", stats))).alias("results"))
    text = whole.select("d", F.to_json(F.struct(F.struct(F.lit("bench").alias("script"), F.col("d").alias("timestamp")).alias("meta"), "results")).alias("json"))
    doc = "meta struct<script: string, timestamp: string>, results map<string, struct<min: double, mean: double, max: double, times: array<double>, kernel_times: array<double>, n_candidates: int, peak: double>>"
    read = text.select(F.from_json("json", doc).alias("j")).select(F.col("j.meta.timestamp").alias("d"), F.explode("j.results").alias("version", "r"))
    return read.select("d", "version", F.size("r.times").cast("long").alias("n_times"), F.round("r.min", 6).alias("least"), F.round("r.max", 6).alias("longest"), F.round(F.col("r.mean") * F.size("r.times"), 4).alias("total"), F.col("r.n_candidates").cast("long").alias("n_candidates"), F.col("r.peak").alias("peak"))
