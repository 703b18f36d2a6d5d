"""Variants of the tissue filter, their timing, and the comparison of what they keep."""

from __future__ import annotations

import contextlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import BLACK, REJECT, WHITE, keeps
from ..operators.grid import candidates
from ..operators.validate import compare_sets
from .slides import count_tiles, covered, decode_tiles, index_of, patch_counts, patch_pixels, slides_of

METRICS = "version string, category string, n_candidates long, n_kept long, times array<double>, kernel_times array<double>, peak_bytes long, failed string"

#: Each variant asks one question: what does parallelism, batching, fusion, precision or the order of the plan bring?
#: version -> (category, options of variant()).
REGISTRY: dict[str, tuple[str, dict]] = {
    "base": ("plain", {"partitions": 1}),
    "parallel": ("plain", {}),
    "single_rows": ("batch", {"batch_rows": 1}),
    "large_batches": ("batch", {"batch_rows": 4096}),
    "unfused": ("fusion", {"fused": False}),
    "patch_first": ("plan", {"patch_first": True}),
    "half": ("precision", {"precision": "half"}),
    "luma_plane": ("precision", {"precision": "y"}),
    "early_exit": ("toggle", {"early_exit": True}),
}
#: Other names of variants.
ALIASES = {"default": "parallel", "combined": "large_batches", "pipeline": "parallel"}


def registry(spark: SparkSession, category: str | None = None) -> DataFrame:
    rows = [(k, c, {a: str(b) for a, b in o.items()}) for k, (c, o) in REGISTRY.items()]
    rows += [(a, REGISTRY[v][0], {"alias_of": v}) for a, v in ALIASES.items()]
    out = spark.createDataFrame(rows, "version string, category string, options map<string, string>")
    return out.where(F.col("category") == category) if category else out


@contextlib.contextmanager
def setting(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for a while, put back afterwards."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def counts_by_patch(spark: SparkSession, path: str, patch: int, stride: int, white: int = WHITE, black: int = BLACK) -> DataFrame:
    """As patch_counts, by making the pixels of every patch: tiles that patches share are decoded again, those of a batch aside."""
    from ..sources.jpeg import luma_of

    cand = candidates(slides_of(spark, path).select("slide_id", "path", "w", "h"), patch, stride).drop("w", "h")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            names = b.schema.names
            bodies = b.column(names.index("rgb")).to_pylist()  # null: a tile is damaged
            gray = [luma_of(np.frombuffer(r or b"", np.uint8).reshape(-1, 3)) for r in bodies]
            cols = [pa.array([int((g > white).sum()) for g in gray], pa.int64()), pa.array([int((g < black).sum()) for g in gray], pa.int64()), pa.array([patch * patch] * len(gray), pa.int64()), pa.array([r is None for r in bodies])]
            yield pa.RecordBatch.from_arrays([*[b.column(names.index(c)) for c in ("slide_id", "path", "x", "y")], *cols], names=["slide_id", "path", "x", "y", "white", "black", "total", "damaged"])

    return patch_pixels(cand, patch).mapInArrow(run, "slide_id string, path string, x long, y long, white long, black long, total long, damaged boolean")


def variant(spark: SparkSession, path: str, patch: int = 1024, stride: int = 1024, partitions: int = 0, fused: bool = True, precision: str = "luma", patch_first: bool = False, reject: float = REJECT, early_exit: bool = False) -> DataFrame:
    """Kept patches (slide_id, x, y) by one way of running the filter."""
    arrange: Callable[[DataFrame], DataFrame] = (lambda i: i.coalesce(partitions)) if partitions else (lambda i: i)
    counts = counts_by_patch(spark, path, patch, stride) if patch_first else patch_counts(spark, path, patch, stride, precision=precision, arrange=arrange, fused=fused)
    return counts.where(~F.col("damaged") & keeps(F.col("white"), F.col("black"), F.col("total"), reject, early_exit)).select("slide_id", "x", "y")


def measure(spark: SparkSession, path: str, versions: list[str] | None = None, iterations: int = 3, warm_up: bool = True, **how) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(metrics, kept sets by version). A version that fails is told in its row, and the others go on.

    Kept sets are small (coordinates) and persisted, so comparing them does not run the filter again.
    """
    from ..operators.grid import candidate_count

    n = slides_of(spark, path).agg(F.sum(candidate_count(F.col("w"), F.col("h"), how.get("patch", 1024), how.get("stride", 1024)))).first()[0] or 0
    rows, kept = [], {}
    for v in versions or list(REGISTRY):
        category, options = REGISTRY[ALIASES.get(v, v)]
        options = dict(options)
        conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(options.pop("batch_rows"))} if "batch_rows" in options else {}
        try:
            with setting(spark, **conf):
                times, kernel, peak = [], [], 0
                for k in range(iterations + warm_up):
                    began = time.perf_counter()
                    out = variant(spark, path, **options, **how).persist()
                    count = out.count()
                    if k >= warm_up:
                        times.append(time.perf_counter() - began)
                    peak = max(peak, memory_in_use(spark))
                    if k + 1 < iterations + warm_up:
                        out.unpersist(blocking=True)
                kept[v] = out
                for _ in times:  # the kernel's part: entropy decoding, transform and counts without the rollup
                    began = time.perf_counter()
                    count_tiles(index_of(spark, path).where(covered(how.get("patch", 1024), how.get("stride", 1024)))).write.format("noop").mode("overwrite").save()
                    kernel.append(time.perf_counter() - began)
            rows.append((v, category, n, count, times, kernel, peak, None))
        except Exception as e:  # noqa: BLE001  the row says what happened
            rows.append((v, category, n, None, [], [], None, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"))
    return spark.createDataFrame(rows, METRICS), kept


def memory_in_use(spark: SparkSession) -> int:
    """Bytes that the driver's JVM heap and this process hold now."""
    import resource

    run = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    return int(run.totalMemory() - run.freeMemory()) + resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


def training_split(batches: Iterator, step: Callable, n: int = 5) -> dict[str, float]:
    """Seconds that the first n batches take to come and to be stepped on, and the share of the former."""
    load = compute = 0.0
    done = 0
    while done < n:
        began = time.perf_counter()
        got = next(batches, None)
        load += time.perf_counter() - began
        if got is None:
            break
        began = time.perf_counter()
        step(*got)
        compute += time.perf_counter() - began
        done += 1
    return {"batches": done, "load": load, "compute": compute, "load_fraction": load / (load + compute) if load + compute else 0.0}


def agreement(kept: dict[str, DataFrame], base: str = "base") -> DataFrame:
    """A row per version: how its kept set compares with the base's."""
    out = None
    for v, df in kept.items():
        row = compare_sets(kept[base], df, ["slide_id", "x", "y"]).withColumn("version", F.lit(v))
        out = row if out is None else out.unionByName(row)
    return out


def probe(spark: SparkSession, path: str, n: int = 64) -> DataFrame:
    """(stage, mode, rows, seconds, rate): reading headers and index, decoding, counting; alone and with all cores."""
    index = index_of(spark, path).where(covered(1, 1) & (F.col("bytecount") > 0)).limit(n).persist()
    tiles = index.count()
    cores = spark.sparkContext.defaultParallelism
    wide = index.repartition(cores).persist()
    wide.count()
    stages = {("index", "single"): index_of(spark, path).coalesce(1), ("decode", "single"): decode_tiles(index.coalesce(1)), ("count", "single"): count_tiles(index.coalesce(1)), ("decode", f"tasks x{cores}"): decode_tiles(wide), ("count", f"tasks x{cores}"): count_tiles(wide)}
    rows = []
    for (stage, mode), df in stages.items():
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        rows.append((stage, mode, tiles, seconds, tiles / seconds if seconds else 0.0))
    return spark.createDataFrame(rows, "stage string, mode string, rows long, seconds double, rate double")


def properties(spark: SparkSession) -> DataFrame:
    """(name, value): what the engine runs on, and how it is set."""
    sc = spark.sparkContext
    system = sc._jvm.java.lang.System
    rows = [("spark.version", sc.version), ("cores", str(sc.defaultParallelism)), ("max_heap_bytes", str(sc._jvm.java.lang.Runtime.getRuntime().maxMemory()))]
    rows += [(k, str(system.getProperty(k))) for k in ("java.version", "java.vm.name", "os.name", "os.arch")]
    rows += sorted((k, v) for k, v in sc.getConf().getAll() if k.startswith(("spark.sql.", "spark.executor.", "spark.driver.memory")))
    return spark.createDataFrame(rows, "name string, value string")


def transfer_bandwidth(spark: SparkSession, megabytes: int = 64) -> DataFrame:
    """(direction, megabytes, seconds, rate): Arrow batches from the JVM to Python, and there and back."""
    src = spark.range(megabytes * 1024).select(F.repeat(F.lit("x"), 1024).cast("binary").alias("body"))
    gone = src.mapInArrow(lambda batches: (b.slice(0, 0) for b in batches), src.schema)
    back = src.mapInArrow(lambda batches: batches, src.schema)
    rows = []
    for name, df in (("to Python", gone), ("there and back", back)):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        rows.append((name, megabytes, seconds, megabytes / seconds))
    return spark.createDataFrame(rows, "direction string, megabytes long, seconds double, rate double")


def decode_with_jvm(spark: SparkSession, path: str) -> DataFrame:
    """(slide_id, tile_id, rows, columns, bgr): the tiles decoded by Spark's image source instead of the decoder here.

    That source reads files, so tasks write each tile as a whole stream under the shared folder first. It skips damaged tiles.
    """
    import uuid

    import pyarrow as pa
    import pyarrow.fs as pafs

    from ..session import shared_folder
    from ..sources.tiff import directory

    folder = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    fs, inner = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    fs.create_dir(inner)
    local = isinstance(fs, pafs.LocalFileSystem)

    def write(batches):
        store = pafs.LocalFileSystem() if local else pafs.FileSystem.from_uri(folder)[0]
        for b in batches:
            for slide, path_, tile, raw in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                tables = directory(path_).jpegtables
                with store.open_output_stream(f"{inner}/{slide}~{tile}.jpg") as f:
                    f.write(raw[:2] + tables[2:-2] + raw[2:])
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    tiles = spark.read.format("tiledtiff").option("mode", "tiles").option("skipempty", "true").load(path)
    tiles.select("slide_id", "path", "tile_id", "raw").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    out = spark.read.format("image").option("dropInvalid", True).load(inner if local else folder)
    name = F.regexp_extract("image.origin", r"([^/]*)\.jpg$", 1)
    return out.select(F.substring_index(name, "~", 1).alias("slide_id"), F.substring_index(name, "~", -1).cast("long").alias("tile_id"), F.col("image.height").alias("rows"), F.col("image.width").alias("columns"), F.col("image.data").alias("bgr"))


# --- benchmark documents ------------------------------------------------------------------------------------------

DOCUMENT = (
    "meta struct<script: string, wsi: string, patch_size: int, stride: int, iterations: int, warmup: boolean, timestamp: string>, "
    "results map<string, struct<min: double, mean: double, std: double, max: double, times: array<double>, kernel_times: array<double>, "
    "n_candidates: int, n_kept: int, throughput: double, peak_gpu_bytes: bigint, extra: map<string, string>>>"
)


def document(metrics: DataFrame, meta: dict) -> str:
    """A benchmark document: meta and results by version. As many rows as there are versions are read."""
    results = {}
    for r in metrics.where("failed is null").collect():
        t = np.array(r.times)
        results[r.version] = {"min": t.min(), "mean": t.mean(), "std": t.std(), "max": t.max(), "times": list(r.times), "kernel_times": list(r.kernel_times), "n_candidates": r.n_candidates, "n_kept": r.n_kept, "throughput": r.n_candidates / t.min() if t.min() else 0.0, "peak_gpu_bytes": r.peak_bytes}
    return json.dumps({"meta": meta, "results": results}, indent=2)


def read_documents(spark: SparkSession, path: str, latest: bool = False) -> DataFrame:
    """A row per file and version of benchmark documents; latest: of the last file by name only."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    if latest:
        docs = docs.orderBy(F.desc("file")).limit(1)
    return docs.select("file", "meta", F.explode("results").alias("version", "r")).select("file", "meta.*", "version", "r.*")


def report(results: DataFrame, base: str, width: int = 12) -> DataFrame:
    """(ord, line): a text table of versions by their best time, with the speedup over base ('-' without one)."""
    from pyspark.sql.window import Window

    from ..operators.metrics import speedups

    best = speedups(results.select("version", F.array_min("times").alias("min_t"), "n_candidates", "n_kept"), base)
    show = F.when(F.col("speedup").isNull(), F.lit("-")).otherwise(F.format_string("%.2fx", "speedup"))
    line = F.concat_ws(" | ", F.rpad("version", width, " "), F.lpad(F.format_string("%.3f", "min_t"), 9, " "), F.lpad(F.format_string("%.1f", F.col("n_candidates") / F.col("min_t")), 9, " "), F.lpad(show, 8, " "))
    return best.select((F.row_number().over(Window.orderBy("rank")) - 1).cast("long").alias("ord"), line.alias("line"))


def kernel_report(results: DataFrame, width: int = 12) -> DataFrame:
    """(ord, line): least total, least kernel time, overhead and kernel share of each version, by time."""
    from pyspark.sql.window import Window

    from ..operators.metrics import kernel_share

    out = kernel_share(results.select("version", F.array_min("times").alias("total"), F.array_min("kernel_times").alias("kernel")), "total", "kernel")
    show = lambda c: F.lpad(F.coalesce(F.format_string("%.3f", F.col(c)), F.lit("-")), 9, " ")
    line = F.concat_ws(" | ", F.rpad("version", width, " "), show("total"), show("kernel"), show("overhead"), F.lpad(F.format_string("%.1f%%", "kernel_pct"), 7, " "))
    return out.select((F.row_number().over(Window.orderBy("total", "version")) - 1).cast("long").alias("ord"), line.alias("line"))


def summary_report(results: DataFrame) -> DataFrame:
    """(ord, line): a sentence per version."""
    from pyspark.sql.window import Window

    line = F.format_string("%s: %.3f s (mean %.3f s), kept %d of %d", "version", F.array_min("times"), F.aggregate("times", F.lit(0.0), lambda a, x: a + x) / F.size("times"), F.col("n_kept").cast("long"), F.col("n_candidates").cast("long"))
    return results.select((F.row_number().over(Window.orderBy("version")) - 1).cast("long").alias("ord"), line.alias("line"))


def section_report(results: DataFrame, width: int = 12) -> DataFrame:
    """(ord, line): versions under a heading per category, by time in each."""
    from pyspark.sql.window import Window

    spark = results.sparkSession
    named = results.join(F.broadcast(registry(spark).select(F.col("version").alias("r_version"), "category")), F.col("version") == F.col("r_version"))
    rows = named.select("category", F.lit(1).alias("kind"), F.array_min("times").alias("t"), "version", F.concat(F.lit("  "), F.rpad("version", width, " "), F.lpad(F.format_string("%.3f s", F.array_min("times")), 12, " ")).alias("line"))
    heads = named.select("category").distinct().select("category", F.lit(0).alias("kind"), F.lit(0.0).alias("t"), F.lit("").alias("version"), F.concat(F.lit("== "), F.col("category"), F.lit(" ==")).alias("line"))
    order = Window.orderBy("category", "kind", "t", "version")
    return heads.unionByName(rows).select((F.row_number().over(order) - 1).cast("long").alias("ord"), "line")
