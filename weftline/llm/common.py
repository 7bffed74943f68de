"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many narrow rows (two or three numbers each) may be broadcast.
BROADCAST_ROWS = 1_000_000


def ship(name: str) -> None:
    """Let tasks get the functions of this module by value, so that executors need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def worker_cache() -> dict:
    """A dict that lives as long as this Python worker, across tasks."""
    return sys.modules.setdefault("weftline_worker_cache", types.ModuleType("weftline_worker_cache")).__dict__


def enter(kernel: str) -> None:
    """Called by a task at its start: what other kernels keep in this Python worker goes, so stages of one job don't add up, and memory that no one holds goes back to the system."""
    kept = worker_cache()
    if kept.get("kernel") != kernel:
        for name in [k for k in kept if not k.startswith("__")]:
            del kept[name]
        kept["kernel"] = kernel
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new one on this machine where none is set and all tasks run in this process (tests)."""
    if not (root := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the session ends."""
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}/{name}"
    jvm = spark._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_sized(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts right when it has at most `rows` rows (counted, so right should be a table; its columns are numbers or short texts, so rows bound bytes), and shuffles both sides beyond."""
    small = right.select(F.lit(1)).limit(rows + 1).count() <= rows
    return left.join(F.broadcast(right) if small else right.hint("merge"), on, how)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of the nodes that edges touch, as a table (id, component): the smallest id reachable.

    edges: src, dst (any direction, repeats and loops allowed). Alternating large-star and small-star
    steps shrink every component to a star around its smallest id, in about log2 of its
    size rounds; every round writes its edges as a table.
    """
    norm = lambda e: e.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    sized = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    stars = cut(norm(edges), f"{name}-0")
    was, k = sized(stars), 0
    while was[0]:
        k += 1
        both = stars.unionByName(stars.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.min("src")).alias("low"))
        # large star: neighbours above a node hang on the smallest of its neighbourhood
        up = stars.select(F.col("dst").alias("at"), F.col("src").alias("up")).join(low.withColumnRenamed("src", "at"), "at").select(F.col("up").alias("src"), F.col("low").alias("dst"))
        large = norm(up.unionByName(low.select("src", F.col("low").alias("dst"))))
        # small star: a node and its neighbours below hang on the smallest of them
        least = large.groupBy("src").agg(F.min("dst").alias("low"))
        down = large.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        stars = cut(norm(down.unionByName(least.select("src", F.col("low").alias("dst")))), f"{name}-{k}")
        if (now := sized(stars)) == was:
            break
        was = now
    own = stars.select("dst").distinct()
    return stars.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(own.select(F.col("dst").alias("id"), F.col("dst").alias("component")))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Bound the rows and the bytes of an Arrow batch, as texts can be long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = spark.conf.get(key).lower().removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(key, str(most))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores behind it as it takes to clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
