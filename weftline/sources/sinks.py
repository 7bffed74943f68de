"""Writers: partitioned Parquet, upserts, GraphML, traces, models."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_row_prefix
from ..operators.external import TRACE_SCHEMA, Trace
from ..operators.relational import connect
from .snapshots import Store
from .tables import shared_dir


def write_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet by keys; only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def holds_table(spark: SparkSession, path: str) -> bool:
    """Whether there is a finished table at path; an error of the file system is raised, not taken for a no."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.listStatus(at).__len__() > 0


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> None:
    """Rows of the table at path replaced by those of new with their keys, others added; twice the same is once. Of rows of new that share a key one counts.

    The merged table is written beside the old one and then takes its name, so a failure on the way leaves one of them whole.
    """
    new = new.dropDuplicates(list(keys))
    if not holds_table(spark, path):
        new.write.mode("overwrite").parquet(path)
        return
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    at, fresh, old_at = path_of(path), path_of(f"{path}.new"), path_of(f"{path}.old")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    old = spark.read.parquet(path)
    old.join(new.select(*keys), list(keys), "left_anti").unionByName(new, allowMissingColumns=True).write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(old_at, True)
    if not (fs.rename(at, old_at) and fs.rename(fresh, at)):
        raise OSError(f"{path}.new could not take the place of {path}")
    fs.delete(old_at, True)
    spark.catalog.refreshByPath(path)


def save_graph(spark: SparkSession, root: str, nodes: DataFrame, chunks: DataFrame, users: DataFrame) -> int:
    """Nodes, chunks and their link tables, upserted in one transaction (see snapshots), whose version comes back; ids and edges without the prefixes of their rows."""
    clean = nodes.withColumn("id", strip_row_prefix(F.col("id"))).withColumn("edges", F.transform("edges", strip_row_prefix))
    links = {name: (links, links.columns) for name, links in connect(clean, chunks, users).items()}
    return Store(spark, root).upsert({"chunks": (chunks, ["chunk_id"]), "nodes": (clean, ["id"]), "users": (users, ["id"]), **links})


def _xml(value: Column, quote: bool = False) -> Column:
    text = F.replace(F.replace(F.replace(value.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit("&quot;")), F.lit('"')) if quote else text


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str, node_id: str = "id") -> None:
    """One GraphML file, on any file system that Spark reaches: tasks spell and write the lines, whose files are then strung together as bytes, a MB at a time."""
    names = [c for c in nodes.columns if c != node_id]
    said = lambda c: F.col(c) if dict(nodes.dtypes)[c] == "string" else F.to_json(F.col(c)) if dict(nodes.dtypes)[c].startswith(("array", "map", "struct")) else F.col(c).cast("string")
    data = [F.coalesce(F.concat(F.lit(f'<data key="{c}">'), _xml(said(c)), F.lit("</data>")), F.lit("")) for c in names]
    of_node = nodes.select(F.concat(F.lit("<node id="), _xml(F.col(node_id), True), F.lit(">"), *data, F.lit("</node>")).alias("line"))
    of_edge = edges.select(F.concat(F.lit("<edge source="), _xml(F.col("src"), True), F.lit(" target="), _xml(F.col("dst"), True), F.lit("/>")).alias("line"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *(f'<key id="{c}" for="node" attr.name="{c}" attr.type="string"/>' for c in names), '<graph edgedefault="directed">']
    spark = nodes.sparkSession
    conf, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    parts = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    at, drafts = path_of(path), path_of(parts)
    source = drafts.getFileSystem(conf)
    source.deleteOnExit(drafts)
    out = at.getFileSystem(conf).create(at, True)
    try:
        out.write(bytearray(("\n".join(head) + "\n").encode()))
        for name, lines in (("nodes", of_node), ("edges", of_edge)):
            lines.write.text(f"{parts}/{name}")
            for part in sorted(f.getPath().toString() for f in source.listStatus(path_of(f"{parts}/{name}")) if f.getPath().getName().startswith("part-")):
                held = source.open(path_of(part))
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(held, out, 1 << 20, False)
                held.close()
        out.write(bytearray(b"</graph>\n</graphml>\n"))
    finally:
        out.close()
    source.delete(drafts, True)


def save_traces(spark: SparkSession, traces: Sequence[Trace], path: str) -> None:
    spark.createDataFrame([asdict(t) for t in traces], TRACE_SCHEMA).write.mode("append").parquet(path)


def save_models(models, path: str) -> None:
    for name, model in zip(("scaler", "pca"), models, strict=True):
        model.write().overwrite().save(f"{path}/{name}")


def load_models(path: str):
    from pyspark.ml.feature import PCAModel, StandardScalerModel

    return StandardScalerModel.load(f"{path}/scaler"), PCAModel.load(f"{path}/pca")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
