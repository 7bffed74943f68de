"""Entities: names made unique, duplicates merged by similarity, links rewritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import clean_id
from ..sources.tables import cut
from .graph import components
from .vector_search import similar_pairs


def uniquify_labels(df: DataFrame, label: str, order: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """The second and later rows of a label get _2, _3 and so on."""
    n = F.row_number().over(W.partitionBy(*partition, label).orderBy(*order))
    return df.withColumn(label, F.when(n > 1, F.concat(label, F.lit("_"), n.cast("string"))).otherwise(F.col(label)))


def uniquify_ids(frames: Sequence[DataFrame], id_col: str = "id", relations: str = "relationships", edges: str | None = "edges") -> DataFrame:
    """Frames in order of precedence as one, ids of later ones suffixed until they are free; a frame's own links follow its new ids.

    Suffixed ids can meet ids that are there already, so rounds go on while any are taken twice.
    """
    every = None
    for k, df in enumerate(frames):
        part = df.withColumn("_frame", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    every = cut(every, "frames")
    names = every.select("_frame", F.col(id_col).alias("old")).distinct().withColumn("new", F.col("old")).withColumn("_try", F.lit(1))
    while True:
        w = W.partitionBy("new").orderBy((F.col("_try") > 1), "_frame", "old")
        ranked = cut(names.withColumn("_n", F.row_number().over(w)), "id-round")
        if ranked.where("_n > 1").isEmpty():
            break
        again = F.greatest(F.col("_n"), F.col("_try") + 1)
        names = ranked.select("_frame", "old", F.when(F.col("_n") > 1, F.concat("old", F.lit("_"), again.cast("string"))).otherwise(F.col("new")).alias("new"), F.when(F.col("_n") > 1, again).otherwise(F.col("_try")).alias("_try"))
    names = ranked.select("_frame", F.col("old").alias(id_col), "new")
    out = every.join(names, ["_frame", id_col]).withColumn(id_col, F.col("new")).drop("new")
    if relations in every.columns:
        out = _renamed(out, names, id_col, relations, ["source", "target"])
    if edges and edges in every.columns:
        out = _renamed(out, names, id_col, edges, None)
    return cut(out.drop("_frame"), "unique-ids")


def _renamed(df: DataFrame, names: DataFrame, id_col: str, column: str, fields: list[str] | None) -> DataFrame:
    """df with the ids in a list column (in these fields of its structs, or its values) renamed by names of the row's own frame, by joins on the ids, in their order."""
    each = df.select("_frame", F.col(id_col).alias("_owner"), F.posexplode(column).alias("_k", "_v"))
    parts = fields or ["_v"]
    flat = each.select("_frame", "_owner", "_k", *[(F.col("_v")[f] if fields else F.col("_v")).alias(f) for f in parts])
    for f in parts:
        at = names.select("_frame", F.col(id_col).alias(f), F.col("new").alias("_new"))
        flat = flat.join(at, ["_frame", f], "left").withColumn(f, F.coalesce("_new", f)).drop("_new")
    value = F.struct(*parts) if fields else F.col("_v")
    lists_ = flat.groupBy(F.col("_owner").alias(id_col)).agg(lists.ordered(value, F.col("_k")).alias("_list"))
    empty = F.when(F.col(column).isNotNull(), F.array().cast(dict(df.dtypes)[column]))
    return df.join(lists_, id_col, "left").withColumn(column, F.coalesce(F.col("_list").cast(dict(df.dtypes)[column]), empty)).drop("_list")


def sanitise_ids(nodes: DataFrame, row: str = "row", node_id: str = "id") -> DataFrame:
    """(row, id, new_id): ids as lower-case words with their row in front; ids of a row that meet are numbered in the order of the originals."""
    base = F.concat(F.lit("row"), F.col(row).cast("string"), F.lit("_"), clean_id(F.col(node_id)))
    ids = nodes.select(row, node_id).distinct().withColumn("new_id", base)
    n = F.row_number().over(W.partitionBy(row, "new_id").orderBy(node_id))
    return ids.withColumn("new_id", F.when(n > 1, F.concat("new_id", F.lit("_"), n.cast("string"))).otherwise(F.col("new_id")))


def remap_nodes(df: DataFrame, mapping: DataFrame, row: str = "row", nodes: str = "nodes") -> DataFrame:
    """Ids, causes and effects inside node arrays through a mapping (row, id, new_id); unknown ones stay."""
    maps = mapping.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("id", "new_id"))).alias("_map"))
    at = lambda x: F.coalesce(F.try_element_at("_map", x), x)
    each = lambda n: n.withField("id", at(n["id"])).withField("caused_by", F.transform(n["caused_by"], at)).withField("caused", F.transform(n["caused"], at))
    return df.join(maps, row, "left").withColumn(nodes, F.transform(nodes, each)).drop("_map")


def relabel_relations(df: DataFrame, mapping: DataFrame, key: str, label: str, relations: str) -> DataFrame:
    """Relations of each row with labels renamed by the key's mapping (key, old, new), and only those that touch the row's label."""
    maps = mapping.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_map"))
    at = lambda x: F.coalesce(F.try_element_at("_map", x), x)
    renamed = F.transform(relations, lambda r: F.struct(at(r["source"]).alias("source"), at(r["target"]).alias("target")))
    return df.join(maps, key, "left").withColumn(relations, F.filter(renamed, lambda r: (r["source"] == F.col(label)) | (r["target"] == F.col(label)))).drop("_map")


def groups(df: DataFrame, label: str, vector: str, threshold: float, k: int | None = 30) -> DataFrame:
    """(label, representative): labels that chains of similar rows join, by their smallest label. Equal labels are one to begin with."""
    rows = cut(df.select(F.col(label).alias("label"), F.col(vector).alias("v")).withColumn("id", F.monotonically_increasing_id()), "entity-vectors")
    links = similar_pairs(rows.select("id", "v"), "id", "v", threshold, k).where("i <> j").select(F.col("i").alias("src"), F.col("j").alias("dst"))
    same = rows.groupBy("label").agg(F.min("id").alias("src")).join(rows.select("label", F.col("id").alias("dst")), "label").where("src <> dst").select("src", "dst")
    found = rows.select("label", "id").join(components(links.unionByName(same), "entities"), "id", "left").select("label", F.coalesce("component", "id").alias("component"))
    least = found.groupBy("component").agg(F.min("label").alias("representative"))
    return found.select("label", "component").distinct().join(least, "component").select("label", "representative")


def rewrite_edges(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source, target, ord): relations(source, target, ord) between representatives, without loops, each at its first place."""
    s, t = mapping.select(F.col("label").alias("source"), F.col("representative").alias("_s")), mapping.select(F.col("label").alias("target"), F.col("representative").alias("_t"))
    at = relations.join(s, "source", "left").join(t, "target", "left").select(F.coalesce("_s", "source").alias("source"), F.coalesce("_t", "target").alias("target"), "ord")
    return at.where("source <> target").groupBy("source", "target").agg(F.min("ord").alias("ord"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(source, edges, relationships) of edges(source, target, ord), in order of ord."""
    pair = F.struct("source", "target")
    return edges.groupBy("source").agg(lists.ordered(F.col("target"), F.col("ord"), F.col("target")).alias("edges"), lists.ordered(pair, F.col("ord"), F.col("target")).alias("relationships"))


def merge_entities(df: DataFrame, label: str, vector: str, threshold: float, singles: Sequence[str], collected: Sequence[tuple[str, str]], relations: str, order: str, k: int | None = 30) -> DataFrame:
    """One row per group of similar rows: its smallest label, single fields of its first row, lists in row order, frequency, and links between groups.

    The columns edges and relationships are always there, empty for groups without links.
    """
    df = cut(df, "entity-rows")
    mapping = cut(groups(df, label, vector, threshold, k), "entity-groups")
    rows = df.join(mapping.withColumnRenamed("label", label), label)
    merged = rows.groupBy(F.col("representative").alias(label)).agg(F.min_by(F.struct(*singles), F.col(order)).alias("_s"), *[lists.ordered(F.col(src), F.col(order)).alias(name) for name, src in collected], F.count("*").alias("frequency"))
    links = df.select(F.col(order).alias("_row"), F.posexplode(relations).alias("_k", "r")).select(F.col("r.source").alias("source"), F.col("r.target").alias("target"), F.struct("_row", "_k").alias("ord"))
    found = adjacency(rewrite_edges(links, mapping)).withColumnRenamed("source", label)
    out = merged.join(found, label, "left").select(label, *[F.col(f"_s.{c}").alias(c) for c in singles if c != label], *[name for name, _ in collected], "frequency", "edges", "relationships")
    return out.withColumn("edges", F.coalesce("edges", F.array().cast("array<string>"))).withColumn("relationships", F.coalesce("relationships", F.array().cast("array<struct<source: string, target: string>>")))
