"""Graphs as nodes(id) and edges(src, dst)."""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import cut


def build(nodes: DataFrame, targets: str = "edges", node_id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rows with an adjacency list; endpoints that have no row become nodes without attributes."""
    edges = nodes.select(F.col(node_id).alias("src"), F.explode(targets).alias("dst")).where("dst IS NOT NULL").distinct()
    ends = edges.select(F.col("src").alias(node_id)).union(edges.select("dst")).distinct()
    return nodes.unionByName(ends.join(nodes, node_id, "left_anti"), allowMissingColumns=True), edges


def isolated(nodes: DataFrame, edges: DataFrame, node_id: str = "id") -> DataFrame:
    ends = edges.select(F.col("src").alias(node_id)).union(edges.select("dst")).distinct()
    return nodes.join(ends, node_id, "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in) of the nodes that edges touch."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def relatives(edges: DataFrame, node_id: object, direction: str = "children", depth: int = 1) -> DataFrame:
    """(id, depth): nodes within depth steps, at the fewest steps; none for an unknown node."""
    a, b = ("src", "dst") if direction == "children" else ("dst", "src")
    step = edges.select(F.col(a).alias("at"), F.col(b).alias("to"))
    found = step.where(F.col("at") == F.lit(node_id)).select(F.col("to").alias("id"), F.lit(1).alias("depth")).distinct()
    front = found
    for k in range(2, depth + 1):
        front = front.join(step, front["id"] == step["at"]).select(F.col("to").alias("id"), F.lit(k).alias("depth")).distinct().join(found, "id", "left_anti")
        found = found.unionByName(front)
    return found


def incident(edges: DataFrame, node_id: object) -> DataFrame:
    """Edges at a node with their direction, each once."""
    out = edges.where(F.col("src") == F.lit(node_id)).select("src", "dst", F.lit("out").alias("direction"))
    return out.unionByName(edges.where((F.col("dst") == F.lit(node_id)) & (F.col("src") != F.lit(node_id))).select("src", "dst", F.lit("in").alias("direction"))).distinct()


def neighbours(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(id, neighbours): for each node, or each of seeds(id), the sorted ids that edges link with it in either direction; empty for a seed without any."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).union(edges.select("dst", "src")).where("id <> to").distinct()
    found = both.groupBy("id").agg(F.sort_array(F.collect_list("to")).alias("neighbours"))
    if seeds is None:
        return found
    none = F.array().cast(dict(found.dtypes)["neighbours"])
    return seeds.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("neighbours", none).alias("neighbours"))


def shortest_path(edges: DataFrame, source: object, target: object, most: int | None = None) -> list | None:
    """Nodes of a shortest directed path, the smallest in order of its nodes among equals; None without one (of `most` steps, where that is set).

    Breadth first, until nothing new is reached: each round keeps a node's smallest path. The frontier and what was seen are tables, so plans stay short.
    """
    if not edges.where((F.col("src") == F.lit(source)) | (F.col("dst") == F.lit(source))).limit(1).count():
        return None
    if source == target:
        return [source]
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    front = spark.createDataFrame([(source, [source])], f"id {kind}, path array<{kind}>")
    seen = front.select("id")
    for k in itertools.count() if most is None else range(most):
        front = front.join(edges, front["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("path")).join(seen, "id", "left_anti")
        front = cut(front.withColumn("path", F.concat("path", F.array("id"))), f"bfs-{k}")
        if hit := front.where(F.col("id") == F.lit(target)).select("path").first():
            return list(hit["path"])
        if front.isEmpty():
            return None
        seen = seen.union(front.select("id"))
        if k % 8 == 7:
            seen = cut(seen, f"seen-{k}")
    return None


def pagerank(nodes: DataFrame, edges: DataFrame, reset: DataFrame, alpha: float = 0.85, directed: bool = True, rounds: int = 100, tolerance: float | None = 1e-6, every: int = 5) -> DataFrame:
    """(seed, id, score): personalised PageRank by power iteration for every seed of reset(seed, id, weight) at once.

    Weights are normalised a seed; seeds whose weights are all zero give no rows. Dangling mass goes back to the reset, so scores are in proportion to
    y = reset + alpha * (y along the edges), which is iterated without that mass and normalised at the end: a round is one join and one sum, and the plan grows
    by one of each. Every few rounds y is a table; rounds end when the largest seed's L1 change since the last table is below tolerance times the nodes, or,
    with a warning, after `rounds`. nodes: id.
    """
    e = edges.select("src", "dst")
    if not directed:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    e = cut(e.join(e.groupBy("src").agg(F.count("*").alias("out")), "src").select("src", "dst", "out"), "pagerank-edges")
    known = reset.where("weight > 0").join(nodes.select("id"), "id").groupBy("seed", "id").agg(F.sum("weight").alias("weight"))
    p = cut(known.join(known.groupBy("seed").agg(F.sum("weight").alias("all")), "seed").select("seed", "id", (F.col("weight") / F.col("all")).alias("y")), "pagerank-reset")
    n = nodes.count() if tolerance is not None else 0
    rank = table = p.withColumn("y", F.col("y") / (1 - alpha))
    for k in range(1, rounds + 1):
        sent = rank.join(e, rank["id"] == e["src"]).select("seed", F.col("dst").alias("id"), (alpha * F.col("y") / F.col("out")).alias("y"))
        rank = p.unionByName(sent).groupBy("seed", "id").agg(F.sum("y").alias("y"))
        if k % every == 0 or k == rounds:
            rank = cut(rank, f"pagerank-{k}")
            if tolerance is not None:
                moved = rank.unionByName(table.withColumn("y", -F.col("y"))).groupBy("seed", "id").agg(F.abs(F.sum("y")).alias("d")).groupBy("seed").agg(F.sum("d").alias("d"))
                change = moved.agg(F.max("d")).first()[0]
                if change is None or (1 - alpha) * change < tolerance * n:
                    break
                if k == rounds:
                    warnings.warn(f"PageRank ends after {rounds} rounds with a change of {(1 - alpha) * change}", stacklevel=2)
            table = rank
    return rank.join(rank.groupBy("seed").agg(F.sum("y").alias("all")), "seed").select("seed", "id", (F.col("y") / F.col("all")).alias("score"))


def causal_chain(nodes: DataFrame, edges: DataFrame, source: object, target: object, frequency: str = "frequency", k: int = 10) -> list:
    """A shortest path; without one, the k best nodes by PageRank that starts at both ends, rarer ends first."""
    if (path := shortest_path(edges, source, target)) is not None:
        return path
    ends = nodes.where(F.col("id").isin(source, target))
    if ends.count() < 2:
        return []
    reset = ends.select(F.lit(0).alias("seed"), "id", (1 / F.greatest(F.col(frequency), F.lit(1))).alias("weight"))
    return [r["id"] for r in pagerank(nodes.select("id"), edges, reset).orderBy(F.desc("score"), "id").limit(k).collect()]


def shortest_paths(edges: DataFrame, pairs: DataFrame, name: str = "paths") -> DataFrame:
    """(pair, path) for pairs(pair, a, b), a table: a shortest directed path from a to b, the smallest in order of its nodes among equals; pairs without one are missing.

    All pairs at once, from both ends: a step of the smaller of the two frontiers, keyed by pair, then the test whether they meet. A node keeps a pair's smallest
    path. Pairs that met, or an end of which has nothing new to reach, take no further part.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct(), f"{name}-edges")
    kind = dict(edges.dtypes)["src"]
    known = cut(e.select("src").union(e.select("dst")).distinct().withColumnRenamed("src", "id"), f"{name}-known")
    live = pairs.select("pair", F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")).join(known.withColumnRenamed("id", "a"), "a").join(known.withColumnRenamed("id", "b"), "b")
    live = cut(live.select("pair", "a", "b"), f"{name}-pairs")
    done = live.where("a = b").select("pair", F.array("a").alias("path"))
    sides = {}
    for end, step in (("a", e), ("b", e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))):
        first = live.where("a <> b").select("pair", F.col(end).alias("id"), F.array(end).alias("path"))
        sides[end] = {"step": step, "front": first, "seen": first.select("pair", "id", "path"), "n": 0}
    for k in itertools.count(1):
        counts = {end: s["front"].count() for end, s in sides.items()}
        if not all(counts.values()):
            return done
        end = min(sides, key=lambda x: counts[x])
        side, other = sides[end], sides["b" if end == "a" else "a"]
        grown = F.concat("path", F.array("dst")) if end == "a" else F.concat(F.array("dst"), F.col("path"))
        reached = side["front"].join(side["step"], F.col("id") == F.col("src")).select("pair", F.col("dst").alias("id"), grown.alias("path")).groupBy("pair", "id").agg(F.min("path").alias("path"))
        front = cut(reached.join(side["seen"].select("pair", "id"), ["pair", "id"], "left_anti"), f"{name}-{k}")
        ours, theirs = front.select("pair", "id", F.col("path").alias("p")), other["front"].select("pair", "id", F.col("path").alias("q"))
        whole = F.concat("p", F.slice("q", F.lit(2), F.size("q"))) if end == "a" else F.concat("q", F.slice("p", F.lit(2), F.size("p")))
        met = cut(ours.join(theirs, ["pair", "id"]).select("pair", whole.alias("path")).groupBy("pair").agg(F.min("path").alias("path")), f"{name}-met-{k}")
        done = done.unionByName(met)
        # of a pair both frontiers have to go on
        going = front.select("pair").distinct().join(other["front"].select("pair").distinct(), "pair", "left_semi").join(met.select("pair"), "pair", "left_anti")
        going = cut(going, f"{name}-going-{k}")
        side["seen"] = cut(side["seen"].unionByName(front).join(going, "pair", "left_semi"), f"{name}-seen-{k}")
        side["front"] = front.join(going, "pair", "left_semi")
        other["front"] = cut(other["front"].join(going, "pair", "left_semi"), f"{name}-other-{k}")


def causal_chains(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, frequency: str = "frequency", k: int = 10) -> DataFrame:
    """(pair, place, id, linked) for pairs(pair, a, b): the nodes of a shortest path (linked), else the k best nodes by PageRank that starts at both ends, rarer ends first.

    A pair with an end that is no node has no rows. One PageRank serves all pairs without a path.
    """
    asked = cut(pairs.select("pair", "a", "b"), "chain-pairs")
    told = cut(shortest_paths(edges, asked), "chain-paths")
    ends = asked.join(told.select("pair"), "pair", "left_anti").select("pair", F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).join(nodes.select("id", F.col(frequency).alias("_n")), "id")
    full = asked.select("pair", F.size(F.array_distinct(F.array("a", "b"))).alias("ends"))
    both = ends.groupBy("pair").agg(F.count("*").alias("n")).join(full, "pair").where("n = ends").select("pair")
    alone = both.join(asked.where("a = b"), "pair", "left_semi")  # a node without edges is its own path
    reset = ends.join(both, "pair", "left_semi").join(alone, "pair", "left_anti").select(F.col("pair").alias("seed"), "id", (1 / F.greatest(F.col("_n"), F.lit(1))).alias("weight"))
    ranked = pagerank(nodes.select("id"), edges, cut(reset, "chain-reset")).withColumn("place", (F.row_number().over(W.partitionBy("seed").orderBy(F.desc("score"), "id")) - 1).cast("long"))
    paths = told.unionByName(asked.join(alone, "pair", "left_semi").select("pair", F.array("a").alias("path")))
    linked = paths.select("pair", F.posexplode("path").alias("place", "id")).select("pair", F.col("place").cast("long").alias("place"), "id", F.lit(True).alias("linked"))
    return linked.unionByName(ranked.where(F.col("place") < k).select(F.col("seed").alias("pair"), "place", "id", F.lit(False).alias("linked")))


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the edges of a task a star for each component that they make: every node with the smallest one."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            if (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    nodes = list(root)
    for at in range(0, len(nodes), 10_000):
        part = [(n, find(n)) for n in nodes[at : at + 10_000]]
        yield pd.DataFrame([p for p in part if p[0] != p[1]], columns=["src", "dst"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) of the nodes that edges(src, dst) touch: the smallest id reachable, in any direction.

    Edges of a task first become stars, before anything is shuffled, so repeats do no harm. Then rounds of hooking: every node takes the smallest label among its neighbours, then labels take their own label's label, so
    chains halve each round. Labels are a table every round.
    """
    kind = dict(edges.dtypes)["src"]
    stars = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).mapInPandas(forest, f"src {kind}, dst {kind}")
    stars = cut(stars, f"{name}-stars")
    e = cut(stars.unionByName(stars.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), f"{name}-edges")
    label = cut(e.groupBy("src").agg(F.least(F.min("dst"), F.min("src")).alias("component")).withColumnRenamed("src", "id"), f"{name}-0")
    for k in itertools.count(1):
        near = e.join(label, e["dst"] == label["id"]).groupBy("src").agg(F.min("component").alias("low"))
        hooked = label.join(near, label["id"] == near["src"]).select("id", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        up = label.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = cut(hooked.join(up, "component", "left").select("id", "was", F.least("component", F.coalesce("up", "component")).alias("component")), f"{name}-{k}")
        label = new.select("id", "component")
        if new.where("was <> component").isEmpty():
            return label


def raw_chunk(nodes: DataFrame, chunks: DataFrame, node_id: object, pick: Column | None = None) -> str:
    """Text of the first of a node's chunks ('' for an unknown node)."""
    chosen = nodes.where(F.col("id") == F.lit(node_id)).select((pick if pick is not None else F.array_min("chunk_ids")).alias("chunk_id"))
    row = chosen.join(chunks, "chunk_id").select("messages_str").first()
    return row[0] if row and row[0] is not None else ""
