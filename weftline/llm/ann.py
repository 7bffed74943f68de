"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue a query, exact reranking.

Trees are fitted on a bounded sample; every row of the table is put in a leaf of each. A query takes the most promising leaf
of any tree from its queue until it has met its share of the rows. That share is the smallest
at which the sample's own queries find RECALL of their true neighbours, measured against brute force in the sample; as a table of N rows
holds its k nearest where a sample of n has its k n / N nearest, that many count. Queries that so find fewer than they
should go on with their queue, up to all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship, small_batches, table

ship(__name__)

TREES = 4
#: Rows that trees are fitted on, and of those the ones that serve as queries when the share is measured.
SAMPLE, PROBES = 20_000, 150
LEAF = 100
RECALL = 0.97
#: Rows of a leaf that one task compares with the leaf's queries.
BLOCK = 8192


class Tree:
    """Inner node k has a normal and an offset; its children are left[k] and right[k]. A negative child -1 - j is leaf j."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        normals, offsets, left, right = [], [], [], []
        self.leaves = 0
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
        self.root = 0
        while todo:
            rows, parent, side = todo.pop()
            split = self.split(x[rows], rng) if len(rows) > leaf else None
            if split is None:
                me = -1 - self.leaves
                self.leaves += 1
            else:
                me = len(normals)
                normal, offset, over = split
                normals.append(normal)
                offsets.append(offset)
                left.append(0)
                right.append(0)
                todo += [(rows[~over], me, 0), (rows[over], me, 1)]
            if parent < 0:
                self.root = me
            else:
                (right if side else left)[parent] = me
        self.normals, self.offsets = np.array(normals).reshape(len(normals), x.shape[1]), np.array(offsets)
        self.left, self.right = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)

    @classmethod
    def known(cls, parts: dict) -> Tree:
        """A tree of the arrays of another one (vars of it), which travel to tasks that have no copy of this module."""
        tree = cls.__new__(cls)
        tree.__dict__.update(parts)
        return tree

    @staticmethod
    def split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
        """A random direction, between two of the points if they differ, cut at the median; None if the points can't be told apart."""
        for _ in range(4):
            a, b = rng.integers(0, len(x), 2)
            normal = x[a] - x[b]
            if not normal.any():
                normal = rng.standard_normal(x.shape[1])
            normal = normal / np.abs(normal).max()
            normal = normal / np.linalg.norm(normal)
            along = x @ normal
            offset = float(np.median(along))
            over = along > offset
            if over.any() and not over.all():
                return normal, offset, over
        return None

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root, dtype=np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            k = at[inner]
            over = np.einsum("ij,ij->i", x[inner], self.normals[k]) > self.offsets[k]
            at[inner] = np.where(over, self.right[k], self.left[k])
        return -1 - at


def leaves_for(forest: list[Tree], q: np.ndarray) -> Iterator[tuple[int, int]]:
    """(tree, leaf) in the order of one queue that all trees share: by the worst margin on the way, best first."""
    side = [(t.normals @ q - t.offsets) for t in forest]
    queue = [(-np.inf, n, t.root) for n, t in enumerate(forest)]
    heapq.heapify(queue)
    while queue:
        cost, n, k = heapq.heappop(queue)
        if k < 0:
            yield n, -1 - k
            continue
        over, tree = side[n][k], forest[n]
        heapq.heappush(queue, (max(cost, -over), n, int(tree.right[k])))
        heapq.heappush(queue, (max(cost, over), n, int(tree.left[k])))


def share_needed(forest: list[Tree], x: np.ndarray, k: int, recall: float) -> float:
    """The share of rows (counted once for each tree, so up to the number of trees) that queries must meet to find `recall` of their neighbours, measured in the sample."""
    homes = [t.leaf_of(x) for t in forest]
    sizes = [np.bincount(h, minlength=t.leaves) for h, t in zip(homes, forest, strict=True)]
    needed = []
    for q in np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int):
        d = distances(x, x[q])
        d[q] = np.inf
        true = np.argpartition(d, min(k, len(x) - 1) - 1)[:k] if len(x) > 1 else []
        met, first = 0, {}
        for n, leaf in leaves_for(forest, x[q]):
            met += int(sizes[n][leaf])
            first[n, leaf] = met
        needed += [min(first[n, int(homes[n][v])] for n in range(len(forest))) for v in true if v != q]
    return float(np.quantile(needed, recall)) / len(x) if needed else float(len(forest))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors with an id, without null, non-finite or only zero components, in the precision that they came in."""
    v = F.col(vector_col)
    v = v if dict(vectors.dtypes)[vector_col] == "array<float>" else v.cast("array<double>")
    df = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return df.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64, copy=False)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    most = np.abs(d).max(initial=0)
    return np.sqrt((d * d).sum(axis=1)) if most < 1e150 else most * np.sqrt(((d / most) ** 2).sum(axis=1))


def nearest(k: int):
    """For the rows and the queries that meet in a block of a leaf: each query's k nearest, by exact distances."""

    def search(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(rows) and len(queries):
            x, ids, asked = matrix(rows["v"]), rows["id"].to_numpy(), queries["id"].to_numpy()
            most = np.abs(x).max()
            scale = 1.0 if most < 1e100 else most
            squares = ((x / scale) ** 2).sum(axis=1)
            repeated = len(np.unique(ids)) < len(ids)
            for at in range(0, len(queries), 256):
                q = matrix(queries["v"].iloc[at : at + 256])
                rough = squares[None, :] - 2 * (q / scale @ (x / scale).T)
                slack = 1e-6 * (1 + squares.max())
                for i, query in enumerate(asked[at : at + 256]):
                    d = rough[i]
                    kept = np.flatnonzero(d <= np.partition(d, min(k, len(d) - 1))[min(k, len(d) - 1)] + slack)
                    kept = np.arange(len(ids)) if repeated else kept
                    kept = kept[ids[kept] != query]
                    exact = distances(x[kept], q[i])
                    best = np.lexsort((ids[kept], exact))
                    if repeated:  # an id counts once, at its smallest distance
                        best = best[np.sort(np.unique(ids[kept][best], return_index=True)[1])]
                    best = best[:k]
                    found.append((np.full(len(best), query), ids[kept][best], exact[best]))
        parts = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=t) for i, t in enumerate((np.int64, np.int64, np.float64))]
        return pd.DataFrame({"query_id": parts[0], "vec_id": parts[1], "score": parts[2]})

    return search


def knn(vectors: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, sample: int = SAMPLE, recall: float = RECALL, seed: int = 1) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that `is_query` (SQL over id) names, its k nearest other rows found, by Euclidean distance.

    Ties go to the smaller id; queries with fewer candidates get them all. Vectors that are null, zero, or hold null or
    non-finite components take no part. Vectors of different lengths have no distance, so each length is searched by itself. Rows that repeat an id are one candidate, at its smallest distance;
    as a query such an id has the first of its vectors, in order of length and components.
    Of more than k + 1 equal vectors those with the smallest ids stand for all, which changes no result, as ties go
    to smaller ids. Leaves of any size are cut into blocks. An empty table gives no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    df = cut(usable(vectors, id_col, vector_col), "vectors")
    repeated = not df.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    df = cut(df.distinct(), "distinct-vectors") if repeated else df
    queries = df.where(is_query)
    queries = cut(queries.groupBy("id").agg(F.min(F.struct(F.size("v").alias("d"), "v")).alias("q")).select("id", "q.v") if repeated else queries, "queries")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in df.select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        of = lambda t, d=r["d"]: t.where(F.size("v") == d)
        out = out.unionByName(search_length(of(df), of(queries), k, trees, sample, recall, seed))
    return out


def search_length(df: DataFrame, queries: DataFrame, k: int, trees: int, sample: int, recall: float, seed: int) -> DataFrame:
    """knn for vectors of one length, distinct by id and vector."""
    spark = df.sparkSession
    n_ids = df.select("id").distinct().count()
    x = np.array([r["v"] for r in df.select("v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()], dtype=np.float64)
    rng = np.random.default_rng(seed)
    forest = [Tree(x, LEAF, rng) for _ in range(trees)]
    share = share_needed(forest, x, max(1, -(-k * len(x) // max(n_ids, 1))), recall)
    held = spark.sparkContext.broadcast([vars(t) for t in forest])
    # of many equal vectors, the first k + 1
    rows = df.withColumn("nth", F.expr("row_number() over (partition by v order by id)")).where(F.col("nth") <= k + 1).select("id", "v")

    def homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = [Tree.known(t) for t in held.value]
        for pdf in batches:
            if len(pdf):
                found = np.stack([t.leaf_of(matrix(pdf["v"])) for t in forest], axis=1)
                yield pdf.assign(leaf=list(found))

    kind = dict(df.dtypes)["v"]
    placed = cut(rows.mapInPandas(homes, f"id long, v {kind}, leaf array<int>"), "placed")
    placed = placed.select("id", "v", F.posexplode("leaf").alias("tree", "leaf"))
    sizes = cut(placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")), "leaf-sizes")
    counts = {(r["tree"], r["leaf"]): r["n"] for r in sizes.collect()}  # at most trees * sample / LEAF * 2 leaves
    total = sum(counts.values()) / trees
    known = spark.sparkContext.broadcast(counts)
    blocks = F.ceil(F.col("n") / float(BLOCK)).cast("int")
    stored = placed.join(F.broadcast(sizes), ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).select("id", "v", "tree", "leaf", "block")
    group = ["tree", "leaf", "block"]
    wanted, part, results = min(k, n_ids - 1), share, []
    while True:

        def asks(batches: Iterator[pd.DataFrame], part: float = part) -> Iterator[pd.DataFrame]:
            forest = [Tree.known(t) for t in held.value]
            for pdf in batches:
                out = []
                for i, v in zip(pdf["id"], pdf["v"], strict=True):
                    met = 0
                    for n, leaf in leaves_for(forest, np.asarray(v, dtype=np.float64)):
                        size = known.value.get((n, leaf), 0)
                        out += [(i, v, n, leaf, b) for b in range(-(-size // BLOCK))]
                        met += size
                        if met >= part * total and met > k:
                            break
                yield pd.DataFrame(out, columns=["id", "v", "tree", "leaf", "block"])

        asked = queries.mapInPandas(asks, f"id long, v {kind}, tree int, leaf int, block int")
        found = stored.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(nearest(k), "query_id long, vec_id long, score double")
        best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)"))
        best = cut(best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "neighbours")
        enough = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= wanted).select(F.col("query_id").alias("id"))
        left = cut(queries.join(enough, "id", "left_anti"), "short-queries")
        if part >= trees or left.isEmpty():
            results.append(best)
            break
        results.append(best.join(left.select(F.col("id").alias("query_id")), "query_id", "left_anti"))
        queries, part = left, max(part * 4, 1e-3)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(table(spark, sf_dir, "embeddings"), "id % 100 = 0")
