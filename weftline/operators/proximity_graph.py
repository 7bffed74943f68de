"""A layered proximity graph over vectors, built a shard at a time, kept as a table and searched by beam.

Rows are dealt to shards by a hash. In a shard each row has a random highest level, every level thinner than the one below by a constant factor. On
every level a row is linked with near rows in different directions: a neighbour is kept if no kept one is nearer to it than the row is. A search
starts at the top, goes greedily down, and on the lowest level keeps a beam of the best rows seen, until none of them has unseen neighbours. What the
shards find is merged. The rows that a search meets in a shard grow with the beam and hardly with the shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import cut
from .similarity_join import matrix, squared

#: Rows of a shard on average, links of a row (twice as many on the lowest level), the beam of a search.
SHARD_ROWS, LINKS, BEAM = 50_000, 16, 64
#: Rows up to which the nearest of a level are found by comparing all; beyond, in the leaves of random trees.
ALL_PAIRS, TREES, LEAF = 2048, 8, 200
#: Queries that one task of a shard answers.
QUERIES = 4096
#: Queries of a task that are held against its rows at once.
TILE = 64


def leaves(x: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Row numbers of the leaves of one random tree: cuts at the median along a direction between two rows."""
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            yield rows
            continue
        a, b = rng.choice(rows, 2, replace=False)
        along = x[rows] @ (x[a] - x[b])
        over = np.argsort(along, kind="stable")
        todo += [rows[over[: len(rows) // 2]], rows[over[len(rows) // 2 :]]]


def near_rows(x: np.ndarray, most: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of about the `most` nearest other rows of each, nearest first; -1 and inf where there are fewer."""
    n = len(x)
    best, far = np.full((n, most), -1), np.full((n, most), np.inf)
    groups = [np.arange(n)] if n <= ALL_PAIRS else (g for _ in range(TREES) for g in leaves(x, rng))
    for rows in groups:
        d = squared(x[rows], x[rows])
        np.fill_diagonal(d, np.inf)
        take = min(most, len(rows) - 1)
        if take < 1:
            continue
        near = np.argpartition(d, take - 1, axis=1)[:, :take]
        merged_rows = np.concatenate([best[rows], rows[near]], axis=1)
        merged = np.concatenate([far[rows], np.take_along_axis(d, near, axis=1)], axis=1)
        order = np.lexsort((merged_rows, merged), axis=1)
        merged_rows, merged = np.take_along_axis(merged_rows, order, axis=1), np.take_along_axis(merged, order, axis=1)
        again = np.zeros(merged.shape, dtype=bool)  # one row found twice has one distance, so its entries are neighbours
        again[:, 1:] = (merged_rows[:, 1:] == merged_rows[:, :-1]) & (merged_rows[:, 1:] >= 0)
        merged[again], merged_rows[again] = np.inf, -1
        order = np.argsort(merged, axis=1, kind="stable")[:, :most]
        best[rows], far[rows] = np.take_along_axis(merged_rows, order, axis=1), np.take_along_axis(merged, order, axis=1)
    return best, far


def spread_links(x: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Links of each row with near rows in different directions, both ways, and with a few random ones, which join parts that have no near rows in common."""
    n = len(x)
    near, far = near_rows(x, min(2 * most, max(n - 1, 1)), rng)
    kept = np.zeros(near.shape, dtype=bool)
    for at in range(0, n, 512):
        rows, d = near[at : at + 512], far[at : at + 512]
        v = x[rows]
        apart = np.maximum((v * v).sum(2)[:, :, None] + (v * v).sum(2)[:, None] - 2 * v @ v.transpose(0, 2, 1), 0)
        mine = kept[at : at + 512]
        for k in range(rows.shape[1]):
            mine[:, k] = (rows[:, k] >= 0) & (mine.sum(1) < most) & ~(mine & (apart[:, k] < d[:, k, None])).any(1)
    a, k = np.nonzero(kept)
    b, d = near[a, k], far[a, k]
    ends, other, away = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
    order = np.lexsort((other, away, ends))
    out = np.split(other[order], np.searchsorted(ends[order], np.arange(1, n)))
    chance = rng.integers(0, n, (n, max(1, most // 8)))
    return [pd.unique(np.concatenate([o[: 2 * most], c])) for o, c in zip(out, chance, strict=True)]


def shard_graph(seed: int, links: int):
    """For applyInPandas: the rows of a shard, highest level first, with their links on each of their levels."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        rng = np.random.default_rng((seed, int(key[0])))
        level = np.floor(-np.log(rng.random(len(pdf))) / np.log(links)).astype(int)
        pdf = pdf.iloc[np.argsort(-level, kind="stable")].reset_index(drop=True)
        level = np.sort(level)[::-1]
        x, held = matrix(pdf["v"]), [[] for _ in range(len(pdf))]
        for at in range(level[0] + 1):
            n = int((level >= at).sum())
            for row, to in enumerate(spread_links(x[:n], links if at else 2 * links, rng)):
                held[row].append(to.astype(np.int32))
        return pdf.assign(node=np.arange(len(pdf)), links=held)[["shard", "node", "id", "v", "links"]]

    return run


def beam_search(x: np.ndarray, links: list, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, squared distances, rows met): the best rows that a search of a shard from its first row finds, nearest first."""
    seen = np.zeros(len(x), dtype=bool)
    best, away = np.array([0]), ((x[:1] - q) ** 2).sum(1)
    seen[0], met = True, 1
    for level in range(len(links[0]) - 1, -1, -1):
        width = beam if level == 0 else max(1, beam // 4)
        open_ = np.ones(len(best), dtype=bool)
        seen[:] = False
        seen[best] = True
        while open_.any():
            turn = np.flatnonzero(open_)[:8]
            open_[turn] = False
            new = np.unique(np.concatenate([links[r][level] for r in best[turn]]))
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            met += len(new)
            d = ((x[new] - q) ** 2).sum(1)
            best, away, open_ = np.concatenate([best, new]), np.concatenate([away, d]), np.concatenate([open_, np.ones(len(new), dtype=bool)])
            order = np.argsort(away, kind="stable")[:width]
            best, away, open_ = best[order], away[order], open_[order]
    return best, away, met


def build_index(df: DataFrame, id_col: str, vector: str, shard_rows: int = SHARD_ROWS, links: int = LINKS, seed: int = 1, path: str | None = None) -> DataFrame:
    """index(shard, node, id, v, links) of the rows whose vector is not null, as a table (at `path`, where that is given)."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    shards = max(1, -(-rows.count() // shard_rows))
    kind = dict(rows.dtypes)["id"]
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    index = dealt.groupBy("shard").applyInPandas(shard_graph(seed, links), f"shard int, node int, id {kind}, v array<double>, links array<array<int>>")
    if path is None:
        return cut(index, "proximity-graph")
    index.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """(query_id, id, distance, rank, met) for queries(query_id, q): the k rows nearest to each that are found, by Euclidean distance, ties to the smaller id; met is how many rows were looked at.

    Queries go to every shard in blocks, so a task has one shard and a bounded number of them.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(index.dtypes)["id"]
    asked = cut(queries.where("q IS NOT NULL").select("query_id", F.col("q").cast("array<double>").alias("q")), "queries")
    parts = max(1, -(-asked.count() // QUERIES))
    last = index.agg(F.max("shard")).first()[0] or 0
    each = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    told = each.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))  # every shard answers every query
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(rows: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "distance": [], "met": []})]
        if len(rows) and len(some):
            rows = rows.sort_values("node", ignore_index=True)
            x, links, ids = matrix(rows["v"]), rows["links"].tolist(), rows["id"].to_numpy()
            for name, q in zip(some["query_id"], some["q"], strict=True):
                best, away, met = beam_search(x, links, np.asarray(q, dtype=float), max(beam, k))
                best = best[np.lexsort((ids[best], away))]
                exact = np.sqrt(((x[best[:k]] - np.asarray(q, dtype=float)) ** 2).sum(1))
                out.append(pd.DataFrame({"query_id": name, "id": ids[best[:k]], "distance": exact, "met": [met] + [0] * (len(exact) - 1)}))
        return pd.concat(out[1:] or out, ignore_index=True)

    found = held.groupBy("shard", "part").cogroup(told.groupBy("shard", "part")).applyInPandas(run, f"query_id {kinds[0]}, id {kinds[1]}, distance double, met long")
    found = cut(found, "shard-answers")
    each = W.partitionBy("query_id")
    ranked = found.withColumn("met", F.sum("met").over(each)).withColumn("rank", F.row_number().over(each.orderBy("distance", "id")).cast("long"))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "distance", "rank", "met")


def confirm_nearest(index: DataFrame, queries: DataFrame, found: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, distance, rank): the k rows of the index nearest to each of queries(query_id, q), none missed, ties to the smaller id.

    found is what search_index says of them. No row beyond the k-th that was found can count, so every row is held against that distance alone: blocks of rows meet
    blocks of queries, a matrix product a task, and only what is within reach is measured and ranked.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(index.dtypes)["id"]
    reach = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("reach"))
    asked = queries.where("q IS NOT NULL").select("query_id", F.col("q").cast("array<double>").alias("q"))
    asked = cut(asked.join(reach, "query_id", "left"), "queries-in-reach")
    rows = index.select("id", "v")
    parts, blocks = max(1, -(-asked.count() // QUERIES)), max(1, -(-rows.count() // SHARD_ROWS))
    told = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "distance": []})]
        if len(left) and len(right):
            x, ids = matrix(left["v"]), left["id"].to_numpy()
            longest = (x * x).sum(1).max()
            for at in range(0, len(right), TILE):
                some = right.iloc[at : at + TILE]
                q, names, most = matrix(some["q"]), some["query_id"].to_numpy(), some["reach"].to_numpy(float)
                most = np.where(np.isnan(most), np.inf, most)
                # what rounding can add to squares of distances
                slack = 1e-12 * ((q * q).sum(1) + longest + 1)
                d = squared(q, x)
                if k < len(x):  # nor can a row count that k of this block are nearer than
                    most = np.minimum(most, np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1] + slack))
                a, b = np.nonzero(d <= (most * most + slack)[:, None])
                for piece in range(0, len(a), 1 << 17):
                    r, c = a[piece : piece + (1 << 17)], b[piece : piece + (1 << 17)]
                    out.append(pd.DataFrame({"query_id": names[r], "id": ids[c], "distance": np.sqrt(((x[c] - q[r]) ** 2).sum(1))}))
        return pd.concat(out[1:] or out, ignore_index=True)

    near = held.groupBy("block", "part").cogroup(told.groupBy("block", "part")).applyInPandas(run, f"query_id {kinds[0]}, id {kinds[1]}, distance double")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id")).cast("long"))
    return ranked.where(F.col("rank") <= k)
