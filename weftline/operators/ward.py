"""Ward's agglomeration in rounds, over cluster features instead of rows.

Equal rows merge first. Then all pairs of clusters that are each other's nearest merge together: Ward's distance is reducible, so a merged cluster is no
nearer to a third one than the nearer of its parts was, and this order gives the same tree as merging the single closest pair again and again.

A search finds a few nearest clusters of each one, and a bound that all others reach. Once a neighbour is merged, the formula of Lance and Williams bounds
the distance to what it became from distances that are known, so the next neighbour on the list is the nearest as long as it lies within the bound, and
merging goes on without a search. Only merged clusters and those whose list can't tell any more search again, in blocks of clusters, a block pair a task.
Once few enough are left, one task ends the tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import cut
from .graph import components
from .similarity_join import matrix

#: Most clusters of a block of the search for neighbours, blocks of a table where they hold so few, the least of these, and clusters that one task merges to the end.
BLOCK, GRID, SMALL, LAST = 65_536, 4, 4096, 16_384
#: Rows and columns of a product (2 MB in single precision), and groups of columns of which the nearest are compared.
TILE, WIDE, GROUPS = 128, 4096, 64
#: Pairs that are measured at once.
PAIRS = 1 << 16
#: Neighbours that a search is to find of a cluster, and what a block gives at least, as the block that gives out first bounds the list.
NEAR, OF_BLOCK = 8, 3
#: A search follows once fewer than one in so many of the clusters of a round merge on what is known.
FEW = 32


def rise(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1) * (na * nb / (na + nb))


def merge_all(centres: np.ndarray, sizes: np.ndarray) -> list[tuple[float, int, int]]:
    """(height, a, b) of all merges of clusters, by chains of nearest neighbours; of a merge the smaller number stays.

    One product a step finds what is near, the differences decide; whenever half of the clusters are gone, the rest move together.
    """
    centre, size = centres.astype(float) - centres.mean(0), sizes.astype(float).copy()
    square, alive, name = (centre * centre).sum(1), np.ones(len(sizes), dtype=bool), np.arange(len(sizes))
    merges, chain = [], []
    for left in range(len(sizes), 1, -1):
        if 2 * left <= len(alive) and len(alive) > 64:
            kept = np.flatnonzero(alive)
            chain = np.searchsorted(kept, chain).tolist()
            centre, size, square, alive, name = centre[kept], size[kept], square[kept], alive[kept], name[kept]
        if not chain:
            chain = [int(alive.argmax())]
        while True:
            a = chain[-1]
            d = np.maximum(square + square[a] - 2 * (centre @ centre[a]), 0) * (size * size[a] / (size + size[a]))
            d[~alive] = np.inf
            d[a] = np.inf
            near = np.flatnonzero(d <= d.min() + 1e-9 * (1 + d.min()))
            exact = rise(centre[near], size[near], centre[a], size[a])
            b, height = int(near[exact.argmin()]), float(exact.min())
            if len(chain) > 1 and (back := float(rise(centre[chain[-2]], size[chain[-2]], centre[a], size[a]))) <= height:
                b, height = chain[-2], back
                break
            chain.append(b)
        chain = chain[:-2]
        lo, hi = min(a, b), max(a, b)
        merges.append((height, int(name[lo]), int(name[hi])))
        centre[lo] = (centre[lo] * size[lo] + centre[hi] * size[hi]) / (size[lo] + size[hi])
        square[lo] = (centre[lo] ** 2).sum()
        size[lo] += size[hi]
        alive[hi] = False
    return merges


def block_size(n: int) -> int:
    """Clusters of a block of n: a GRID-th of them, so a cluster travels GRID times whatever n is, until blocks would outgrow a task."""
    return min(BLOCK, max(SMALL, -(-n // GRID)))


def close_pairs(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, same: np.ndarray, kind: type, most: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y) that can be among the `most` nearest, as far as products in numbers of this kind can tell: all of these are there. same: a row's own place in y, or -1.

    Products have two more columns, so they are squared distances; of groups of columns the least bound what is met, and the bound falls as tiles pass by.
    """
    n, xx, yy = len(y), (x * x).sum(1), (y * y).sum(1)
    wide = min(WIDE, -(-n // GROUPS) * GROUPS)
    slack = 4 * (x.shape[1] + 8) * np.finfo(kind).eps * (np.sqrt(xx) + np.sqrt(yy.max())) ** 2
    right = np.zeros((-(-n // wide) * wide, x.shape[1] + 2), dtype=kind)
    right[:n, :-2], right[:, -2], right[:n, -1], right[n:, -1] = -2 * y, 1, yy, np.inf
    size = np.ones(len(right), dtype=kind)
    size[:n] = ny
    left = np.hstack([x, xx[:, None], np.ones((len(x), 1))]).astype(kind)
    rows, places = [], []
    for at in range(0, len(x), TILE):
        g, own, sizes, s = left[at : at + TILE], same[at : at + TILE], nx[at : at + TILE].astype(kind), slack[at : at + TILE, None]
        least, met = np.full((len(g), most), np.inf, dtype=kind), []
        for c in range(0, len(right), wide):
            d = g @ right[c : c + wide].T
            some = size[c : c + wide]
            if (some != ny[0]).any():
                d *= some / (sizes[0] + some) if (sizes == sizes[0]).all() else some / (sizes[:, None] + some)
            else:
                d *= (some[0] / (sizes + some[0]))[:, None]
            here = np.flatnonzero((own >= c) & (own < c + wide))
            d[here, own[here] - c] = np.inf
            least = np.partition(np.hstack([least, d.reshape(len(g), -1, GROUPS).min(1)]), most - 1, axis=1)[:, :most]
            bound = least.max(1)[:, None].astype(float) + 2 * s
            # a bound is rounded up to this kind
            r, k = np.divmod(np.flatnonzero(d <= np.nextafter(bound.astype(kind), kind(np.inf))), d.shape[1])
            met.append((r, k + c, d[r, k]))
        r, k, d = (np.concatenate(t) for t in zip(*met, strict=True))
        kept = (d <= np.nextafter(bound.astype(kind), kind(np.inf))[r, 0]) & (k < n) & (own[r] != k)
        rows.append(r[kept] + at)
        places.append(k[kept])
    return tuple(np.concatenate(t) if t else np.zeros(0, dtype=np.int64) for t in (rows, places))


def nearest(asking: DataFrame, clusters: DataFrame, kind: str) -> DataFrame:
    """(id, n, l, bound): the nearest other clusters (d, lo, hi, to, nt) of each of asking(id, n, c), nearest first and of equals the pair with the smaller ids; no other is nearer than the bound."""
    few, count = asking.count(), clusters.count()
    many, all_ = -(-few // block_size(few)), -(-count // min(block_size(count), max(SMALL, -(-count // (4 * GRID)))))
    tasks, most = min(2 * many * all_, 4096), max(OF_BLOCK, -(-2 * NEAR // all_))
    a = asking.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(all_ - 1)))).repartition(tasks, "a", "b")
    b = clusters.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(all_)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).repartition(tasks, "a", "b")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "n": [], "to": [], "nt": [], "d": [], "last": []})]
        if len(left) and len(right):
            left = left.sort_values(["n", "id"], ignore_index=True)
            y, ny, to = matrix(right["c"]), right["n"].to_numpy(), right["id"].to_numpy()
            middle, by_id = y.mean(0), np.argsort(to, kind="stable")
            x_all, n_all, id_all = matrix(left["c"]), left["n"].to_numpy(), left["id"].to_numpy()
            for at in range(0, len(left), 16 * TILE):
                x, nx, ids = x_all[at : at + 16 * TILE], n_all[at : at + 16 * TILE], id_all[at : at + 16 * TILE]
                place = by_id[np.minimum(np.searchsorted(to, ids, sorter=by_id), len(to) - 1)]
                same = np.where(to[place] == ids, place, -1)
                r, k = close_pairs(x - middle, nx, y - middle, ny, same, np.float32, most)
                if len(r) > 16 * most * len(ids):
                    r, k = close_pairs(x - middle, nx, y - middle, ny, same, np.float64, most)
                # what rounding can't tell apart is measured again, from the differences
                d = np.concatenate([np.zeros(0), *[rise(x[r[s : s + PAIRS]], nx[r[s : s + PAIRS]].astype(float), y[k[s : s + PAIRS]], ny[k[s : s + PAIRS]].astype(float)) for s in range(0, len(r), PAIRS)]])
                order = np.lexsort((np.maximum(ids[r], to[k]), np.minimum(ids[r], to[k]), d, r))
                r, k, d = r[order], k[order], d[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                r, k, d, rank = (t[rank < most] for t in (r, k, d, rank))
                out.append(pd.DataFrame({"id": ids[r], "n": nx[r], "to": to[k], "nt": ny[k], "d": d, "last": rank == most - 1}))
        return pd.concat(out[1:] or out, ignore_index=True)

    met = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(search, f"id {kind}, n long, to {kind}, nt long, d double, last boolean")
    one = F.struct("d", F.least("id", "to").alias("lo"), F.greatest("id", "to").alias("hi"), "to", "nt")
    # what a block left out comes after the last that it gave
    found = met.groupBy("id", "n").agg(F.array_sort(F.collect_list(one)).alias("l"), F.min(F.when(F.col("last"), one)).alias("end"))
    return found.select("id", "n", F.filter("l", lambda e: F.col("end").isNull() | (e <= F.col("end"))).alias("l"), F.coalesce("end.d", F.lit(float("inf"))).alias("bound"))


def both_ends(pairs: DataFrame) -> DataFrame:
    """(id, new, mate, nm, dm) of each cluster of pairs(a, b, d, na, nb)."""
    end = lambda x, y: pairs.select(F.col(x).alias("id"), F.col("a").alias("new"), F.col(y).alias("mate"), F.col(f"n{y}").alias("nm"), F.col("d").alias("dm"))
    return end("a", "b").unionByName(end("b", "a"))


def after_merges(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """lists(id, n, l, bound) of the clusters that no pair has, without those of pairs in l; bounds hold for what they became as well. A list that can't tell the nearest any more is left out."""
    ends = both_ends(pairs)
    old = lists.join(ends.select("id"), "id", "left_anti").select("id", "n", "bound", F.explode("l").alias("e")).select("id", "n", "bound", "e.*")
    known = old.join(ends.select(F.col("id").alias("to"), "mate", "nm", "dm"), "to", "left")
    rows = known.groupBy("id", "n", "bound").agg(F.collect_list(F.struct("d", "lo", "hi", "to", "nt", "mate", "nm", "dm")).alias("p"))

    def risen(e):
        other = F.coalesce(F.get(F.filter("p", lambda o: o["to"] == e["mate"]), F.lit(0))["d"], F.col("bound"))
        return ((F.col("n") + e["nt"]) * e["d"] + (F.col("n") + e["nm"]) * other - F.col("n") * e["dm"]) / (F.col("n") + e["nt"] + e["nm"]) * (1 - 1e-9)

    out = rows.withColumn("bound", F.least("bound", F.array_min(F.transform(F.filter("p", lambda e: e["mate"].isNotNull()), risen))))
    live = F.filter("p", lambda e: e["mate"].isNull() & (e["d"] <= F.col("bound")))
    return out.select("id", "n", F.array_sort(F.transform(live, lambda e: F.struct(*[e[c].alias(c) for c in ("d", "lo", "hi", "to", "nt")]))).alias("l"), "bound").where(F.size("l") > 0)


def ward_merges(rows: DataFrame) -> DataFrame:
    """(a, b, d): all merges of rows(id, v), a table of distinct ids; a cluster goes by its smallest id."""
    kind = dict(rows.dtypes)["id"]
    clusters = cut(rows.groupBy(F.col("v").alias("c")).agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "n", "c"), "clusters-0")
    equal = clusters.where("n > 1").select(F.col("id").alias("a"), F.col("c").alias("v"))
    merges = cut(rows.join(equal, "v").where("id <> a").select("a", F.col("id").alias("b"), F.lit(0.0).alias("d")), "equal")
    lists, k = None, 0
    while (left := clusters.count()) > LAST:
        k += 1
        asking = cut(clusters if lists is None else clusters.join(lists, "id", "left_anti"), f"asking-{k}")
        found = nearest(asking, clusters, kind)
        lists = cut(found if lists is None else lists.unionByName(found), f"found-{k}")
        merged, more = None, left
        while more * FEW >= left:
            first = F.col("l")[0]
            near = lists.select("id", first["to"].alias("to"), first["d"].alias("d"), F.col("n").alias("na"), first["nt"].alias("nb"))
            back = near.select(F.col("id").alias("to"), F.col("to").alias("id"))
            pairs = cut(near.join(back, ["id", "to"]).where("id < to").select(F.col("id").alias("a"), F.col("to").alias("b"), "d", "na", "nb"), f"mutual-{k}")
            more = pairs.count()
            if not more and merged is None:  # can only be if rounding breaks ties two ways
                one = F.when(F.col("id") < F.col("to"), F.struct(F.col("id").alias("a"), F.col("to").alias("b"), "na", "nb")).otherwise(F.struct(F.col("to").alias("a"), F.col("id").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))
                pairs, more = cut(near.select(one.alias("p"), "d").select("p.*", "d").orderBy("d", "a", "b").limit(1).select("a", "b", "d", "na", "nb"), f"first-{k}"), 1
            if more:
                merged = pairs if merged is None else merged.unionByName(pairs)
                lists = cut(after_merges(lists, pairs), f"lists-{k}")
        merges = merges.unionByName(merged.select("a", "b", "d"))
        ends = both_ends(merged).select("id", "new")
        joined = clusters.join(ends, "id").groupBy("new").agg(F.collect_list(F.struct("n", "c")).alias("p"))  # two of each
        one, two = F.col("p")[0], F.col("p")[1]
        total = one["n"] + two["n"]
        centre = F.zip_with(one["c"], two["c"], lambda x, y: (x * one["n"] + y * two["n"]) / total)
        clusters = cut(clusters.join(ends, "id", "left_anti").unionByName(joined.select(F.col("new").alias("id"), total.alias("n"), centre.alias("c"))), f"clusters-{k}")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        found = merge_all(matrix(pdf["c"]), pdf["n"].to_numpy())
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({"a": [ids[a] for _, a, _ in found], "b": [ids[b] for _, _, b in found], "d": [d for d, _, _ in found]})

    last = cut(clusters.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(finish, f"a {kind}, b {kind}, d double"), "last-merges")  # at most LAST clusters
    return merges.unionByName(last)


def ward_clusters(rows: DataFrame, clusters: int) -> DataFrame:
    """(id, cluster_label) of rows(id, v): the `clusters` clusters that Ward's method leaves (each row its own if there are no more rows), numbered from 0 by their smallest ids."""
    rows = cut(rows.where(F.col("v").isNotNull()), "ward-rows")
    merges = cut(ward_merges(rows), "merges")
    above = merges.orderBy(F.desc("d"), F.desc("a"), F.desc("b")).limit(max(clusters - 1, 0)).select("a", "b")
    edges = cut(merges.join(above, ["a", "b"], "left_anti").select(F.col("a").alias("src"), F.col("b").alias("dst")), "ward-edges")
    label = rows.select("id").join(components(edges, "ward"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    heads = label.select("component").distinct().withColumn("cluster_label", (F.row_number().over(W.orderBy("component")) - 1).cast("long"))  # one row a cluster
    return label.join(heads, "component").select("id", "cluster_label")
