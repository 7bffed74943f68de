"""Similarity of vectors: threshold joins, top-k, prefix neighbours, rankings, PCA and clustering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.tables import cut
from .sequences import with_row_index
from .similarity_join import TILE, block_rows, threshold_pairs
from .ward import ward_clusters

#: Rows of a block of the block-wise comparison of all rows.
BLOCK = 2048
#: Blocks of earlier rows that a task lets pass by a block of late ones.
STRETCH = 4


def unit_rows(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), V.unit(F.col(vector)).alias("v"))


def similar_pairs(df: DataFrame, id_col: str, vector: str, threshold: float, k: int | None = None, strict: bool = False, normalise: bool = True) -> DataFrame:
    """(i, j, sim), i <> j: rows at least `threshold` alike, among the k nearest of i (itself counted) if k is given.

    Rows meet only those in cells within reach of the threshold (see similarity_join), which gives both directions. With k, a task puts out no more than the k nearest of each row (and ties).
    """
    rows = unit_rows(df, id_col, vector) if normalise else df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    pairs = threshold_pairs(cut(rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c))), "unit"), threshold, k, strict)
    if k is not None:  # rows under the threshold rank behind, so they change no rank that counts
        pairs = pairs.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.desc("sim"), (F.col("i") != F.col("j")), "j"))).where(F.col("r") <= k).drop("r")
    return pairs.where("i <> j")


def top_similar(df: DataFrame, query: list[float], id_col: str, vector: str, k: int = 10, least: float | None = 0.6, normalise: bool = True) -> DataFrame:
    """The k rows most like a query vector, of those at least `least` alike, with sim."""
    q = F.array(*[F.lit(float(x)) for x in query])
    sim = V.cosine(F.col(vector).cast("array<double>"), q) if normalise else V.dot(F.col(vector), q)
    out = df.withColumn("sim", sim).where(F.col("sim").isNotNull()).orderBy(F.desc("sim"), id_col).limit(k)
    return out if least is None else out.where(F.col("sim") >= least)


def nearest_earlier(rows: DataFrame, k: int, above: float, size: int | None = None) -> DataFrame:
    """(id, ord, prev, prev_ord, sim): of the earlier rows more than `above` alike, the k most alike (ties to earlier ones) of each of rows(id, v, ord), a table numbered from 1.

    A task holds a block of late rows and lets STRETCH blocks of earlier ones pass by in order, so a row travels once to each later block; blocks are a share of the table, up to a fixed size. Rounded products
    only choose what is measured; that is added up from the first component on. Of equal rows the first k can be neighbours, no others. Rows with components that are null or not finite have none.
    """
    (kind,), n = [t for c, t in rows.dtypes if c == "id"], rows.count()
    size = size or block_rows(n)
    blocks = max(1, -(-n // size))
    block = F.floor((F.col("ord") - 1) / size).cast("int")
    whole = rows.where(F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))).withColumn("block", block)
    late = whole.select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.floor(F.col("block") / STRETCH).cast("int"))).alias("s"), F.lit(0).alias("early"), "ord", "id", "v")
    first = whole.withColumn("copy", F.row_number().over(W.partitionBy("v").orderBy("ord"))).where(F.col("copy") <= k)
    early = first.select(F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("a"), F.floor(F.col("block") / STRETCH).cast("int").alias("s"), F.lit(1).alias("early"), "ord", "id", "v")
    tasks = sum(x // STRETCH + 1 for x in range(blocks))

    def best(found: list[tuple]) -> tuple:
        who, ord_, prev, sim = (np.concatenate(t) for t in zip(*found, strict=True))
        order = np.lexsort((ord_, -sim, who))
        w = who[order]
        order = order[np.arange(len(w)) - np.searchsorted(w, w) < k]
        return who[order], ord_[order], prev[order], sim[order]

    def compare(parts: Iterator[tuple]) -> pa.RecordBatch | None:
        """parts: (early, ords, ids, vectors) of one block, the late ones first."""
        x, least, ords, ids, found, new = None, None, [], [], [], 0
        for is_early, ord_, id_, v in parts:
            if not is_early:
                x = v if x is None else np.concatenate([x, v])
                ords.append(ord_)
                ids.append(id_)
                continue
            if x is None:
                continue
            if least is None:
                ords, ids, least = [np.concatenate(ords)], [np.concatenate(ids)], np.full(len(x), above - 1e-9)
            for at in range(0, len(x), TILE):
                mine, own = ords[0][at : at + TILE], x[at : at + TILE]
                if mine[-1] <= ord_[0]:
                    continue
                for on in range(0, len(v), TILE):
                    theirs, other = ord_[on : on + TILE], v[on : on + TILE]
                    sim = own @ other.T
                    if theirs[-1] >= mine[0]:
                        sim[theirs[None] >= mine[:, None]] = -np.inf
                    ok = sim > least[at : at + TILE, None]
                    if k < len(other) and np.count_nonzero(ok) > 4 * k * len(own):
                        ok &= sim >= np.partition(sim, -k, axis=1)[:, -k, None] - 1e-9
                    p, q = np.divmod(np.flatnonzero(ok), len(other))
                    for cut_ in range(0, len(p), 1 << 16):
                        i, j = p[cut_ : cut_ + (1 << 16)], q[cut_ : cut_ + (1 << 16)]
                        exact = np.cumsum(own[i] * other[j], axis=1)[:, -1]
                        fine = (exact > above) & np.isfinite(exact)
                        found.append((i[fine] + at, theirs[j[fine]], id_[on:][j[fine]], exact[fine]))
                        new += int(fine.sum())
            if new > 4 * len(x):
                found, new = [best(found)], 0
                who, at, many = np.unique(found[0][0], return_index=True, return_counts=True)
                full = many == k
                least[who[full]] = found[0][3][at[full] + k - 1] - 1e-9
        if not found:
            return None
        who, prev_ord, prev, sim = best(found)
        return pa.RecordBatch.from_arrays([pa.array(ids[0][who]), pa.array(ords[0][who]), pa.array(prev), pa.array(prev_ord), pa.array(sim)], ["id", "ord", "prev", "prev_ord", "sim"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            a, s, early_, ord_, id_ = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            v = batch.column(5).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(a), -1)
            ends = np.flatnonzero((np.diff(a) != 0) | (np.diff(s) != 0) | (np.diff(early_) != 0)) + 1
            for i, j in zip([0, *ends], [*ends, len(a)], strict=True):
                if j > i:
                    yield (a[i], s[i]), (early_[i] == 1, ord_[i:j], id_[i:j], v[i:j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groupby(pieces(batches), key=lambda p: p[0]):
            if (out := compare(p[1] for p in parts)) is not None:
                yield out

    dealt = late.unionByName(early).repartition(min(4 * tasks, 4096), "a", "s").sortWithinPartitions("a", "s", "early", "ord")
    pairs = dealt.mapInArrow(run, f"id {kind}, ord long, prev {kind}, prev_ord long, sim double")
    return pairs.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("sim"), "prev_ord"))).where(F.col("r") <= k).drop("r")


def prefix_neighbours(df: DataFrame, id_col: str, vector: str, order: list[str], k: int = 20, above: float = 0.7) -> DataFrame:
    """(id, prev, sim): for each row the earlier rows among its k nearest earlier ones that are more than `above` alike, and of the latest earlier ones so many as
    make k with those, at sim 0 where they were not there already."""
    kept = F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    named = df.select(F.col(id_col).alias("id"), kept.alias("v"), *[F.col(c).alias(f"_o{n}") for n, c in enumerate(order)])
    rows = cut(with_row_index(named, *[f"_o{n}" for n in range(len(order))], "id", name="ord").select("id", "v", (F.col("ord") + 1).alias("ord")), "ordered")
    near = cut(nearest_earlier(rows, k, above), "prefix-near")
    missing = rows.join(near.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", "ord", (F.lit(k) - F.coalesce("n", F.lit(0))).alias("need"))
    latest = missing.where("need > 0 AND ord > 1").withColumn("prev_ord", F.explode(F.sequence(F.greatest(F.lit(1), F.col("ord") - F.col("need")), F.col("ord") - 1)))
    fill = latest.join(rows.select(F.col("id").alias("prev"), F.col("ord").cast("long").alias("prev_ord")), "prev_ord").join(near.select("id", "prev"), ["id", "prev"], "left_anti")
    return near.select("id", "prev", "sim").unionByName(fill.select("id", "prev", F.lit(0.0).alias("sim")))


def pooled_rank(df: DataFrame, queries: DataFrame, id_col: str, vector: str, group: str, query_vector: str, k: int | None = 30, floor: float = 0.0, least: float | None = None) -> DataFrame:
    """(group, id, sim, rank): rows ranked for each group of query vectors by the largest product with any of them, at least `floor`; those at least `least` alike.

    Blocks of rows meet blocks of queries, a matrix product a task. A task puts out the k best of each group that it saw, which hold the k best of all.
    """
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")), "pool-rows")
    asked = cut(queries.select(F.col(group).alias("g"), F.col(query_vector).cast("array<double>").alias("q")), "pool-queries")
    n, m = (max(1, -(-t.count() // BLOCK)) for t in (rows, asked))
    a = rows.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    b = asked.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(m)).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    kinds = dict(rows.dtypes)["id"], dict(asked.dtypes)["g"]

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"g": [], "id": [], "sim": []})]
        if len(left) and len(right):
            v, ids = np.stack(left["v"].to_numpy()), left["id"].to_numpy()
            for g, part in right.groupby("g", dropna=False):
                best = np.maximum((v @ np.stack(part["q"].to_numpy()).T).max(axis=1), floor)
                found = pd.DataFrame({"g": g, "id": ids, "sim": best})
                found = found if least is None else found[found["sim"] >= least]
                out.append(found if k is None else found.sort_values(["sim", "id"], ascending=[False, True]).head(k))
        return pd.concat(out[1:] or out, ignore_index=True)

    scored = a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInPandas(compare, f"g {kinds[1]}, id {kinds[0]}, sim double").groupBy("g", "id").agg(F.max("sim").alias("sim"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("g").orderBy(F.desc("sim"), "id")).cast("long"))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)).withColumnRenamed("g", group)


def ranked_rows(df: DataFrame, query: list[float], id_col: str, vector: str, k: int = 20, least: float | None = 0.7, skip: int = 1) -> DataFrame:
    """Rows at least `least` alike (all without it), best first, without the first `skip`."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("sim", V.dot(F.col(vector), q))
    scored = scored if least is None else scored.where(F.col("sim") >= least)
    return scored.orderBy(F.desc("sim"), id_col).offset(skip).limit(k)


def fit_pca(df: DataFrame, vector: str, k: int):
    """(scaler, pca): centring and principal components of the table, which can be saved and applied to other rows."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
    scaler = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(rows)
    return scaler, PCA(k=k, inputCol="centred", outputCol="reduced").fit(scaler.transform(rows))


def apply_pca(df: DataFrame, models, vector: str, size: int, name: str = "reduced_embedding") -> DataFrame:
    """The components of rows, with zeros up to `size`."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scaler, pca = models
    out = pca.transform(scaler.transform(df.withColumn("raw", array_to_vector(F.col(vector).cast("array<double>")))))
    return out.withColumn(name, V.padded(vector_to_array("reduced"), size)).drop("raw", "centred", "reduced")


def cluster(df: DataFrame, id_col: str, vector: str, clusters: int = 20) -> DataFrame:
    """(id, cluster_label) by Ward's method. Work grows with the square of the rows, memory of a task does not."""
    return ward_clusters(df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")), clusters)


def compression_ratio(text: Column) -> Column:
    """Bytes of a text over those of its gzip form."""

    @F.udf("double", useArrow=False)  # a hundred texts at a time, where an Arrow batch would be of thousands, of any length
    def ratio(said: str | None) -> float | None:
        import gzip

        data = said.encode() if said else b""
        return len(data) / len(gzip.compress(data, mtime=0)) if data else None

    return ratio(text)


def lsh_pairs(df: DataFrame, id_col: str, vector: str, distance: float, width: float = 0.5, tables: int = 4) -> DataFrame:
    """Pairs within a Euclidean distance through Spark's bucketed random projections: an approximate index."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = df.select(F.col(id_col).alias("id"), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=1).fit(rows)
    return model.approxSimilarityJoin(rows, rows, distance, "distance").select(F.col("datasetA.id").alias("i"), F.col("datasetB.id").alias("j"), "distance").where("i < j")


