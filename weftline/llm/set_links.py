"""Links between sets that share a signature, confirmed on the full sets, and the components they make.

Whatever names the buckets (min-max bands, partitions of the feature domain), the rest is the same: stars, then pairs, then blocks of
what a bucket still holds apart. A task holds two blocks, whose size is bounded by members and by features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, cut, enter, join_sized, ship
from .shingles import shingle_sets

ship(__name__)

#: Members and features of a block of a bucket; a task compares two blocks.
BLOCK, BLOCK_FEATURES = 1024, 1 << 19
#: Members outside a bucket's largest component that meet the bucket's others as pairs.
FEW = 16


def full_sets(words: int):
    """Whole shingle sets of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("shingles")
        for batch in batches:
            found = list(shingle_sets(batch.column(1), words))
            flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["id", "members"])

    return run


def linked_in_block(percent: int):
    """For the members of a bucket (or of two blocks of it): links that join different components, until no more can be joined."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sets = pdf["id"].to_numpy(), [np.asarray(x) for x in pdf["members"]]
        size = np.array([len(x) for x in sets])
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        names, code = np.unique(np.concatenate(sets), return_inverse=True)
        _, comp = np.unique(pdf["component"].to_numpy(), return_inverse=True)
        comp = comp.copy()
        largest = np.bincount(comp).argmax()
        mark, src, dst = np.zeros(len(names), dtype=np.int64), [], []
        for p in np.flatnonzero(comp != largest):
            own = code[starts[p] : starts[p] + size[p]]
            mark[own] = 1
            both = np.add.reduceat(mark[code], starts)
            mark[own] = 0
            for q in np.flatnonzero((100 * both >= percent * (size + size[p] - both)) & (comp != comp[p])):
                if comp[q] != comp[p]:
                    comp[comp == comp[q]] = comp[p]
                    src.append(ids[p])
                    dst.append(ids[q])
        return pd.DataFrame({"src": np.array(src, dtype=np.int64), "dst": np.array(dst, dtype=np.int64)})

    return link


def sets_of(rows: DataFrame, ids: DataFrame, words: int, name: str) -> DataFrame:
    """(id, members) of the documents among ids(id), as a table."""
    wanted = cut(ids.distinct(), f"{name}-wanted")
    return cut(join_sized(rows.where("text IS NOT NULL"), wanted, ["id"], "left_semi").mapInArrow(full_sets(words), "id long, members array<long>"), f"{name}-sets")


def confirmed(rows: DataFrame, pairs: DataFrame, percent: int, words: int, name: str) -> DataFrame:
    """Of pairs(a, b), a table, the links (src, dst) whose full sets are alike enough, as a table."""
    sets = sets_of(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")), words, name)
    own = join_sized(sets.select(F.col("id").alias("a"), "members"), pairs, ["a"], "inner")
    both = own.join(sets.select(F.col("id").alias("b"), F.col("members").alias("others")).hint("merge"), "b")
    shared = both.withColumn("both", F.size(F.array_intersect("members", "others"))).withColumn("either", F.size("members") + F.size("others") - F.col("both"))
    return cut(shared.where(f"100 * both >= {percent} * either").select(F.col("a").alias("src"), F.col("b").alias("dst")), f"{name}-links")


def sized(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) whose sizes allow a link, with the columns of sizes for each end."""
    for end in "ab":
        pairs = join_sized(pairs, sizes.select(*[F.col(c).alias(end if c == "id" else f"{c}_{end}") for c in sizes.columns]), [end], "inner")
    return pairs.where(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")


def first_members(named: DataFrame) -> DataFrame:
    """(bucket, id, lo, hi, n) of the first FEW + 1 members, by id, of each bucket of named(bucket, id) that can hold two: all of them where n, at most FEW + 1, is no more than FEW.

    The limit holds in each task before the shuffle too, so a bucket of any size puts no more than that in from a task, and what has a bucket for itself is shuffled once.
    """
    by = W.partitionBy("bucket")
    few = named.select("bucket", "id").withColumn("r", F.row_number().over(by.orderBy("id"))).where(F.col("r") <= FEW + 1)
    few = few.withColumn("lo", F.min("id").over(by)).withColumn("hi", F.max("id").over(by)).withColumn("n", F.count("*").over(by))
    return few.where(f"lo < hi OR n > {FEW}").select("bucket", "id", "lo", "hi", "n").distinct()


def merged_buckets(rest: DataFrame) -> DataFrame:
    """rest(bucket, id, size, component, big), a table, with `merged`: buckets around one largest component `big` are one (named big, each member once) where that compares no more pairs than they do apart.

    Near copies share most of their buckets but seldom all members of one, so their sets would travel once for each bucket.
    """
    pairs = (F.count("*") * F.count_if(F.col("component") != F.col("big")).cast("double")).alias("pairs")
    once = cut(rest.drop("bucket").distinct(), "members-once")
    apart = rest.groupBy("big", "bucket").agg(pairs).groupBy("big").agg(F.sum("pairs").alias("apart"))
    chosen = cut(once.groupBy("big").agg(pairs).join(apart, "big").where("pairs <= apart").select("big"), "merged")
    met = join_sized(once, chosen, ["big"], "inner").select(F.col("big").alias("bucket"), "id", "size", "component", "big", F.lit(True).alias("merged"))
    return met.unionByName(join_sized(rest, chosen, ["big"], "left_anti").withColumn("merged", F.lit(False)))


def in_blocks(rest: DataFrame) -> DataFrame:
    """(bucket, merged, i, j, id, component): members of rest, as merged_buckets gives it, in each pair of blocks of their bucket that a task compares.

    Blocks of the members outside the bucket's largest component meet each other and its blocks; those never meet each other, and as there is one at least, no block need be alone.
    """
    rest = cut(rest.withColumn("inside", F.col("component") == F.col("big")), "members-placed")
    blocks = lambda part: F.greatest(F.ceil(F.count_if(part) / F.lit(float(BLOCK))), F.ceil(F.sum(F.when(part, F.col("size"))) / F.lit(float(BLOCK_FEATURES)))).cast("int")
    counts = cut(rest.groupBy("bucket", "merged").agg(blocks(~F.col("inside")).alias("few"), blocks(F.col("inside")).alias("many")), "block-counts")
    rest = join_sized(rest, counts, ["bucket", "merged"], "inner")
    rest = rest.withColumn("own", F.when(F.col("inside"), F.col("few") + F.pmod(F.xxhash64("id"), "many")).otherwise(F.pmod(F.xxhash64("id"), "few")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("few") - 1 + F.when(F.col("inside"), 0).otherwise(F.col("many"))))).where("own <> other")
    return rest.select("bucket", "merged", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component")


def component_ids(rows: DataFrame, named: DataFrame, sizes: DataFrame, percent: int, words: int, enough: str | None = None) -> DataFrame:
    """(id, component) of those that links touch, for rows(id, text) in buckets named(bucket, id) and their sizes(id, size, ..), all of them tables.

    0. Buckets are grouped once, in one shuffle of `named`; only those of more than FEW members are looked up in it again. 1. Those are stars around their smallest id. 2. In buckets that hold several components what is outside the
    largest one (at most FEW members) meets all, a pair once however many buckets it shares. `enough` is a condition that a
    pair alike enough meets, on the number `met` of buckets that it shares and the columns of sizes with _a and _b behind them. 3. Where more is outside, buckets with much in common are one, and
    tasks of two blocks compare sets and put out at most a link for each join; a pair that such a bucket
    holds needs no other. So near copies by the thousand never become pairs, and no candidate is left out.
    """
    met = cut(first_members(named), "met")
    hot = cut(met.where(f"n > {FEW}").select("bucket", "lo", "n").distinct(), "hot-buckets")
    few = met.where(f"n BETWEEN 3 AND {FEW}").select("bucket", "id", "lo", "n")
    members = cut(few.unionByName(join_sized(named, hot, ["bucket"], "inner").select("bucket", "id", "lo", "n").distinct()), "members")
    stars = members.where(f"n > {FEW} AND id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b")).distinct()
    stars = cut(sized(stars, sizes, percent).select("a", "b").distinct(), "stars")
    first = confirmed(rows, stars, percent, words, "star")
    found = components(first, "star")

    plain = sizes.groupBy("id").agg(F.max("size").alias("size"))
    at = join_sized(join_sized(members.select("bucket", "id"), plain, ["id"], "inner"), found, ["id"], "left").withColumn("component", F.coalesce("component", "id"))
    at = cut(at, "placed")
    parts = at.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
    left = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("big"), F.sum("n").alias("n"), F.sum("who").alias("who")).where("parts > 1")
    # buckets with the same members count once, as often as there are
    left = left.groupBy("n", "who").agg(F.min(F.struct("bucket", "big")).alias("b"), F.count("*").alias("times"))
    left = cut(left.select("b.bucket", F.col("b.big.component").alias("big"), (F.col("n") - F.col("b.big.n")).alias("outside"), "times"), "open-buckets")

    here = join_sized(at, left.where(f"outside <= {FEW}").select("bucket", "big", "times"), ["bucket"], "inner")
    out = here.where("component <> big").select("bucket", F.col("id").alias("other"), F.col("component").alias("apart"))
    out = here.join(out, "bucket").where("component <> apart AND (component = big OR id < other)")
    pairs = out.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "times").unionByName(met.where("n = 2 AND id = lo").select(F.col("lo").alias("a"), F.col("hi").alias("b"), F.lit(1).cast("long").alias("times")))
    pairs = sized(pairs.groupBy("a", "b").agg(F.sum("times").alias("met")), sizes, percent)
    pairs = (pairs.where(enough) if enough else pairs).select("a", "b").distinct()
    pairs = cut(join_sized(pairs, stars, ["a", "b"], "left_anti"), "pairs")
    links = first.unionByName(confirmed(rows, pairs, percent, words, "pair"))

    rest = cut(join_sized(at, left.where(f"outside > {FEW}").select("bucket", "big"), ["bucket"], "inner"), "open-members")
    if rest.limit(1).count():
        rest = cut(in_blocks(merged_buckets(rest)), "blocks")
        sets = sets_of(rows, rest.select("id"), words, "block")
        links = links.unionByName(rest.join(sets.hint("merge"), "id").groupBy("bucket", "merged", "i", "j").applyInPandas(linked_in_block(percent), "src long, dst long"))
    return components(cut(links, "links"), "all")
