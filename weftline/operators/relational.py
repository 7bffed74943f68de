"""Joins and restructurings that chat and graph pipelines repeat."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lists
from ..sources.tables import cut

#: Keys over which rows that meet all of a short list are spread.
SPREAD = 64
#: Most slots of the mean length of ranges in which points are looked for.
SLOTS = 64


def refresh(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """old with the columns that new has too taken from new where it has a value."""
    shared = [c for c in old.columns if c in new.columns and c not in on]
    right = new.select(*on, *[F.col(c).alias(f"_new_{c}") for c in shared])
    return old.join(right, list(on), "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in shared else F.col(c) for c in old.columns])


def drop_keys(df: DataFrame, invalid: DataFrame, on: Sequence[str]) -> DataFrame:
    """Without every row whose key has an invalid row."""
    return df.join(invalid.select(*on).distinct(), list(on), "left_anti")


def either_join(left: DataFrame, right: DataFrame, left_key: str, first: str, second: str) -> DataFrame:
    """Rows where left_key equals either column of right, once each: two equi-joins instead of a nested loop."""
    by = lambda c: left.join(right, left[left_key] == right[c])
    return by(first).unionByName(by(second).where(~right[second].eqNullSafe(right[first])))


def contain(points: DataFrame, ranges: DataFrame, day: str, at: str, start: str, end: str) -> DataFrame:
    """Points in the ranges of their day: an equi-join on the day with a range condition.

    Times and numbers are also matched by slots, so that what is compared grows with what is found: a range lies in all slots that it touches, and a point in one. A slot is at least
    SLOTS-th of the mean length of ranges, and so long that copies of ranges are no more than points and ranges together, and two for each range: what is shuffled grows with the
    input. Ranges of no length meet their points by equality. Ranges are written as a table, as they are read three times.
    """
    r = ranges.withColumnRenamed(day, "_day").where((F.col(start) <= F.col(end)) & F.col("_day").isNotNull())
    kinds = [dict(points.dtypes)[at], dict(ranges.dtypes)[start], dict(ranges.dtypes)[end]]
    within = (F.col(day) == F.col("_day")) & (F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))
    if len(set(kinds)) > 1 or kinds[0] not in ("timestamp", "timestamp_ntz", "date", "int", "bigint", "double"):
        return points.join(r, within).drop("_day")
    place = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") if kinds[0] in ("timestamp", "timestamp_ntz", "date") else F.col(c).cast("double")
    r = cut(r, "ranges")
    long = r.where(F.col(start) < F.col(end))
    width, several = long.agg(F.avg(place(end) - place(start)), F.count("*")).first()
    moment = points.join(r.where(F.col(start) == F.col(end)), (F.col(day) == F.col("_day")) & (F.col(at) == F.col(start))).drop("_day")
    if width is None or not 0 < width < float("inf"):
        return moment if width is None else points.join(r, within).drop("_day")
    slots = min(SLOTS, (points.count() + r.count()) / several)
    slot = lambda c: F.floor(place(c) / F.lit(width / slots)).cast("long")
    spread = long.withColumn("_slot", F.explode(F.sequence(slot(start), slot(end))))
    # few rows make many, so neither side's size may lower the number of tasks or have it broadcast
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.withColumn("_at_slot", slot(at)).repartition(tasks, day, "_at_slot")
    found = dealt.join(spread.repartition(tasks, "_day", "_slot").hint("merge"), (F.col(day) == F.col("_day")) & (F.col("_at_slot") == F.col("_slot")) & within).drop("_day", "_slot", "_at_slot")
    return found.unionByName(moment)


def merge_links(chunks: DataFrame, links: DataFrame, chunk: str = "chunk_id", nodes: str = "subgraph_combined", new: str = "links") -> DataFrame:
    """Nodes of chunks with new causes and effects appended, matched by id inside the chunk; of new entries with one id the last counts; nodes without any stay."""
    found = chunks.join(links.select(chunk, F.col(new).alias("_new")), chunk, "left")
    none = F.array().cast("array<string>")

    def merged(n: Column) -> Column:
        extra = lambda f: F.concat(F.coalesce(n[f], none), F.coalesce(F.try_element_at(F.transform(F.filter(F.coalesce("_new", F.array().cast(dict(links.dtypes)[new])), lambda x: x["id"] == n["id"]), lambda x: x[f]), F.lit(-1)), none))
        return n.withField("caused_by", extra("caused_by")).withField("caused", extra("caused"))

    return found.withColumn(nodes, F.transform(nodes, merged)).drop("_new")


def connect(nodes: DataFrame, chunks: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """M:N link tables of nodes with chunks (by chunk_ids) and with users (by name; 'both' with all users)."""
    of_chunk = nodes.select(F.col("id").alias("node_id"), F.explode("chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id").distinct(), "chunk_id").distinct()
    named = nodes.where("user <> 'both'").select(F.col("id").alias("node_id"), "user").join(users.select(F.col("name").alias("user"), F.col("id").alias("user_id")), "user")
    # 'both' stands for every user: nodes are dealt to SPREAD keys, and users go to all of them, so neither side meets in one task
    every = users.select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_at"))
    both = nodes.where("user = 'both'").select(F.col("id").alias("node_id"), F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int").alias("_at")).join(every, "_at")
    return {"node_chunk": of_chunk.select("node_id", "chunk_id"), "node_user": named.select("node_id", "user_id").unionByName(both.select("node_id", "user_id")).distinct()}


def attach(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """Columns of results by key; rows without a result get nulls."""
    return df.join(more, key, "left")


def collect_except(df: DataFrame, column: str, order: Sequence[str] = ()) -> DataFrame:
    """Group by all columns but one, which becomes a list."""
    keys = [c for c in df.columns if c != column and c not in order]
    value = lists.ordered(F.col(column), *[F.col(o) for o in order]) if order else F.sort_array(F.collect_list(column))
    return df.groupBy(*keys).agg(value.alias(column))


def without_embeddings(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.lower().endswith("embedding")])


def sample_rows(df: DataFrame, n: int, key: str, seed: str = "sample") -> DataFrame:
    """n rows in the order of a seeded hash; an error if there are fewer."""
    found = df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))).limit(n)
    if (have := found.count()) < n:
        raise ValueError(f"sample of {n} from {have} rows")
    return found


def shuffled_list(a: Column, seed: Column) -> Column:
    return F.transform(F.array_sort(F.transform(a, lambda x: F.struct(F.md5(F.concat_ws("|", x.cast("string"), seed.cast("string"))).alias("k"), x.alias("x")))), lambda s: s["x"])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, skip: int = 0, name: str = "rank") -> DataFrame:
    """Rows ranked skip + 1 to skip + k in each group."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col(name).between(skip + 1, skip + k))


def new_and_gone(now: DataFrame, state: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Keys to add and keys to delete against a state table."""
    a, b = now.select(*keys).distinct(), state.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti"), b.join(a, list(keys), "left_anti")


def histogram(df: DataFrame, column: str, width: int = 40) -> DataFrame:
    """Counts by value with a bar, the longest of them `width` signs."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("_most"))  # one row
    return counts.crossJoin(F.broadcast(most)).withColumn("bar", F.repeat(F.lit("#"), F.ceil(F.col("n") * F.lit(width) / F.col("_most")).cast("int"))).drop("_most")


def beside_group(df: DataFrame, keys: Sequence[str], **values: Column) -> DataFrame:
    """df with aggregates of each row's group beside it: groups are summed before anything is shuffled, so a group may hold any share of the rows. Null keys are a group."""
    names = {k: f"_key_{k}" for k in keys}
    found = df.groupBy(*[F.col(k).alias(n) for k, n in names.items()]).agg(*[v.alias(n) for n, v in values.items()])
    on = [df[k].eqNullSafe(found[n]) for k, n in names.items()]
    return df.join(found, on, "left").drop(*names.values())


def split_by_chunks(nodes: DataFrame, chunks: str = "chunk_ids") -> tuple[DataFrame, DataFrame]:
    """(nodes of one chunk, nodes of several)."""
    return nodes.where(F.size(chunks) == 1), nodes.where(F.size(chunks) > 1)


def ranked_with_total(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """Rows with the largest value first, nulls before all, and beside each the total of all rows."""
    total = df.agg(F.sum(value).alias("total"))  # one row
    return df.crossJoin(F.broadcast(total)).orderBy(F.col(value).desc_nulls_first(), *ties)
