"""Exact deduplication by a tree merge of sorted digest runs (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, table

#: log2 of the runs that meet in one merge.
FAN_BITS = 3


def digest_key(text: Column) -> Column:
    """SHA-256 with length and a second hash: rows merge only where all three agree, at every level."""
    return F.struct(F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("check"))


def merged(rows: DataFrame, n_runs: int, largest: bool) -> DataFrame:
    """One round: the sorted runs that meet in a run are merged in order, and of a key the first id in that order and the count go on.

    A run is cut by digest into slices, so that a round can have as many tasks as the first one however few its runs are. Rows are
    sorted by key and id where they meet, and equal neighbours are read in that order in one pass (a sort aggregate, see merge_runs).
    """
    parts = max(n_runs, shuffle_partitions(rows.sparkSession))
    cut_up = rows.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(-(-parts // n_runs))))
    by_id = F.col("win").desc_nulls_last() if largest else F.col("win").asc_nulls_last()
    met = cut_up.repartition("run", "slice").sortWithinPartitions("run", "slice", "key", by_id)
    return met.groupBy("run", "slice", "key").agg(F.first("win").alias("win"), F.sum("n").alias("n")).drop("slice")


def merge_runs(rows: DataFrame, largest: bool = True, runs: int | None = None) -> DataFrame:
    """Give every row of rows(id, key) its key's winner: columns of rows and win, n.

    Rows are dealt to `runs` (a power of two) by their id. Each run is sorted by key and merged, then runs meet
    in rounds, 2^FAN_BITS at a time (so many binomial rounds in one shuffle), each a merge of sorted runs that keeps the winning
    id and the count of a key; the key is the whole digest, length and second hash, so rows are told apart anew at every level. A key that holds a third of all rows so has one entry per run at
    most, and each merge of it at most 2^FAN_BITS. Winners of keys with more rows than one come back
    down the same tree by merge joins, so no task ever holds all rows of a key. rows is read several times: give a table.
    """
    spark = rows.sparkSession
    n_runs = runs or 1 << max(0, shuffle_partitions(spark) - 1).bit_length()
    dealt = rows.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(n_runs)).cast("int"))
    # sorted rows are summed in their order; the setting is put back once the levels are written
    setting = "spark.sql.execution.replaceHashWithSortAgg"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        levels = [cut(merged(dealt.select("run", "key", F.col("id").alias("win"), F.lit(1).cast("long").alias("n")), n_runs, largest), "run-0")]
        while n_runs > 1:
            n_runs = max(1, n_runs >> FAN_BITS)
            up = F.shiftright("run", FAN_BITS) if n_runs > 1 else F.lit(0)
            levels.append(cut(merged(levels[-1].select(up.alias("run"), "key", "win", "n"), n_runs, largest), f"run-{len(levels)}"))
    finally:
        spark.conf.set(setting, before)
    found = levels[-1].where("n > 1")
    for k in range(len(levels) - 2, -1, -1):
        at = levels[k].select("run", "key", (F.shiftright("run", FAN_BITS) if k < len(levels) - 2 else F.lit(0)).alias("up"))
        found = at.join(found.withColumnRenamed("run", "up").hint("merge"), ["up", "key"]).select("run", "key", "win", "n")
    out = dealt.join(found.hint("merge"), ["run", "key"], "left")
    return out.select(*rows.columns, F.coalesce("win", "id").alias("win"), F.coalesce("n", F.lit(1)).alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True, runs: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared as they are. A null text counts as empty, so null and empty texts are one group.
    Of equal texts the row with the largest id stays (the smallest with largest=False). Rows that
    repeat both id and text each count in group_size and share one decision. A null id never wins
    over a real one; where a group has no other, keep_id is null and its rows stay. An empty table
    gives no rows; columns besides the two are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), digest_key(text).alias("key")), "digests")
    won = merge_runs(rows, largest, runs)
    return won.select(
        F.col("id").alias("doc_id"),
        F.col("win").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(F.col("win")).alias("kept"),
        F.lower(F.hex("key.sha")).alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op4_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
}
