"""Streams: new partitions, event windows, sessions, and a hook after each batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def discover(spark: SparkSession, path: str, schema: str, pattern: str = r".*/([^/]+)/[^/]+$") -> DataFrame:
    """(partition, file, modified) of files that arrive under path; the checkpoint is the cursor."""
    files = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).alias("partition"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))


def windowed(events: DataFrame, time: str, key: str, value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and key, final once the watermark has passed."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), key)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key)
    return grouped.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def segmented(messages: DataFrame, key: str, decide: Callable[[list[dict]], dict], order: str = "index", content: str = "content", first: int = 20, step: int = 19, force: int = 100) -> DataFrame:
    """(key, order, content, chunk_id, sentiment) of a stream: a conversation's open window grows until `decide` says SPLIT, or it has more than `force` rows, as in batch.

    The open window and the next chunk's number are the state of each conversation. Rows come out once their chunk is closed; those of a batch
    are taken in their order, and batches have to follow each other in it.
    """
    kinds = dict(messages.dtypes)

    def grow(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, chunk, end = state.get if state.exists else ("[]", 0, first)
        rows = json.loads(held)
        for pdf in batches:
            rows += [[int(o), c] for o, c in sorted(zip(pdf[order], pdf[content], strict=True))]
        out = []
        while end < len(rows):
            answer = decide([{order: o, content: c} for o, c in rows[:end]])
            if answer.get("decision") == "SPLIT" or end > force:
                out += [(k[0], o, c, chunk, answer.get("sentiment")) for o, c in rows[:end]]
                rows, chunk, end = rows[end:], chunk + 1, first
            else:
                end += step
        state.update((json.dumps(rows), chunk, end))
        yield pd.DataFrame(out, columns=[key, order, content, "chunk_id", "sentiment"]).astype({"chunk_id": "int64", "sentiment": "float64"})

    schema = f"{key} {kinds[key]}, {order} long, {content} string, chunk_id long, sentiment double"
    grouped = messages.select(key, F.col(order).cast("long").alias(order), content).groupBy(key)
    return grouped.applyInPandasWithState(grow, schema, "rows string, chunk long, until int", "append", GroupStateTimeout.NoTimeout)


def after_each(df: DataFrame, checkpoint: str, done: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run `done` on every batch that is there and stop: a completion hook, or the state table's update."""
    return df.writeStream.foreachBatch(done).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliver(now: set[str], done: set[str], post: Callable[[str], bool]) -> set[str]:
    """The partitions that are done after this round: new ones are posted once each, those whose post fails or breaks stay new, and those that are gone are forgotten."""
    failed = set()
    for partition in sorted(now - done):
        try:
            ok = post(partition)
        except (OSError, TimeoutError, ValueError):  # no connection, or an answer that can't be read
            ok = False
        if not ok:
            failed.add(partition)
    return now - failed
