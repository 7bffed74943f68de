"""The message branch, step by step: messages to chunks, chunk graphs, links, entities, output tables.

Every step takes and returns DataFrames. Steps that ask a model take its client, and are the prompt, the call, the tolerant parse and the
join by key; operators between them do the rest.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists, text
from ..functions import vectors as V
from ..functions.tolerant_json import NODE_TYPE, parse
from ..operators import entities, external, relational, sequences, vector_search
from ..sources.tables import cut

KINDS = ("meta", "context", "attributes")
LINKS = "array<struct<id: string, caused_by: array<string>, caused: array<string>>>"


def with_partner(messages: DataFrame, partner: str) -> DataFrame:
    return messages.where((F.col("from") == partner) | (F.col("to") == partner))


def chunks_sequential(messages: DataFrame, client, conversation: str = "conversation") -> DataFrame:
    """messages(conversation, from, to, datetime, content) with index, chunk_id and sentiment, a window at a time by the model's decision."""
    rows = sequences.with_row_index(messages, "datetime", "content", partition=[conversation])
    schema = rows.withColumn("chunk_id", F.lit(None).cast("long")).withColumn("sentiment", F.lit(None).cast("double")).schema

    def decide(window: list[dict]) -> dict:
        prompt = "Do these messages hold one conversation, or should they be split?\n" + "\n".join(f"{m['from']}: {m['content']}" for m in window)
        try:
            return parse(client.complete([{"role": "user", "content": prompt}]).text, "split") or {"decision": "NO_SPLIT"}
        except external.FAILURES:  # a failed call leaves the window to grow
            return {"decision": "NO_SPLIT"}

    cut_up = sequences.segment(decide)
    out = rows.groupBy(conversation).applyInPandas(lambda pdf: cut_up(pdf)[[f.name for f in schema]], schema)
    # the model is asked once, however often the chunks are used
    return cut(out.withColumn("sentiment", F.nanvl("sentiment", F.lit(None).cast("double"))), "chunks")


def chunks_rechunked(df: DataFrame, least: int = 7, conversation: str = "conversation") -> DataFrame:
    """Small chunks merged forward, with the mean sentiment of the new ones on every row."""
    sizes = df.groupBy(conversation, "chunk_id").agg(F.count("*").alias("n"), F.min("datetime").alias("earliest"))
    mapping = sequences.rechunk(sizes, least, partition=[conversation])
    return df.join(mapping, [conversation, "chunk_id"]).withColumn("chunk_id", F.col("new_chunk")).drop("new_chunk").withColumn("chunk_sentiment", F.expr(f"avg(sentiment) over (partition by {conversation}, chunk_id)"))


def chunk_rows(df: DataFrame, me: str = "me", conversation: str = "conversation") -> DataFrame:
    """One row per chunk: messages in order, sentiment, bounds and transcript."""
    out = df.groupBy(conversation, "chunk_id").agg(
        lists.ordered(F.struct("from", "datetime", "content"), F.col("datetime"), F.col("index")).alias("messages_struct"),
        F.avg("sentiment").alias("sentiment"), F.min("datetime").alias("start_dt"), F.max("datetime").alias("end_dt"),
    )
    return out.withColumn("messages_str", text.transcript(F.col("messages_struct"), me))


def chunk_subgraphs(chunks: DataFrame, client, key: str = "chunk_id") -> DataFrame:
    """Three lists of nodes a chunk, from the last three answers of a chain of prompts; empty where an answer fails."""
    from ..functions.tolerant_json import parse_column

    prompts = F.array(F.concat(F.lit("What is this conversation about?\n"), "messages_str"), *[F.lit(f"List its {k} nodes as JSON.") for k in KINDS])
    asked = external.complete(chunks.withColumn("_p", prompts).select(key, "_p"), client, key, "_p")
    none = F.array().cast(f"array<{NODE_TYPE}>")
    parsed = asked.select(key, *[F.coalesce(parse_column(F.try_element_at("answers", F.lit(-3 + k)), "nodes"), none).alias(f"subgraph_{kind}") for k, kind in enumerate(KINDS)])
    return chunks.join(parsed, key, "left")


def sanitized(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The three lists as one, with clean ids that hold their row; rows are numbered by key, so ids are stable."""
    tagged = lambda k: F.transform(F.coalesce(f"subgraph_{k}", F.array().cast(f"array<{NODE_TYPE}>")), lambda n: n.withField("subgraph_type", F.lit(k)))
    df = sequences.with_row_index(chunks.withColumn("subgraph_combined", F.concat(*[tagged(k) for k in reversed(KINDS)])), key, name="row").drop(*[f"subgraph_{k}" for k in KINDS])
    mapping = entities.sanitise_ids(df.select("row", F.explode("subgraph_combined").alias("n")).select("row", F.col("n.id").alias("id")))
    return cut(entities.remap_nodes(df, mapping, nodes="subgraph_combined").drop("row"), "subgraphs")


def cross_chunk_links(chunks: DataFrame, client, key: str = "chunk_id", repeat_nodes: bool = False) -> DataFrame:
    """Links of nodes without causes to nodes of chunks before: asked for each pair, joined by chunk, and merged into the nodes."""
    pairs = sequences.lookback(chunks.select(key, "start_dt", "end_dt"), key)
    before = chunks.select(F.col(key).alias("prev"), F.col("subgraph_combined").alias("prev_nodes"))
    asked = pairs.join(before, "prev").join(chunks.select(key, lists.roots(F.col("subgraph_combined")).alias("open")), key)
    asked = asked.withColumn("pair", F.concat_ws("|", F.col(key).cast("string"), F.col("prev").cast("string"))).where(F.size("open") > 0)
    prompt = F.concat(F.lit("Which earlier nodes cause these?\n"), F.to_json("open"), F.lit("\n"), F.to_json("prev_nodes"))
    told = external.answer_column(asked, client, "pair", prompt, "new_links", "links")
    links = told.groupBy(key).agg(F.flatten(lists.ordered(F.coalesce("links", F.array().cast(LINKS)), F.col("rank"))).alias("links"))
    # several pairs may say something of one node, so their lists are joined before they are merged
    flat = links.select(key, F.posexplode("links").alias("k", "n")).groupBy(key, F.col("n.id").alias("id")).agg(F.flatten(lists.ordered(F.coalesce("n.caused_by", F.array().cast("array<string>")), F.col("k"))).alias("caused_by"), F.flatten(lists.ordered(F.coalesce("n.caused", F.array().cast("array<string>")), F.col("k"))).alias("caused"))
    joined = flat.groupBy(key).agg(F.collect_list(F.struct("id", "caused_by", "caused")).alias("links"))
    return cut(relational.merge_links(chunks, joined, key).join(links.withColumnRenamed("links", "new_causal_links"), key, "left"), "linked-chunks")


def node_embeddings(chunks: DataFrame, embedder, key: str = "chunk_id") -> DataFrame:
    rows = chunks.select(key, F.explode("subgraph_combined").alias("n")).select(key, "n.*").where("proposition IS NOT NULL")
    return external.embed(rows, embedder, "proposition")


def nodes_deduplicated(nodes: DataFrame, first: str, second: str, client, embedder, threshold: float = 0.98) -> DataFrame:
    """Entities of each user, merged by similarity; ids unique over all; propositions of merged ones told anew and embedded again."""
    df = nodes.withColumn("user", text.subject(F.col("proposition"), first, second)).withColumn("relationships", lists.relationships(F.col("id"), F.col("caused"), F.col("caused_by")))
    df = cut(df.withColumn("_ord", F.struct("chunk_id", "id")), "user-nodes")
    frames = [
        entities.merge_entities(df.where(F.col("user") == u), "id", "embedding", threshold, ["user", "proposition", "embedding"], [("chunk_ids", "chunk_id"), ("datetimes", "datetime"), ("propositions_to_merge", "proposition"), ("subgraph_types", "subgraph_type")], "relationships", "_ord")
        for u in ("both", first, second)
    ]
    merged = entities.uniquify_ids(frames)
    several = merged.where("frequency > 1")
    told = external.answer_column(several.select("id", "propositions_to_merge"), client, "id", F.concat(F.lit("Say these as one proposition:\n"), F.array_join("propositions_to_merge", "\n")), "proposition", "proposition").where("proposition IS NOT NULL")
    return relational.refresh(merged, external.embed(told.select("id", "proposition"), embedder, "proposition"), ["id"])


def node_sentiments(nodes: DataFrame, client) -> DataFrame:
    told = external.answer_column(nodes, client, "id", F.concat(F.lit("Sentiment from -1 to 1 of: "), "proposition"), "sentiment", "sentiment")
    return told.withColumn("sentiment", F.coalesce(F.nanvl("sentiment", F.lit(0.0)), F.lit(0.0)))


def reduced(df: DataFrame, size: int = 2000, k: int | None = None):
    """(df with reduced_embedding, models): principal components, at most as many as rows, with zeros up to size."""
    n, width = df.count(), df.select(F.max(F.size("embedding"))).first()[0]
    models = vector_search.fit_pca(df, "embedding", min(k or size, n, width))
    return vector_search.apply_pca(df, models, "embedding", size), models


def seed_hypotheses(chunks: DataFrame, client, key: str = "chunk_id", most: int = 5, below: float = -0.3) -> DataFrame:
    worst = chunks.where(F.col("sentiment") <= below).orderBy("sentiment", key).limit(most)
    return external.answer_column(worst, client, key, F.concat(F.lit("Why?\n"), "messages_str"), "hypothesis", "hypothesis")


def hypotheses_validation(hypotheses: DataFrame, make_client, tools: dict, key: str = "chunk_id") -> pd.DataFrame:
    """Results and traces of a hypothesis at a time: tools query the cluster, so the loop is the driver's; there are a few hypotheses."""
    rows = []
    for r in hypotheses.select(key, "hypothesis").toLocalIterator():
        results, traces = external.validate_hypothesis(make_client(), r["hypothesis"], tools)
        rows.append((r[key], r["hypothesis"], results, [vars(t) for t in traces]))
    return pd.DataFrame(rows, columns=[key, "hypothesis", "results", "traces"])


def by_user(chunks: DataFrame, client, kind: str, me: str, partner: str, key: str = "chunk_id") -> DataFrame:
    """<kind>_me and <kind>_partner of each chunk: lists by user, as the older steps have them."""
    told = external.answer_column(chunks, client, key, F.concat(F.lit(f"List {kind} of each user.\n"), "messages_str"), "claims_by_user", "_by")
    of = lambda name: F.try_element_at("_by", F.lit(name))
    return told.withColumn(f"{kind}_me", of(me)).withColumn(f"{kind}_partner", of(partner)).drop("_by")


def sentiment_ranges(chunks: DataFrame, bounds: tuple[float, float] = (-0.3, 0.3)) -> DataFrame:
    """Chunks with sentiment_range: negative, neutral or positive, by the bounds; null without a sentiment."""
    low, high = bounds
    s = F.col("sentiment")
    return chunks.withColumn("sentiment_range", F.when(s <= low, "negative").when(s >= high, "positive").when(s.isNotNull(), "neutral"))


def daily_chunks(messages: DataFrame, client) -> DataFrame:
    """(date, decision, chunks) of each day's transcript, and its messages in the parts that the decision names."""
    days = sequences.day_transcripts(messages.withColumn("date", F.to_date("datetime")), ["date"], ["datetime"], F.concat("from", F.lit(": "), "content"))
    return external.answer_column(days, client, "date", F.concat(F.lit("Split the day?\n"), "transcript"), "day_decision", "d").select("date", "d.decision", "d.chunks")


def messages_in_parts(messages: DataFrame, days: DataFrame) -> DataFrame:
    """Messages with the part of their day that holds them; those between parts take the next part, else the one before."""
    parts = days.select("date", F.posexplode("chunks").alias("part", "c")).select("date", "part", F.col("c.start_time").alias("s"), F.col("c.end_time").alias("e"))
    m = sequences.with_row_index(messages.withColumn("date", F.to_date("datetime")).withColumn("t", F.date_format("datetime", "HH:mm:ss")), "datetime", "content")
    held = relational.contain(m.select("index", "date", "t"), parts, "date", "t", "s", "e").groupBy("index").agg(F.min("part").alias("part"))
    return sequences.fill_both(m.join(held, "index", "left"), "part", ["index"], ["date"])


def cosine_to(query: list[float]) -> Column:
    return V.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in query]))
