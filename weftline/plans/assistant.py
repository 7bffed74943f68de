"""The assistant branch: exchanges to skeletons, claims, a merged graph, causes, and claims held against evidence."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lists, text
from ..operators import entities, external, graph, relational, vector_search
from ..sources.tables import cut

KINDS = {"observables": "observable", "inferrables": "inferrable", "speculatives": "speculative"}


def transcripts(parsed: DataFrame, keep_empty: bool = True, limit: int | None = None) -> DataFrame:
    """A row per conversation: its exchanges as text and as questions, with title and start of the first."""
    answer = F.coalesce("answer", F.lit("")) if keep_empty else F.col("answer")
    said = F.concat("date", F.lit(" at "), "time", F.lit("\n QUESTION: "), "question", F.lit("\n ANSWER: "), answer)
    order = [F.col("date"), F.col("time"), F.col("question")]
    first = lambda c: F.min_by(c, F.struct("date", "time", "question"))
    df = parsed.withColumn("_said", said).groupBy("conversation_id").agg(
        lists.ordered_concat(F.col("_said"), "\n\n", *order).alias("datetime_conversations"), first("title").alias("title"), first("date").alias("start_date"), first("time").alias("start_time"),
        lists.ordered(F.struct("date", "time", "question"), *order).alias("datetime_questions"),
    )
    df = df.where(F.char_length("datetime_conversations") > 1)
    return df if limit is None else df.orderBy("start_date", "start_time", "conversation_id").limit(limit)


def skeletons(conversations: DataFrame, client) -> DataFrame:
    """The model's summary of each exchange beside its date; conversations without a valid one go, with all their rows."""
    told = external.answer_column(conversations, client, "conversation_id", F.concat(F.lit("Summarise each exchange as JSON.\n"), "datetime_conversations"), "exchanges", "_s")
    kept = relational.drop_keys(told, told.where("_s IS NULL"), ["conversation_id"])
    zipped = lists.zip_shortest(["s", "q"], F.col("_s"), F.col("datetime_questions"))
    return kept.withColumn("skeleton", F.transform(zipped, lambda z: F.struct(z["s"]["question"].alias("question"), z["s"]["answer"].alias("answer"), z["q"]["date"].alias("date"), z["q"]["time"].alias("time")))).drop("_s")


def skeletons_embedded(df: DataFrame, embedder) -> DataFrame:
    said = F.array_join(F.transform("skeleton", lambda s: F.concat_ws(": ", s["question"], s["answer"])), "\n")
    return external.embed(df.withColumn("skeleton_text", said), embedder, "skeleton_text").where("embedding IS NOT NULL")


def clustered(df: DataFrame, clusters: int = 20) -> DataFrame:
    return df.join(vector_search.cluster(df, "conversation_id", "embedding", clusters).withColumnRenamed("id", "conversation_id"), "conversation_id")


def categorized(df: DataFrame, client, sample: int = 20) -> DataFrame:
    """A category and whether it is personal, for each cluster, from up to `sample` of its skeletons."""
    groups = df.groupBy("cluster_label").agg(F.slice(lists.ordered(F.col("skeleton_text"), F.col("start_date"), F.col("conversation_id")), 1, sample).alias("texts"))
    told = external.answer_column(groups, client, "cluster_label", F.concat(F.lit("Name a category.\n"), F.array_join("texts", "\n\n")), "category", "c")
    return df.join(told.select("cluster_label", "c.category", "c.is_personal"), "cluster_label", "left")


def claims(df: DataFrame, client, personal_only: bool = True, limit: int | None = None) -> DataFrame:
    """Observables, inferrables, speculatives and links of each conversation: four batches, each shown what the ones before found, [] where they failed; rows with a failed part go."""
    rows = df.where("is_personal") if personal_only else df
    rows = rows if limit is None else rows.orderBy("start_date", "conversation_id").limit(limit)
    names = {**dict.fromkeys(KINDS, "described"), "causal_relationships": "links"}
    asked, before = rows.select("conversation_id", "skeleton_text"), []
    for name, contract in names.items():
        shown = [part for n in before for part in (F.lit(f"\n{n}: "), F.coalesce(F.to_json(n), F.lit("[]")))]
        asked = external.answer_column(asked, client, "conversation_id", F.concat(F.lit(f"List {name.replace('_relationships', ' links')}.\n"), "skeleton_text", *shown), contract, name)
        before.append(name)
    parsed = cut(asked.drop("skeleton_text"), "claims")
    bad = parsed.where(" OR ".join(f"{n} IS NULL" for n in names))
    return relational.drop_keys(rows.join(parsed, "conversation_id"), bad, ["conversation_id"])


def graph_nodes(df: DataFrame) -> DataFrame:
    """A row per claim: label (unique inside its type), description, node_type, and the conversation's links that touch it."""
    parts = [df.select("conversation_id", "start_date", "category", "cluster_label", "is_personal", F.explode(c).alias("n"), F.lit(kind).alias("node_type")) for c, kind in KINDS.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("*", F.col("n.label").alias("old"), F.col("n.description").alias("description")).drop("n").where("old IS NOT NULL")
    named = entities.uniquify_labels(rows.withColumn("label", F.col("old")), "label", ["description", "conversation_id"], ["node_type"])
    mapping = named.groupBy("conversation_id", "old").agg(F.max_by("label", F.struct("node_type", "label")).alias("new"))
    linked = named.join(df.select("conversation_id", "causal_relationships"), "conversation_id")
    return cut(entities.relabel_relations(linked, mapping, "conversation_id", "label", "causal_relationships").drop("old"), "claim-nodes")


def deduplicated(nodes: DataFrame, client, embedder, threshold: float = 0.9, k: int | None = 20) -> DataFrame:
    """Claims merged by similarity, with periods, and descriptions of merged ones told anew."""
    rows = external.embed(nodes, embedder, "description")
    rows = relational.drop_keys(rows, rows.where("embedding IS NULL"), ["label"]).withColumn("_ord", F.struct("start_date", "conversation_id", "label"))
    merged = entities.merge_entities(rows, "label", "embedding", threshold, ["description", "node_type", "conversation_id", "category", "cluster_label", "is_personal", "embedding"], [("merged_descriptions", "description"), ("dates", "start_date")], "causal_relationships", "_ord", k)
    merged = merged.withColumn("start_date", F.element_at("dates", 1)).withColumn("end_date", F.element_at("dates", -1))
    several = merged.where("frequency > 1").select("label", "merged_descriptions")
    told = external.answer_column(several, client, "label", F.concat(F.lit("Say as one:\n"), F.array_join("merged_descriptions", "\n")), "proposition", "description").where("description IS NOT NULL")
    return relational.refresh(merged, external.embed(told.select("label", "description"), embedder, "description"), ["label"])


def recursive_causes(nodes: DataFrame, client, k: int = 20, above: float = 0.7) -> DataFrame:
    """(label, causes): causes of each node among candidates before it."""
    found = vector_search.prefix_neighbours(nodes, "label", "embedding", ["end_date"], k, above)
    told = found.join(nodes.select(F.col("label").alias("prev"), F.col("description").alias("about")), "prev").groupBy("id").agg(lists.ordered(F.concat_ws(": ", "prev", "about"), -F.col("sim"), F.col("prev")).alias("c"))
    asked = nodes.join(told.withColumnRenamed("id", "label"), "label").select("label", "description", "c")
    return external.answer_column(asked, client, "label", F.concat(F.lit("Which cause "), "description", F.lit("?\n"), F.array_join("c", "\n")), "strings", "causes").select("label", "causes")


def seeds(nodes: DataFrame, client, embedder) -> DataFrame:
    """(label, description, seed_nodes, embedding): claims that would support each speculative."""
    rows = nodes.where("node_type = 'speculative'").select("label", "description")
    told = external.answer_column(rows, client, "label", F.concat(F.lit("What would support: "), "description"), "strings", "_l")
    return external.embed(told.select("label", "description", F.explode_outer("_l").alias("seed_nodes")).where("seed_nodes IS NOT NULL"), embedder, "seed_nodes")


def substantiated(nodes: DataFrame, edges: DataFrame, queries: DataFrame, least: float = 0.7, k: int = 30) -> DataFrame:
    """(label, id, score, is_seed, rank): evidence of each speculative by PageRank from nodes like its seeds, rarer ones first; none where nothing is alike."""
    pooled = vector_search.pooled_rank(nodes, queries.withColumnRenamed("label", "group").select("group", F.col("embedding").alias("q")), "label", "embedding", "group", "q", None, least=least)
    weights = pooled.join(nodes.select(F.col("label").alias("id"), "frequency"), "id").select(F.col("group").alias("seed"), "id", (F.col("sim") / F.col("frequency")).alias("weight"))
    ranked = graph.pagerank(nodes.select(F.col("label").alias("id")), edges, weights, directed=False)
    flagged = ranked.join(weights.select("seed", "id", F.lit(True).alias("is_seed")), ["seed", "id"], "left").select(F.col("seed").alias("label"), "id", "score", F.coalesce("is_seed", F.lit(False)).alias("is_seed"))
    return relational.top_per_group(flagged, ["label"], [F.desc("score"), "id"], k)


def judged(pairs: DataFrame, client, seed: str = "judge") -> DataFrame:
    """winner and relevant_items_per_list of lists in a seeded random order, which the prompt hides."""
    order = relational.shuffled_list(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.concat("label", F.lit(seed)))
    df = pairs.withColumn("order", order)
    return external.answer_column(df, client, "label", F.concat(F.lit("Which list serves best? "), F.to_json(F.struct(*[c for c in df.columns if c != "order"])), F.array_join("order", ",")), "judgement", "j")


def win_rates(judgements: DataFrame) -> DataFrame:
    return judgements.groupBy("category").agg(*[F.round(F.count_if(F.col("j.winner") == w) / F.count("*"), 6).alias(f"win_{w}") for w in ("A", "B", "C")])


def grown_evidence(claims_: DataFrame, evidence: DataFrame, judge: Callable[[str, list[str]], dict | None], group: str = "user", **options) -> DataFrame:
    """label, supports, confidence, evidence: claims in order for each group, supported ones joining the evidence of later ones."""
    schema = f"{group} {dict(claims_.dtypes)[group]}, label string, supports boolean, confidence double, evidence array<string>"

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return external.substantiate(a.sort_values("ord"), b, judge, **options).assign(**{group: key[0]})[[group, "label", "supports", "confidence", "evidence"]]

    return claims_.groupBy(group).cogroup(evidence.groupBy(group)).applyInPandas(run, schema)


def periods(nodes: DataFrame, compat: bool = False) -> DataFrame:
    return nodes.withColumn("relevance_period", text.relevance_period(F.col("start_date"), F.col("end_date"), F.col("start_time"), F.col("end_time"), compat))


