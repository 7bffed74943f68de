"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, packing, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import cut, free_names, join_sized, shuffle_partitions, table
from weftline.llm.line_dedup import drop_lines, line_classes
from weftline.llm.minhash import near_dedup
from weftline.llm.mixing import mix
from weftline.llm.packing import pack, tokenizer_file
from weftline.llm.toxicity import score, train

#: A stage's SQL would have to express automata, edit joins and a linear program.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the model learns from the labels of those that there are.

    Null and empty texts have no hits and stay; long ones are read whole; repeats and ties share a decision; an empty table stays empty.
    All columns come back, whatever their names.
    """
    lexicon, weights = train(docs, table(spark, sf_dir, "labels"))
    (held,) = free_names(docs, "tox_score")
    return score(docs, lexicon, weights, score_col=held).where(F.col(held) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line says already; n_chars follows.

    Null and empty texts have no lines and stay; long ones are read whole. Rows that repeat an id and a text share a decision, rows
    that repeat an id alone don't; of ties the first id and line stays. An empty table stays empty. All columns come back, whatever their names.
    """
    kept = drop_lines(docs, line_classes(docs))
    sized = kept.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else kept
    return sized.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies.

    Null, empty and blank texts are in no group and stay, as do null ids; long texts are compared whole. Rows that repeat an id are one
    document and stay or go together. An empty table stays empty. All columns come back, whatever their names.
    """
    gone = cut(near_dedup(docs).where("NOT kept").select("doc_id").distinct(), "near-copies")
    return join_sized(docs, gone, ["doc_id"], "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their sources' rates, in a random order: keys are digests, so equal shares of them, sorted, are a shuffle.

    Texts are not looked at, so null, empty and long ones pass; a null source is one of its own; rows that repeat an id have equal counts, and
    ties of keys any order. An empty table stays empty. All columns come back, whatever their names.
    """
    copy, key = free_names(docs, "mix_copy", "mix_key")
    return mix(docs, copy_col=copy, key_col=key).repartition(shuffle_partitions(spark), key).sortWithinPartitions(key).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences.

    A null or empty text is one piece of one token; long ones are cut into sequences; repeats are packed one by one, ties of length in the order of their ids.
    An empty table gives no rows. Columns besides doc_id and text are not read.
    """
    return pack(docs, tokenizer_file(), literal=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
