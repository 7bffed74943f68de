"""Mixing sources to target weights by Poisson replication (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, free_names, join_sized, table

#: Weight of a source is its share to this power: 1 keeps the shares, 0 makes sources equal.
TEMPERATURE = 0.5
#: Rows of the mix for each row of the input.
EPOCHS = 1.0
SEED = "mix-1"
#: The largest mean that is drawn in one go.
MEAN_PART = 32.0
#: Buckets of the global shuffle; their counts are all that is broadcast.
SHUFFLE_BUCKETS = 65_536


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1), the same wherever it is computed: 48 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def poisson_count(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) > u for X of a Poisson distribution with this mean, which is MEAN_PART at most, so exp(-mean) is a normal number."""
    steps = F.sequence(F.lit(1), (mean + F.lit(12.0) * F.sqrt(mean) + F.lit(24.0)).cast("int"))
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("k"))
    step = lambda s, i: F.when(u < s["c"], s).otherwise(F.struct((s["p"] * mean / i).alias("p"), (s["c"] + s["p"] * mean / i).alias("c"), i.alias("k")))
    return F.aggregate(steps, start, step, lambda s: s["k"])


def copies_of(key: Column, rate: Column, seed: str) -> Column:
    """A Poisson number of any mean: as sums of Poisson numbers are Poisson, a rate beyond MEAN_PART is the sum of equal parts of MEAN_PART at most, each drawn with a number of its own."""
    parts = F.ceil(rate / F.lit(MEAN_PART)).cast("int")
    one = poisson_count(uniform(key, seed), F.least(rate, F.lit(MEAN_PART)))
    drawn = lambda k: poisson_count(uniform(F.concat(key, F.lit("|"), k.cast("string")), seed), rate / parts)
    return F.when(rate <= 0, 0).when(rate <= MEAN_PART, one).otherwise(F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, k: n + drawn(k)))


def target_rates(docs: DataFrame, source_col: str = "source", weights: DataFrame | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate): the mean number of copies of each document of a source, from counts over all rows.

    weights(source, weight) sets the targets; sources that it lacks get 0. Without it a weight is the source's share to the
    power `temperature`. Rates make the expected size of the mix epochs times the rows of docs.
    """
    counts = cut(docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n")), "source-counts")
    if weights is None:
        sized = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        sized = counts.join(weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double")), F.col("source").eqNullSafe(F.col("w_source")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    all_n, all_w = sized.agg(F.sum("n"), F.sum("weight")).first()
    if not all_w:
        return sized.select("source", F.lit(0.0).alias("rate"))
    return sized.select("source", (F.lit(float(epochs)) * F.lit(all_n) * F.col("weight") / F.lit(float(all_w)) / F.col("n")).alias("rate"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: DataFrame | None = None, epochs: float = EPOCHS, temperature: float = TEMPERATURE, seed: str = SEED,
    copy_col: str = "mix_copy", key_col: str = "mix_key",
) -> DataFrame:
    """All columns of docs with copy_col (int, from 1) and key_col (string, the place in the shuffle), rows repeated by their counts.

    The count inverts the Poisson distribution with the source's rate, however high, at a number hashed from id
    and seed. Null is a source of its own. Rows that repeat an id get equal counts. A null id hashes
    as the text 'null'. Columns of docs named copy_col or key_col are replaced, all others stay.
    Nothing else of a row is looked at, so null, empty and long texts pass as they
    are. An empty table gives no rows. A source with a third of all rows costs no more than others:
    rates join by broadcast up to BROADCAST_ROWS sources, else by a join whose skew Spark splits.
    """
    docs = docs.drop(copy_col, key_col)
    rates = target_rates(docs, source_col, weights, epochs, temperature)
    m_source, m_null, m_rate, m_n = names = free_names(docs, "mix_source", "mix_null", "mix_rate", "mix_n")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rates = rates.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias(m_source), F.col("source").isNull().alias(m_null), F.col("rate").alias(m_rate))
    df = docs.withColumns({m_source: F.coalesce(F.col(source_col).cast("string"), F.lit("")), m_null: F.col(source_col).isNull()})
    df = join_sized(df, rates, [m_source, m_null], "inner", BROADCAST_ROWS)
    copies = df.withColumn(m_n, copies_of(key, F.col(m_rate), seed)).where(F.col(m_n) > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(m_n))))
    return copies.withColumn(key_col, F.md5(F.concat_ws("|", key, F.col(copy_col).cast("string"), F.lit(seed)))).select(*docs.columns, copy_col, key_col)


def shuffled(mixed: DataFrame) -> DataFrame:
    """mixed with position (long, from 0), its place in the order of mix_key, without any global sort in one task.

    The key's first bits name a bucket; counts of buckets give each bucket's first position, and rows are ranked inside it. Rows with equal keys
    (repeats of a row) take neighbouring places.
    """
    df = mixed.withColumn("mix_bucket", F.conv(F.substring("mix_key", 1, 4), 16, 10).cast("int"))
    counts = df.groupBy("mix_bucket").agg(F.count("*").alias("n"))
    starts = counts.selectExpr("mix_bucket", "sum(n) over (order by mix_bucket) - n as mix_start")
    place = F.expr("row_number() over (partition by mix_bucket order by mix_key) - 1")
    return df.withColumn("mix_place", place).join(F.broadcast(starts), "mix_bucket").withColumn("position", F.col("mix_start") + F.col("mix_place")).drop("mix_bucket", "mix_place", "mix_start")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per copy: doc_id, source, mix_copy, position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    mixed = cut(mix(docs), "mixed")
    return shuffled(mixed).select("doc_id", "source", F.col("mix_copy").cast("long").alias("mix_copy"), F.col("position").cast("long").alias("position"))


SQL = {
    "op10_mix_sources": f"""
        WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS weight FROM documents GROUP BY source),
        rates AS (SELECT source, {EPOCHS} * sum(n) OVER () * weight / sum(weight) OVER () / n AS rate FROM counts),
        parted AS (SELECT source, greatest(1, ceil(rate / {MEAN_PART}))::INT AS parts, rate / greatest(1, ceil(rate / {MEAN_PART})) AS rate FROM rates),
        pieces AS (SELECT d.doc_id, d.source, r.rate, r.parts, unnest(range(1, r.parts + 1)) AS part FROM documents d JOIN parted r ON d.source IS NOT DISTINCT FROM r.source),
        drawn AS (
            SELECT doc_id, source, rate,
                   ('0x' || substr(md5(doc_id::VARCHAR || CASE WHEN parts > 1 THEN '|' || part::VARCHAR ELSE '' END || '|{SEED}'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
            FROM pieces),
        steps(source, rate, k, p, c) AS (
            SELECT source, rate, 0, exp(-rate), exp(-rate) FROM parted
            UNION ALL
            SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM steps WHERE k < rate + 12 * sqrt(rate) + 23),
        counted AS (
            SELECT w.doc_id, w.source, count(*) AS n
            FROM drawn w JOIN steps s ON w.source IS NOT DISTINCT FROM s.source AND s.c <= w.u GROUP BY w.doc_id, w.source),
        copies AS (SELECT doc_id, source, unnest(range(1, n + 1)) AS mix_copy FROM counted)
        SELECT doc_id, source, mix_copy::BIGINT AS mix_copy,
               (row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|' || mix_copy::VARCHAR || '|{SEED}')) - 1)::BIGINT AS position
        FROM copies
    """
}
