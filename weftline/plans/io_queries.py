"""Registered queries of sources, sinks and streams: tables of the driver written, read back and told in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import relational
from ..sources import readers, sinks
from ..sources.snapshots import Store
from ..sources.tables import cut, load, shared_dir
from ..streaming import events
from .queries import _QA, query


def folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared ones, which goes with the session."""
    path = f"{shared_dir(spark)}/weftline-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return f"{path}/{name}"


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice FROM orders")
def json_records(spark, sf_dir):
    """Files that hold an array of records each: one for every thousand orders."""
    path = folder(spark, "records")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    arrays = o.groupBy(F.floor(F.col("o_orderkey") / 1000).alias("part")).agg(F.collect_list(F.to_json(F.struct(*o.columns))).alias("r"))
    arrays.select("part", F.concat(F.lit("["), F.array_join("r", ",\n"), F.lit("]")).alias("value")).repartition("part").write.partitionBy("part").text(path)
    return readers.read_records(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").drop("part").withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(f"""WITH {_QA} SELECT conv_id::VARCHAR AS conversation_id, 'T' || conv_id AS title, '2024-01-01' AS date, strftime(TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL 1 SECOND, '%H:%M:%S') AS time,
    nullif(question, '') AS question, nullif(CASE WHEN turn % 4 = 0 THEN '' ELSE answer END, '') AS answer FROM qa WHERE role = 'user'""")
def archive_without_empty(spark, sf_dir):
    """Exchanges of an archive whose empty answers are null, written as CSV and read again as strings."""
    c = load(spark, sf_dir, "conversations")
    silent = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), F.lit("")).otherwise(F.col("text"))
    at = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("turn")
    messages = c.select(F.col("conv_id").cast("string").alias("conversation_id"), F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("title"), F.col("turn").cast("int").alias("place"), "role", at.cast("double").alias("create_time"), silent.alias("text"))
    parsed, path = readers.parsed_conversations(messages, keep_empty=False), folder(spark, "exchanges")
    parsed.write.option("header", True).option("escape", '"').option("quoteAll", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return readers.read_csv_strings(spark, path)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def partition_overwrite(spark, sf_dir):
    """Parquet by a key, of which one partition is written anew and the others stay."""
    path, o = folder(spark, "orders"), load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.write_partitions(o, path, ["o_orderstatus"])
    sinks.write_partitions(o.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2), path, ["o_orderstatus"])
    return spark.read.schema("o_orderkey long, o_totalprice double, o_orderstatus string").parquet(path)


@query("""SELECT 'part' AS tbl, p_partkey AS id, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', 1000000 + s_suppkey, s_name FROM supplier""")
def upsert_transaction(spark, sf_dir):
    """Two tables in a store: rows replaced and added in a second transaction. Parts of suppliers have an origin of their own in their key, so none takes the place of a part with its number."""
    p, s = load(spark, sf_dir, "part"), load(spark, sf_dir, "supplier")
    store = Store(spark, folder(spark, "store"))
    suppliers = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    parts = lambda rows, origin: rows.withColumn("origin", F.lit(origin))
    store.upsert({"part": (parts(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "part"), ["id", "origin"]), "supplier": (suppliers, ["id"])})
    large = p.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"))
    added = suppliers.withColumn("id", F.col("id") + 1_000_000)
    store.upsert({"part": (parts(large, "part").unionByName(parts(added, "supplier")), ["id", "origin"])})
    tables = store.tables()
    return tables["part"].select(F.lit("part").alias("tbl"), "id", "name").unionByName(tables["supplier"].select(F.lit("supplier").alias("tbl"), "id", "name"))


@query("""SELECT 'node' AS kind, c_custkey::VARCHAR AS a, c_name || ' <&> "' || c_mktsegment || '"' AS b FROM customer UNION ALL SELECT DISTINCT 'edge', o_custkey::VARCHAR, o_orderpriority FROM orders""")
def graphml_round_trip(spark, sf_dir):
    path = folder(spark, "graph.graphml")
    nodes = load(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.concat("c_name", F.lit(' <&> "'), "c_mktsegment", F.lit('"')).alias("label"))
    edges = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("src"), F.col("o_orderpriority").alias("dst")).distinct()
    sinks.write_graphml(nodes, edges, path)
    found, links = readers.read_graphml(spark, path)
    return found.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("attributes")["label"].alias("b")).unionByName(links.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25")
def row_limit(spark, sf_dir):
    """The first rows of a source; the limit is the feature."""
    return readers.limited(load(spark, sf_dir, "orders"), 25, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT DISTINCT s_name AS phone, n_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_name IN (SELECT n_name FROM nation)")
def partner_names(spark, sf_dir):
    """Names of numbers; suppliers are the numbers here, and all of them are asked for."""
    s, n = load(spark, sf_dir, "supplier"), load(spark, sf_dir, "nation")
    users, phones = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), s.select(F.col("s_name").alias("phone"), F.col("s_nationkey").alias("user_id"))
    return readers.partners(users, phones, [r["phone"] for r in phones.select("phone").distinct().collect()]).distinct()


def replayed(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """A stream of the rows of df, which are files of a folder."""
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def finished(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has told once all its files are read: the last table of complete mode, all rows of append mode."""
    path = folder(spark, "answers")
    how = "overwrite" if mode == "complete" else "append"
    run = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode(how).parquet(f"{path}/rows")).option("checkpointLocation", f"{path}/checkpoint")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Counts and sums by hour from a stream."""
    e = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    out = finished(spark, events.windowed(replayed(spark, e, "events"), "ts", "event_type", "value"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf_dir):
    """Sessions of users from a stream, which end half an hour after their last event."""
    e = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    out = finished(spark, events.sessions(replayed(spark, e, "clicks"), "ts", "user_id"), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT 'lang=' || lang AS partition, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def stream_partitions(spark, sf_dir):
    """Partitions that arrive under a folder, with their rows; the stream's checkpoint is the cursor."""
    path = folder(spark, "by-lang")
    sinks.write_partitions(load(spark, sf_dir, "documents").select("doc_id", "lang"), path, ["lang"])
    return finished(spark, events.discover(spark, path, "doc_id long").select("partition"), "append").groupBy("partition").agg(F.count("*").alias("n"))


_MEDIA_SQL = " ".join(f"WHEN {code} THEN '{label}'" for code, label in text.MEDIA.items())


@query(f"""SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 60 <> 0 THEN 'MEDIA: ' || CASE event_id % 60 {_MEDIA_SQL} ELSE 'UNKNOWN' END
    WHEN event_id % 2 = 0 THEN '' WHEN event_id % 3 = 0 THEN event_type || ' ' || 'Sent a link: k' || event_id || ' now' ELSE event_type || ' https://a.b/c now' END AS said FROM events""")
def media_texts(spark, sf_dir):
    """Labels of messages without text, and links named by their titles."""
    e = load(spark, sf_dir, "events")
    content = F.when(F.col("event_id") % 2 == 0, F.lit("")).otherwise(F.concat("event_type", F.lit(" https://a.b/c now")))
    title = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("k"), F.col("event_id").cast("string")))
    return e.select("event_id", text.media_text(content, F.col("event_id") % 60, title).alias("said"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS node_id, l_suppkey AS user_id FROM lineitem) SELECT node_id, user_id FROM l WHERE node_id % 5 > 0
    UNION SELECT o_orderkey, n_nationkey::BIGINT FROM orders, nation WHERE o_orderkey % 5 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def user_links(spark, sf_dir):
    """Links of nodes with users: by name, and 'both' with all; here suppliers and nations are the users."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").cast("string").alias("user")).distinct()
    named = li.where("id % 5 > 0").withColumn("chunk_ids", F.array().cast("array<int>"))
    both = li.where("id % 5 = 0").select("id", F.lit("both").alias("user"), F.array().cast("array<int>").alias("chunk_ids")).distinct()
    suppliers = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").cast("string").alias("name"))
    nations = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("-").alias("name"))
    chunks = cut(suppliers.select(F.col("id").cast("int").alias("chunk_id")), "chunks")
    return relational.connect(named, chunks, suppliers)["node_user"].unionByName(relational.connect(both, chunks, nations)["node_user"])
