"""More registered queries: what the branches and the service do, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.tolerant_json import parse_column
from ..operators import entities, external, graph, relational, sequences
from ..sources.tables import cut, load
from . import assistant, human
from .queries import _VEC, query, user_graph
from .serve import Service


class Fixed:
    """An embedder that gives one vector for any text."""

    def __init__(self, vector) -> None:
        self.vector = [float(x) for x in vector]

    def embed(self, texts):
        return [self.vector for _ in texts]


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("vec_id").cast("int") % 28), "yyyy-MM-dd")
    said = F.concat(F.lit("node "), F.col("vec_id").cast("string"))
    return e.select(F.col("vec_id").cast("string").alias("id"), said.alias("proposition"), F.when(F.col("vec_id") % 4 > 0, F.array(day)).otherwise(F.array().cast("array<string>")).alias("datetimes"), (F.col("vec_id") % 3 + 1).cast("long").alias("frequency"), F.array().cast("array<string>").alias("edges"), F.col("embedding").cast("array<double>").alias("embedding"))


@query(f"""WITH {_VEC} SELECT a.vec_id::VARCHAR AS id, 'node ' || a.vec_id AS description, CASE WHEN a.vec_id % 4 = 0 THEN 'Unknown' ELSE strftime(DATE '2024-01-01' + (a.vec_id % 28)::INT, '%Y-%m-%d') END AS datetime,
    (a.vec_id % 3 + 1)::BIGINT AS frequency, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a, v b WHERE b.vec_id = 13 AND list_cosine_similarity(a.e, b.e) >= 0.2 ORDER BY list_cosine_similarity(a.e, b.e) DESC, a.vec_id::VARCHAR LIMIT 10""")
def similar_nodes(spark, sf_dir):
    """The service's nearest nodes to a text, with their descriptions and dates."""
    nodes = vector_nodes(spark, sf_dir)
    vector = load(spark, sf_dir, "embeddings").where("vec_id = 13").first()["embedding"]
    service = Service(nodes, spark.createDataFrame([], "chunk_id int, messages_str string"), Fixed(vector))
    return service.similar_nodes("any", 10, 0.2).withColumn("sim", F.round("sim", 6))


def order_service(spark: SparkSession, sf_dir: str) -> Service:
    """Orders as nodes whose parts are their chunks."""
    li = load(spark, sf_dir, "lineitem")
    nodes = li.groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.collect_set("l_partkey").alias("chunk_ids"), F.count("*").alias("frequency"))
    nodes = nodes.select("*", F.col("id").alias("proposition"), F.array().cast("array<string>").alias("datetimes"), F.array().cast("array<string>").alias("edges"), F.array().cast("array<double>").alias("embedding"))
    return Service(cut(nodes, "order-nodes"), load(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("messages_str")), Fixed([]))


@query("SELECT o.k::VARCHAR AS id, coalesce((SELECT p_name FROM part WHERE p_partkey = o.c), '') AS raw FROM (SELECT l_orderkey AS k, min(l_partkey) AS c FROM lineitem WHERE l_orderkey IN (1, 2, 3) GROUP BY 1) o")
def raw_data(spark, sf_dir):
    service = order_service(spark, sf_dir)
    known = [r["id"] for r in service.nodes.where("id IN ('1', '2', '3')").select("id").collect()]
    return spark.createDataFrame([(k, service.raw_data(k)) for k in known], "id string, raw string")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), t AS (SELECT DISTINCT o_custkey::VARCHAR AS src, ((o_custkey * 3 + o_orderkey % 4) % n + 1)::VARCHAR AS dst FROM orders, n),
    b(id, path, n) AS (SELECT '1', ['1'], 1 UNION ALL SELECT x.dst, x.path, x.n FROM (
      SELECT t.dst, list_append(b.path, t.dst) AS path, b.n + 1 AS n, row_number() OVER (PARTITION BY t.dst ORDER BY b.path) AS r FROM b JOIN t ON t.src = b.id WHERE b.n < 40 AND NOT list_contains(b.path, t.dst)) x WHERE x.r = 1),
    s AS (SELECT path FROM b WHERE id = (SELECT (n // 3)::VARCHAR FROM n) ORDER BY n, path LIMIT 1)
    SELECT unnest(path) AS id, unnest(range(len(path))) AS step FROM s""")
def causal_chain(spark, sf_dir):
    """The service's chain between two nodes, here a path."""
    n = load(spark, sf_dir, "customer").count()
    link = ((F.col("o_custkey") * 3 + F.col("o_orderkey") % 4) % n + 1).cast("string")
    nodes = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("id")).agg(F.collect_set(link).alias("edges"))
    nodes = nodes.select("*", F.lit(1).cast("long").alias("frequency"), F.col("id").alias("proposition"), F.array().cast("array<string>").alias("datetimes"), F.array().cast("array<double>").alias("embedding"))
    service = Service(cut(nodes, "chain-nodes"), spark.createDataFrame([], "chunk_id int, messages_str string"), Fixed([]))
    return spark.createDataFrame([(x, k) for k, x in enumerate(service.causal_chain("1", str(n // 3)))], "id string, step long")


@query("""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN user_id::VARCHAR END AS source, CASE WHEN event_id % 3 < 2 THEN event_id::VARCHAR END AS target FROM events""")
def parse_json_tolerant(spark, sf_dir):
    """Answers in fences with a trailing comma, with single quotes and no end, and without any JSON."""
    fenced = F.format_string('Sure:\n```json\n[{"source": "%s", "target": "%s"},]\n```', F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    cut_off = F.format_string("[{'source': '%s', 'target': '%s'", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    answer = F.when(F.col("event_id") % 3 == 0, fenced).when(F.col("event_id") % 3 == 1, cut_off).otherwise(F.lit("I can not say"))
    found = load(spark, sf_dir, "events").select("event_id", parse_column(answer, "links").alias("v"))
    return found.select("event_id", F.col("v")[0]["source"].alias("source"), F.col("v")[0]["target"].alias("target"))


@query("""WITH f AS (SELECT DISTINCT 0 AS k, lang AS old FROM documents UNION ALL SELECT DISTINCT 1, lang FROM documents UNION ALL SELECT DISTINCT 2, source FROM documents UNION ALL SELECT DISTINCT 3, source FROM documents UNION ALL SELECT DISTINCT 4, source FROM documents),
    n AS (SELECT k, old, old || CASE WHEN r > 1 THEN '_' || r ELSE '' END AS id FROM (SELECT *, row_number() OVER (PARTITION BY old ORDER BY k) AS r FROM f))
    SELECT k::INT AS kind, id, id AS edge FROM n""")
def uniquify_ids(spark, sf_dir):
    """Ids of later frames suffixed, and their own links with them."""
    d = load(spark, sf_dir, "documents")
    frame = lambda c, k: d.select(F.col(c).alias("id"), F.lit(k).alias("kind"), F.array(c).alias("edges"), F.array(F.struct(F.col(c).alias("source"), F.col(c).alias("target"))).alias("relationships")).dropDuplicates(["id"])
    got = entities.uniquify_ids([frame("lang", 0), frame("lang", 1), frame("source", 2), frame("source", 3), frame("source", 4)])
    return got.select("kind", "id", F.col("edges")[0].alias("edge"))


@query("""SELECT conv_id, CASE WHEN turn % 2 = 0 THEN 'r' || conv_id || '_' || turn ELSE turn::VARCHAR END AS id, CASE WHEN turn % 2 = 1 THEN 'r' || conv_id || '_' || (turn - 1) ELSE (turn - 1)::VARCHAR END AS cause FROM conversations""")
def remap_ids(spark, sf_dir):
    """Ids and causes inside node arrays through a mapping of even turns; odd ones are not in it and stay."""
    c = load(spark, sf_dir, "conversations")
    s = lambda x: x.cast("string")
    node = F.struct(s(F.col("turn")).alias("id"), F.array(s(F.col("turn") - 1)).alias("caused_by"), F.array().cast("array<string>").alias("caused"))
    rows = c.groupBy(F.col("conv_id").alias("row")).agg(F.collect_list(node).alias("nodes"))
    known = c.select("conv_id", F.col("turn")).union(c.select("conv_id", F.col("turn") - 1)).where("turn % 2 = 0").distinct()
    mapping = known.select(F.col("conv_id").alias("row"), s(F.col("turn")).alias("id"), F.concat(F.lit("r"), s(F.col("conv_id")), F.lit("_"), s(F.col("turn"))).alias("new_id"))
    out = entities.remap_nodes(rows, mapping).select(F.col("row").alias("conv_id"), F.explode("nodes").alias("n"))
    return out.select("conv_id", "n.id", F.col("n.caused_by")[0].alias("cause"))


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS src, s_suppkey + 1000 AS dst FROM supplier) SELECT n_nationkey::BIGINT AS id, n_name AS name, (SELECT count(*) FROM e WHERE src = n_nationkey)::BIGINT AS n_out FROM nation
    UNION ALL SELECT DISTINCT dst::BIGINT, NULL, 0 FROM e""")
def build_graph(spark, sf_dir):
    """Nodes of a graph, with endpoints that no row names, and their outgoing edges."""
    n, s = load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier")
    links = s.groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.collect_list((F.col("s_suppkey") + 1000).cast("long")).alias("edges"))
    nodes, edges = graph.build(n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")).join(links, "id", "left"))
    return nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n_out"))


@query("""WITH e AS (SELECT DISTINCT s AS src, d AS dst FROM (SELECT user_id AS s, lead(user_id) OVER (ORDER BY ts, event_id) AS d FROM events) WHERE d IS NOT NULL AND s <> d),
    b AS (SELECT src AS id, dst AS x FROM e UNION SELECT dst, src FROM e) SELECT c_custkey AS id, coalesce((SELECT string_agg(x::VARCHAR, ',' ORDER BY x) FROM b WHERE b.id = c_custkey), '') AS neighbours FROM customer""")
def seed_neighbours(spark, sf_dir):
    seeds = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return graph.neighbours(user_graph(spark, sf_dir), seeds).select("id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query("""SELECT lang AS category, round(count(*) FILTER (doc_id % 3 = 0) / count(*), 6) AS win_A, round(count(*) FILTER (doc_id % 3 = 1) / count(*), 6) AS win_B, round(count(*) FILTER (doc_id % 3 = 2) / count(*), 6) AS win_C FROM documents GROUP BY lang""")
def win_rates(spark, sf_dir):
    winner = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("doc_id") % 3 + 1).cast("int"))
    return assistant.win_rates(load(spark, sf_dir, "documents").select(F.col("lang").alias("category"), F.struct(winner.alias("winner")).alias("j")))


@query("""SELECT count(*)::BIGINT AS n, count(*) FILTER (event_id % 5 = 0)::BIGINT AS failed, round(sum((user_id * 2.5 + event_id * 10.0) / 1e6), 6) AS dollars, round(avg(value), 6) AS mean_s, round(avg(user_id + event_id), 6) AS mean_tokens FROM events""")
def usage(spark, sf_dir):
    """Cost and failures of calls; here events stand for calls."""
    answers = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    calls = load(spark, sf_dir, "events").select(answers.alias("answers"), F.col("user_id").alias("tokens_in"), F.col("event_id").alias("tokens_out"), F.col("value").alias("seconds"))
    return external.usage(calls, "large").select("n", "failed", *[F.round(c, 6).alias(c) for c in ("dollars", "mean_s", "mean_tokens")])


@query("""SELECT strftime(ts, '%Y-%m-%d') AS date, string_agg(user_id::VARCHAR || ': ' || event_type, chr(10) ORDER BY ts, event_id) AS transcript, count(*)::BIGINT AS n_lines FROM events GROUP BY 1""")
def day_transcripts(spark, sf_dir):
    e = load(spark, sf_dir, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    return sequences.day_transcripts(e, ["date"], ["ts", "event_id"], F.concat(F.col("user_id").cast("string"), F.lit(": "), "event_type"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL OR NOT (l.quality = 1 AND l.toxic = 0)")
def null_filters(spark, sf_dir):
    """Null tests, negation and a boolean column as the whole predicate."""
    d = load(spark, sf_dir, "documents").select("doc_id").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return d.withColumn("wanted", F.col("quality").isNull() | ~good).where("wanted").select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' OR l_linestatus = 'A' OR l_returnflag = 'N' AND l_linestatus = 'N'")
def partner_filter(spark, sf_dir):
    """Messages of or to a partner; here two flags stand for sender and receiver."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("from"), F.col("l_linestatus").alias("to"))
    return human.with_partner(li, "A").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey AS id, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN 'one' ELSE 'many' END AS kind FROM lineitem GROUP BY 1")
def chunk_split(spark, sf_dir):
    nodes = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_suppkey").alias("chunk_ids"))
    one, many = relational.split_by_chunks(nodes)
    return one.select("id", F.lit("one").alias("kind")).unionByName(many.select("id", F.lit("many").alias("kind")))


@query("SELECT d.doc_id, d.lang, l.quality::VARCHAR AS quality, l.toxic::VARCHAR AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def attach_results(spark, sf_dir):
    """Results of rows beside them, found by key and not by place."""
    return relational.attach(load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic")), "doc_id")


@query("SELECT n_regionkey, n_nationkey % 2 AS odd, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1, 2")
def collect_except(spark, sf_dir):
    n = load(spark, sf_dir, "nation").select("n_regionkey", (F.col("n_nationkey") % 2).alias("odd"), "n_name")
    return relational.collect_except(n, "n_name").select("n_regionkey", "odd", F.array_join("n_name", ",").alias("names"))


@query("SELECT min(o_orderdate) AS first, max(o_orderdate) AS last, round(avg(o_totalprice), 4) AS mean, count(*)::BIGINT AS n, count(DISTINCT o_custkey)::BIGINT AS customers FROM orders")
def frame_scalars(spark, sf_dir):
    return load(spark, sf_dir, "orders").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("""WITH s AS (SELECT o_custkey, CASE WHEN o_custkey % 7 > 0 THEN count(*) END AS n FROM orders GROUP BY 1) SELECT o_custkey, coalesce(n, -1)::BIGINT AS n, (SELECT sum(n) FROM s)::BIGINT AS total, row_number() OVER (ORDER BY n DESC NULLS FIRST, o_custkey) - 1 AS place FROM s""")
def ranked_with_total(spark, sf_dir):
    """Largest first, nulls before all, with the total beside each."""
    s = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("o_custkey") % 7 > 0, F.col("n")))
    ranked = relational.ranked_with_total(s, "n", "o_custkey")
    return sequences.with_row_index(ranked, F.col("n").desc_nulls_first(), "o_custkey", name="place").withColumn("n", F.coalesce("n", F.lit(-1)))


@query("""SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY md5(l_partkey::VARCHAR || '|' || l_orderkey::VARCHAR), l_partkey) AS parts FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1""")
def shuffled_lists(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("a"))
    return g.select("l_orderkey", F.array_join(relational.shuffled_list(F.col("a"), F.col("l_orderkey")).cast("array<string>"), ",").alias("parts"))


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n::BIGINT AS n, repeat('#', ceil(n * 40 / (SELECT max(n) FROM c))::INT) AS bar FROM c""")
def histogram(spark, sf_dir):
    return relational.histogram(load(spark, sf_dir, "events"), "event_type")


@query("SELECT l_orderkey, round(exp(avg(l_discount)), 9) AS perplexity FROM lineitem GROUP BY 1")
def perplexity(spark, sf_dir):
    """Of lists of log-probabilities; here discounts stand for them."""
    g = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(-F.col("l_discount")).alias("p"))
    return g.select("l_orderkey", F.round(external.perplexity(F.col("p")), 9).alias("perplexity"))


@query("SELECT event_id, round(least(greatest(value, 20.0), 80.0), 9) AS clamped, round(1.0 + (least(greatest(value, 20.0), 80.0) - 20.0) / 60.0 * 4.0, 9) AS size, rtrim(event_type || 'sss', 's') AS kind FROM events")
def scaled_values(spark, sf_dir):
    """Values kept in a range, put on a line, and names without the plural's ending."""
    v = F.col("value")
    return load(spark, sf_dir, "events").select("event_id", F.round(numbers.clamp(v, 20.0, 80.0), 9).alias("clamped"), F.round(numbers.interpolate(v, 20.0, 80.0, 1.0, 5.0), 9).alias("size"), text.without_trailing(F.concat("event_type", F.lit("sss"))).alias("kind"))
