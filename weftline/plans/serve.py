"""The query service: similar nodes, chains, relatives, raw text, and SQL with vectors over the graph's tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import node_datetime
from ..operators import graph
from ..operators.proximity_graph import BEAM, search_index
from ..operators.relational import without_embeddings
from ..operators.vector_search import top_similar

#: Statements that may be asked for.
READS = re.compile(r"^\s*(?:SELECT|WITH|VALUES|TABLE|FROM)\b", re.IGNORECASE)
#: Ends of statements that an index answers, and words of statements that look at more than the nearest nodes.
NEAREST = re.compile(r"ORDER\s+BY\s+[\w.\"]*embedding\"?\s*<->\s*[\w.\"]*embedding\"?\s*(?:ASC\s+)?LIMIT\s+(\d+)\s*;?\s*$", re.IGNORECASE)
WIDER = re.compile(r"\b(?:JOIN|GROUP|HAVING|UNION|INTERSECT|EXCEPT|DISTINCT|OVER|WITH|RawDataChunk|count|sum|avg|min|max)\b", re.IGNORECASE)
_distance = {"<=>": ("", "cosine_distance"), "<->": ("", "l2_distance"), "<#>": ("-", "inner_product")}
_operand = r"(?:\((?:[^()]|\([^()]*\))*\)|[`\w.]+(?:\((?:[^()]|\([^()]*\))*\))?)"


def translate(sql: str) -> str:
    """SQL with vector operators and double-quoted names as Spark spells them; string literals are left alone."""
    parts = re.split(r"('(?:[^']|'')*')", sql)
    for k in range(0, len(parts), 2):
        t = re.sub(r'"((?:[^"]|"")*)"', lambda m: f"`{m[1]}`", parts[k])
        for sign, (minus, name) in _distance.items():
            t = re.sub(rf"({_operand})\s*{re.escape(sign)}\s*({_operand})", lambda m, minus=minus, name=name: minus + V.sql_of(name, m[1], m[2]), t)
        parts[k] = re.sub(r"::\s*vector(?:\(\d+\))?", "", t)
    return "".join(parts)


class Service:
    """Answers over nodes(id, proposition, datetimes, frequency, chunk_ids, edges, embedding) and chunks(chunk_id, messages_str, embedding)."""

    def __init__(self, nodes: DataFrame, chunks: DataFrame, embedder, reducer=None, size: int | None = None, tables: dict[str, DataFrame] | None = None, index: DataFrame | None = None) -> None:
        """index: a proximity graph of the nodes' embeddings (build_index); nearest-node statements then read only what a search of it finds."""
        self.index = index
        self.spark: SparkSession = nodes.sparkSession
        self.nodes, self.chunks, self.embedder, self.reducer, self.size, self.tables = nodes, chunks, embedder, reducer, size, tables or {}
        self.all_nodes, self.edges = graph.build(nodes)

    def told(self, ids: DataFrame) -> DataFrame:
        shown = ids.join(self.nodes, "id", "left")
        return shown.select("id", F.col("proposition").alias("description"), node_datetime(F.coalesce("datetimes", F.array().cast("array<string>"))).alias("datetime"), "frequency")

    def vector(self, text: str) -> list[float]:
        v = self.embedder.embed([text])[0]
        if self.reducer is None:
            return v
        from ..operators.vector_search import apply_pca

        df = self.spark.createDataFrame([(v,)], "e array<double>")
        return list(apply_pca(df, self.reducer, "e", self.size).first()["reduced_embedding"])

    def similar_nodes(self, query: str, k: int = 10, least: float = 0.6) -> DataFrame:
        return top_similar(self.nodes.select("id", "proposition", "datetimes", "frequency", "embedding"), self.vector(query), "id", "embedding", k, least).select("id", F.col("proposition").alias("description"), node_datetime(F.col("datetimes")).alias("datetime"), "frequency", "sim")

    def causal_chain(self, first: str, second: str) -> list[str]:
        return graph.causal_chain(self.nodes, self.edges, first, second)

    def children(self, node_id: str, depth: int = 1) -> DataFrame:
        return self.told(graph.relatives(self.edges, node_id, "children", depth).select("id"))

    def parents(self, node_id: str, depth: int = 1) -> DataFrame:
        return self.told(graph.relatives(self.edges, node_id, "parents", depth).select("id"))

    def raw_data(self, node_id: str) -> str:
        return graph.raw_chunk(self.nodes, self.chunks, node_id)

    def sql_query(self, query: str, to_embed_nodes: Sequence[str] = (), to_embed_raw_data: Sequence[str] = ()) -> DataFrame:
        """Rows of a reading statement over the tables and QueryEmbedding(id, type, embedding), without embedding columns.

        Ids of query embeddings count from 1 inside each type, node and raw_data. Every call has a session of its own, so its views go with it. With an index a statement
        on nodes alone that ends in ORDER BY embedding <-> embedding LIMIT n reads the nodes that a search finds for each query embedding; its conditions choose among those.
        """
        if not READS.match(query) or ";" in query.rstrip().rstrip(";"):
            raise ValueError("only one reading statement is answered")
        session = self.spark.newSession()
        session.conf.set("spark.sql.session.timeZone", "UTC")
        V.register_sql(session)
        rows = [(k, kind, self.vector(t)) for kind, texts in (("node", to_embed_nodes), ("raw_data", to_embed_raw_data)) for k, t in enumerate(texts, 1)]
        nodes = self.nodes
        if self.index is not None and rows and (nearest := NEAREST.search(query)) and not WIDER.search(query):
            asked = self.spark.createDataFrame([(k, v) for k, (_, _, v) in enumerate(rows)], "query_id int, q array<double>")
            near = search_index(self.index, asked, max(int(nearest[1]), BEAM))
            nodes = nodes.join(near.select("id").distinct(), "id", "left_semi")
        for name, df in {"CausalGraphNode": nodes, "RawDataChunk": self.chunks, **self.tables}.items():
            self.view(session, df, name)
        session.createDataFrame(rows, "id int, type string, embedding array<double>").createOrReplaceTempView("QueryEmbedding")
        return without_embeddings(session.sql(translate(query.rstrip().rstrip(";"))))

    def view(self, session: SparkSession, df: DataFrame, name: str) -> None:
        shared = f"weftline_{id(df)}_{name}"
        df.createOrReplaceGlobalTempView(shared)
        session.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM global_temp.{shared}")

    def tools(self, most: int = 100) -> dict:
        """The five tools and SQL, for an agent: answers are plain values. Of a longer answer the first `most` rows are shown, and a last one says so."""

        def rows(df: DataFrame) -> list[dict]:
            found = [r.asDict() for r in df.limit(most + 1).collect()]
            return found if len(found) <= most else [*found[:most], {"more": f"only the first {most} rows are shown"}]

        return {
            "similarNodes": lambda query: rows(self.similar_nodes(query)),
            "causalChain": lambda node_id1, node_id2: self.causal_chain(node_id1, node_id2),
            "children": lambda node_id, depth=1: rows(self.children(node_id, depth)),
            "parents": lambda node_id, depth=1: rows(self.parents(node_id, depth)),
            "rawData": lambda node_id: self.raw_data(node_id),
            "sqlQuery": lambda query, nodes=(), raw_data=(): rows(self.sql_query(query, nodes, raw_data)),
        }
