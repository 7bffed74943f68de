"""Readers: record arrays, archives in zip files, nested exports, SQL tables, GraphML."""

from __future__ import annotations

import io
import json
import re
import sqlite3
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import apple_time
from .tables import cut

RAW_MESSAGES = "datetime string, content string, `from` string, from_phone_number string, `to` string, to_phone_number string, message_type int, media_title string"
MESSAGES = "`from` string, from_phone_number string, `to` string, to_phone_number string, datetime timestamp, content string, count int"
ARCHIVE_MESSAGES = "conversation_id string, title string, place int, role string, create_time double, text string"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files that hold an array of records each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    df = read_records(spark, path, MESSAGES.replace("datetime timestamp", "datetime string"))
    return df.withColumn("datetime", F.try_to_timestamp("datetime"))


def zip_members(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(path, text) of a named member of zip files; files that are not zip files are taken as they are. Empty or missing members are errors."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                data = bytes(content)
                if zipfile.is_zipfile(io.BytesIO(data)):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        if member not in z.namelist():
                            raise ValueError(f"{name} has no {member}")
                        data = z.read(member)
                if not data.strip():
                    raise ValueError(f"{name} is empty")
                out.append((name, data.decode("utf-8")))
            yield pd.DataFrame(out, columns=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(opened, "path string, text string")


def read_archive(spark: SparkSession, path: str, member: str = "conversations.json") -> DataFrame:
    """Messages of assistant exports in their own order: objects keep their keys' order here, which maps would lose."""

    def flat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                for conversation in json.loads(text):
                    place = 0
                    for entry in (conversation.get("mapping") or {}).values():
                        m = (entry or {}).get("message")
                        if m and (m.get("author") or {}).get("role"):
                            parts = [p for p in ((m.get("content") or {}).get("parts") or []) if isinstance(p, str)]
                            rows.append((conversation.get("id") or conversation.get("conversation_id"), conversation.get("title"), place, m["author"]["role"], m.get("create_time"), "\n".join(parts)))
                            place += 1
            yield pd.DataFrame(rows, columns=["conversation_id", "title", "place", "role", "create_time", "text"])

    return zip_members(spark, path, member).mapInPandas(flat, ARCHIVE_MESSAGES)


def parsed_conversations(messages: DataFrame, keep_empty: bool = True) -> DataFrame:
    """conversation_id, title, date, time, question, answer (all strings) of an archive's messages. keep_empty=False makes '' null, as a CSV round trip does."""
    from ..operators.sequences import question_answers

    qa = question_answers(messages, "conversation_id", "place", "role", "text")
    out = messages.select("conversation_id", "place", "title", "create_time").join(qa, ["conversation_id", "place"])
    at = F.timestamp_seconds("create_time")
    out = out.select("conversation_id", "title", F.date_format(at, "yyyy-MM-dd").alias("date"), F.date_format(at, "HH:mm:ss").alias("time"), "question", "answer")
    return out if keep_empty else out.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns])


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns strings and '' as null."""
    return spark.read.option("header", True).option("nullValue", "").option("multiLine", True).option("escape", '"').csv(path)


def read_sql(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query's rows through JDBC; the driver's jar comes with the session."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str) -> DataFrame:
    """A query's rows from every SQLite file under path, a file a task; files come through Spark, so they may be in any store. schema: the query's columns in their order."""
    names = [f.name for f in StructType.fromDDL(schema)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                db = sqlite3.connect(":memory:")
                try:
                    db.deserialize(bytes(content))
                    yield pd.DataFrame(db.execute(query).fetchall(), columns=names, dtype=object)
                finally:
                    db.close()

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


#: Tables of a phone's chat store, as chat_export wants them. The names of its tables and columns are fixed values.
CHAT_STORE = {
    "messages": ("SELECT ZCHATSESSION, ZGROUPMEMBER, ZISFROMME, ZMESSAGEDATE, ZTEXT, ZMESSAGETYPE, NULL FROM ZWAMESSAGE", "session long, member long, from_me int, date double, text string, type int, title string"),
    "sessions": ("SELECT Z_PK, ZCONTACTJID, ZPARTNERNAME FROM ZWACHATSESSION", "id long, jid string, name string"),
    "members": ("SELECT Z_PK, ZMEMBERJID, ZCONTACTNAME FROM ZWAGROUPMEMBER", "id long, jid string, name string"),
}


def read_chat_store(spark: SparkSession, path: str) -> DataFrame:
    """Raw messages of the chat stores under path."""
    return chat_export(*(read_sqlite(spark, path, query, schema) for query, schema in CHAT_STORE.values()))


def chat_export(messages: DataFrame, sessions: DataFrame, members: DataFrame) -> DataFrame:
    """Raw messages of a phone's chat store: messages(session, member, from_me, date, text, type, title) with sessions(id, jid, name) and, for groups, members(id, jid, name).

    Dates are seconds since 2001; status and group sessions are left out; directions come from from_me.
    """
    s = sessions.where(~F.col("jid").like("%status%") & ~F.col("jid").like("%@g.us%")).select(F.col("id").alias("session"), F.col("jid"), F.col("name").alias("partner"))
    m = members.select(F.col("id").alias("member"), F.col("name").alias("member_name"))
    df = messages.join(s, "session").join(m, "member", "left")
    number, who = F.split_part("jid", F.lit("@"), F.lit(1)), F.coalesce("member_name", "partner")
    mine = F.col("from_me") == 1
    return df.select(
        F.date_format(apple_time(F.col("date")), "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.col("text").alias("content"),
        F.when(mine, "me").otherwise(who).alias("from"), F.when(mine, "me").otherwise(number).alias("from_phone_number"),
        F.when(mine, who).otherwise("me").alias("to"), F.when(mine, number).otherwise("me").alias("to_phone_number"),
        F.col("type").cast("int").alias("message_type"), F.col("title").alias("media_title"),
    )


def partners(users: DataFrame, phones: DataFrame, numbers: Sequence[str]) -> DataFrame:
    """(phone, name) of phone numbers."""
    return phones.where(F.col("phone").isin(*numbers)).join(users, phones["user_id"] == users["id"]).select("phone", "name")


def lookup(df: DataFrame, condition: Column):
    """The first row that fits, or None."""
    return df.where(condition).limit(1).first()


def limited(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in order; all of them without n."""
    return df if n is None else df.orderBy(*order).limit(n)


def under_prefix(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """Parquet files of a store under a prefix."""
    return spark.read.parquet(f"{root.rstrip('/')}/{prefix.strip('/')}")


GRAPHML_ROWS = "kind string, file string, block long, at long, a string, b string, attributes map<string, string>"
_TAG = re.compile(r"""(/?[^\s/>]+)((?:[^>"']|"[^"]*"|'[^']*')*)>(.*)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_REFERENCE = re.compile(r"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|(lt|gt|amp|quot|apos));")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def _plain(text: str) -> str:
    return _REFERENCE.sub(lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2])) if m[2] else _NAMED[m[3]], text) if "&" in text else text


def graphml_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of what follows each '<' of a file, in order. A node that a block of the file leaves open, and data that a block begins with, are parts, to be joined across blocks.

    'odd' rows name files with what this can't tell from tags (comments, CDATA, document types, nodes in nodes), 'end' rows those that end as they should.
    """
    where, node, edge, at = None, None, False, 0
    for pdf in batches:
        out = []
        for said, file, block in zip(pdf["value"], pdf["file"], pdf["block"], strict=True):
            if where != (file, block):
                if node is not None:
                    out.append(("part", *where, at, node[0], None, node[1]))
                where, node, edge, at = (file, block), None, False, 0
            if not said or said.isspace() or said == "\ufeff":
                continue
            at += 1
            if not (tag := _TAG.match(said)):
                out.append(("odd", file, block, at, None, None, {}))
                continue
            shut, name = tag[1].startswith("/"), tag[1].lstrip("/").rpartition(":")[2]
            if not shut and name in ("data", "node", "edge", "key"):
                given = {k: _plain(re.sub(r"\r\n|[\r\n\t]", " ", x or y)) for k, x, y in _ATTRIBUTE.findall(tag[2])}
                closed = tag[2].endswith("/")
                if name == "data":
                    if not edge:
                        pair = {given.get("key"): "" if closed else _plain(tag[3].replace("\r\n", "\n").replace("\r", "\n"))}
                        if node is None:
                            out.append(("part", file, block, at, None, None, pair))
                        else:
                            node[1].update(pair)
                elif name == "key":
                    out.append(("key", file, block, at, given.get("id"), given.get("attr.name"), {}))
                elif name == "edge":
                    out.append(("edge", file, block, at, given.get("source"), given.get("target"), {}))
                    edge = not closed
                elif node is not None:
                    out.append(("odd", file, block, at, None, None, {}))
                elif closed:
                    out.append(("node", file, block, at, given.get("id"), None, {}))
                else:
                    node = (given.get("id"), {})
            elif shut:
                if name == "node":
                    out.append(("close", file, block, at, None, None, {}) if node is None else ("node", file, block, at, node[0], None, node[1]))
                    node = None
                elif name == "edge":
                    edge = False
                elif name == "graphml":
                    out.append(("end", file, block, at, None, None, {}))
            elif name == "graph":
                out.append(("graph", file, block, at, None, None, {}))
            elif name.startswith("!") or "\0" in said or name == "?xml" and "encoding" in tag[2] and not re.search("(?i)utf-8|ascii", tag[2]):
                out.append(("odd", file, block, at, None, None, {}))
        yield pd.DataFrame(out, columns=["kind", "file", "block", "at", "a", "b", "attributes"])
    if node is not None:
        yield pd.DataFrame([("part", *where, at, node[0], None, node[1])], columns=["kind", "file", "block", "at", "a", "b", "attributes"])


def joined_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a file that reach over blocks: at most the open end and the begin of each block."""
    done, node = [], None
    for kind, a, pairs in pdf.sort_values(["block", "at"])[["kind", "a", "attributes"]].itertuples(index=False):
        if kind == "part" and a is not None:
            node = (a, dict(pairs))
        elif kind == "part" and node is not None:
            node[1].update(pairs)
        elif kind == "close" and node is not None:
            done.append((pdf["file"].iloc[0], *node))
            node = None
    return pd.DataFrame(done, columns=["file", "a", "attributes"])


def whole_graphml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for content in pdf["content"]:
            root = ElementTree.fromstring(bytes(content))
            ns = root.tag.partition("}")[0] + "}" if "}" in root.tag else ""
            names = {k.get("id"): k.get("attr.name") for k in root.iter(f"{ns}key")}
            rows += [("node", n.get("id"), None, {names.get(d.get("key"), d.get("key")): d.text or "" for d in n.iter(f"{ns}data")}) for n in root.iter(f"{ns}node")]
            rows += [("edge", e.get("source"), e.get("target"), {}) for e in root.iter(f"{ns}edge")]
        yield pd.DataFrame(rows, columns=["kind", "a", "b", "attributes"])


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of GraphML files: nodes(id, attributes map), edges(src, dst).

    A file is cut at every '<' by Spark's text reader, so any number of tasks read it; what reaches over their blocks is joined after. Files whose tags alone don't tell
    (see graphml_rows) are parsed whole, one task a file, as are those without an end, whose errors are raised there.
    """
    said = spark.read.option("lineSep", "<").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = cut(said.mapInPandas(graphml_rows, GRAPHML_ROWS), "graphml")
    seen = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    count = lambda kind: F.count_if(F.col("kind") == kind)
    fine = {r["file"] for r in rows.groupBy("file").agg(count("end").alias("e"), count("odd").alias("o"), count("graph").alias("g")).where("e = 1 AND o = 0 AND g <= 1").collect()}
    odd = [r["file"] for r in seen.collect() if r["file"] not in fine]
    if odd:
        rows = rows.where(~F.col("file").isin(odd))
    parts = rows.where("kind IN ('part', 'close')").select("file", "block", "at", "kind", "a", "attributes").groupBy("file").applyInPandas(joined_parts, "file string, a string, attributes map<string, string>")
    names = rows.where("kind = 'key'").groupBy("file").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("a", "b")))).alias("names"))  # one row a file
    held = rows.where("kind = 'node'").select("file", "a", "attributes").unionByName(parts).join(F.broadcast(names), "file", "left")
    nodes = held.select(F.col("a").alias("id"), F.transform_keys("attributes", lambda k, _: F.coalesce(F.try_element_at("names", k), k)).alias("attributes"))
    edges = rows.where("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    if odd:
        whole = spark.read.format("binaryFile").load(path).where(F.col("_metadata.file_path").isin(odd)).select("content").mapInPandas(whole_graphml, "kind string, a string, b string, attributes map<string, string>")
        nodes = nodes.unionByName(whole.where("kind = 'node'").select(F.col("a").alias("id"), "attributes"))
        edges = edges.unionByName(whole.where("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return nodes, edges
