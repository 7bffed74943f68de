"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading splits files anywhere. Each task cuts its byte range at every occurrence of the magic and
emits candidate records with the offset where a successor must start. Chains are contracted inside
each range, pointer jumping over the ranges' entries finds what can be reached from the start of the file,
and only reachable candidates are records; a magic inside a payload never is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_sized, new_path, ship, table
from .exact_dedup import digest_key, merge_runs

ship(__name__)

MAGIC = "WARC/1."
CRLF = "\r\n"
GAP = "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_DATE = "2020-01-01T00:00:00Z"
ID_PREFIX = "urn:x-page:"


def revisits(pages: DataFrame, id_col: str, payload: Column, min_bytes: int) -> DataFrame:
    """(id, sha, refers_to) of pages whose payload of at least min_bytes bytes belongs to another page, as a table; sha is the payload's SHA-1, as an id may come with several."""
    rows = cut(pages.select(F.col(id_col).cast("long").alias("id"), payload.alias("payload")).where(F.octet_length("payload") >= min_bytes).select("id", F.sha1("payload").alias("sha"), digest_key(F.col("payload")).alias("key")), "payload-digests")
    return cut(merge_runs(rows).where("n > 1 AND id < win").select("id", "sha", F.col("win").alias("refers_to")).distinct(), "revisits")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = REVISIT_BYTES) -> None:
    """Write a WARC/1.1 record per row of pages to archives under path, one archive a task.

    A null payload is empty, a null url is left out, a null id is written as 'null' and never a revisit. Of records with equal payloads of at least
    min_bytes bytes the one with the largest id is a response; the others are revisits of it, without the payload. Rows
    that repeat an id and payload are all written alike, and an id that comes with several payloads has a record for each. Payloads of any length are written whole, and never shuffled: rows learn what they revisit
    through a table of the repeats only. Columns besides the three are not read. An empty table gives no records.
    """
    body = F.coalesce(F.col(payload_col), F.lit(""))
    again = revisits(pages, id_col, body, min_bytes)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col), r"[\r\n]", "").alias("url"), body.alias("body")).withColumn("sha", F.sha1(F.col("body").cast("binary")))
    rows = join_sized(rows, again, ["id", "sha"], "left")
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("body").cast("string"), F.lit(GAP))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    head = F.concat(
        F.lit(f"{MAGIC}1{CRLF}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "), name(F.col("id")),
        F.lit(f"{CRLF}WARC-Date: {WARC_DATE}"),
        F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Target-URI: "), F.col("url")), F.lit("")),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), name(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("sha"),
        F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "),
    )
    record = F.concat(head, F.octet_length(F.col("block")).cast("string"), F.lit(GAP), F.col("block"))
    rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", GAP).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The files under path cut at each magic: file, range (start of the byte range), seq (grows along a range), value."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("seq"), "value")


def header(name: str) -> Column:
    return F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t\r]*$", 1), F.lit(""))


def parsed(segs: DataFrame) -> DataFrame:
    """A row for each segment read as a record (what follows its magic): lengths, headers, and the payload's length and SHA-1 if the segment holds all of it."""
    df = segs.withColumn("size", F.octet_length("value").cast("long")).withColumn("head", F.substring_index("value", GAP, 1))
    df = df.withColumn("head_bytes", F.octet_length("head").cast("long"))
    well = F.col("head").rlike(r"^\d\r\n") & (F.col("head_bytes") < F.col("size"))
    df = df.withColumn("block_bytes", F.when(well, header("Content-Length").try_cast("long")))
    whole = F.col("size") >= F.col("head_bytes") + 4 + F.col("block_bytes")
    block = F.col("value").cast("binary").substr(F.col("head_bytes").cast("int") + 5, F.col("block_bytes").cast("int"))
    df = df.withColumn("block", F.when(whole, block)).withColumn("http", F.substring_index(F.col("block").cast("string"), GAP, 1))
    is_http = F.coalesce(header("Content-Type"), F.lit("")).startswith("application/http") & (F.octet_length("http") < F.octet_length("block"))
    payload = F.when(is_http, F.col("block").substr(F.octet_length("http") + 5, F.octet_length("block"))).otherwise(F.col("block"))
    said = F.regexp_extract(F.col("http"), r"(?im)^Content-Length:[ \t]*(\d+)", 1)
    return df.select(
        "file", "range", "seq", "size", "head_bytes", "block_bytes", whole.alias("whole"),
        header("WARC-Type").alias("type"), header("WARC-Record-ID").alias("record_id"), header("WARC-Target-URI").alias("uri"),
        header("WARC-Refers-To").alias("refers_to"), header("WARC-Payload-Digest").alias("digest"),
        F.when(is_http, F.nullif(said, F.lit(""))).cast("long").alias("http_bytes"), payload.alias("payload"),
    )


def followed(off: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """For candidates of one range, sorted: the index of the successor; len(off) if it lies behind the range; -1 if nothing starts there."""
    at = np.searchsorted(off, succ)
    inside = at < len(off)
    hit = np.where(inside, off[np.minimum(at, len(off) - 1)] == succ, True)
    return np.where(hit & (succ > off), at, -1)


def contract(pdf: pd.DataFrame) -> pd.DataFrame:
    """(file, off, leaves): where the chain from each candidate of a range leaves it; chains that break are left out."""
    pdf = pdf.sort_values("off", ignore_index=True)
    off, succ = pdf["off"].to_numpy(), pdf["succ"].fillna(-1).to_numpy(dtype=np.int64)
    nxt, leaves = followed(off, succ), np.full(len(pdf), -1, dtype=np.int64)
    for i in range(len(pdf) - 1, -1, -1):
        leaves[i] = succ[i] if nxt[i] == len(off) else leaves[nxt[i]] if nxt[i] >= 0 else -1
    out = pd.DataFrame({"file": pdf["file"], "off": off, "leaves": leaves})
    return out[out["leaves"] >= 0]


def reach(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mark the candidates of a range that its entries reach."""
    pdf = pdf.sort_values("off", ignore_index=True)
    off, succ = pdf["off"].to_numpy(), pdf["succ"].fillna(-1).to_numpy(dtype=np.int64)
    nxt, real = followed(off, succ), pdf["entry"].to_numpy(dtype=bool).copy()
    for i in range(len(pdf)):
        if real[i] and 0 <= nxt[i] < len(off):
            real[nxt[i]] = True
    return pd.DataFrame({"file": pdf["file"], "range": pdf["range"], "seq": pdf["seq"], "off": off, "real": real & (succ >= 0)})


def verified(segs: DataFrame) -> DataFrame:
    """(file, range, seq, off, real) of the candidates; segs is a table of file, range, seq, size, head_bytes, block_bytes."""
    sums = segs.groupBy("file", "range").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"), F.count("*").alias("k"))
    base = sums.selectExpr("file", "range", "sum(bytes) over (partition by file order by range) - bytes as base")
    cand = segs.join(base, ["file", "range"]).selectExpr("file", "range", "seq", "size", "head_bytes", "block_bytes", f"base + sum(size + {len(MAGIC)}) over (partition by file, range order by seq) - size - {2 * len(MAGIC)} as off")
    # what stands before the first magic of a file is no candidate
    cand = cand.where("off >= 0").withColumn("succ", F.expr(f"off + {len(MAGIC)} + head_bytes + 4 + block_bytes + 4"))
    cand = cut(cand.select("file", "range", "seq", "off", "succ"), "candidates")
    ranges = sums.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    if ranges > 1:
        jump = cand.groupBy("file", "range").applyInPandas(contract, "file string, off long, leaves long")
        # only candidates where a chain can enter a range matter from here: about one for each range
        jump = cut(jump, "jumps")
        ends = jump.select("file", F.col("leaves").alias("off")).distinct()
        jump = cut(jump.join(ends, ["file", "off"], "left_semi").unionByName(jump.where("off = 0")).distinct(), "entries")
        found = cand.where("off = 0").select("file", "off").distinct()
        for k in range(int(ranges - 1).bit_length()):  # after round k, found holds what 2^(k+1) - 1 jumps reach
            found = found.unionByName(found.join(jump, ["file", "off"]).select("file", F.col("leaves").alias("off"))).distinct()
            then = jump.select("file", F.col("off").alias("leaves"), F.col("leaves").alias("later"))
            jump = jump.join(then, ["file", "leaves"]).select("file", "off", F.col("later").alias("leaves"))
            found, jump = cut(found, f"found-{k}"), cut(jump, f"jump-{k}")
        found = found.withColumn("entry", F.lit(True))
        cand = cand.join(found, ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    else:
        cand = cand.withColumn("entry", F.col("off") == 0)
    return cand.groupBy("file", "range").applyInPandas(reach, "file string, range long, seq long, off long, real boolean")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record that the chain from the start of its file reaches.

    Columns: file, offset, type, record_id, uri, refers_to (record id), digest (as the header says, after its 'sha1:'), http_bytes (the HTTP header's
    length), payload_bytes and payload_sha1 (of the payload that is here; null for what a truncated file lacks). A file that
    does not start with a record gives none; records behind a broken link of the chain give none; an empty folder gives none.
    """
    fields = ["type", "record_id", "uri", "refers_to", "digest", "http_bytes", "payload_bytes", "payload_sha1"]
    digest = lambda df: df.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_sha1", F.sha1("payload")).withColumn("digest", F.regexp_replace("digest", "(?i)^sha1:", "")).drop("payload")
    segs = cut(digest(parsed(segments(spark, path))), "segments")
    marked = cut(verified(segs.select("file", "range", "seq", "size", "head_bytes", "block_bytes")), "marked")
    owner = F.expr("last(CASE WHEN real THEN off END, true) OVER (PARTITION BY file ORDER BY off)")
    torn = cut(marked.withColumn("owner", owner).where("NOT real AND owner IS NOT NULL").select("file", "owner").distinct(), "torn") if marked.where("NOT real").limit(1).count() else None
    real = segs.join(marked.where("real"), ["file", "range", "seq"]).select("file", F.col("off").alias("offset"), *fields)
    if torn is None or not torn.limit(1).count():
        return real
    # records with a magic inside: their segments are read again and put together
    parts = marked.withColumn("owner", owner).join(torn, ["file", "owner"]).select("file", "range", "seq", "off", "owner")
    parts = join_sized(segments(spark, path), cut(parts, "parts"), ["file", "range", "seq"], "inner")
    joined = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("all"))
    joined = joined.select("file", F.lit(0).cast("long").alias("range"), F.col("owner").alias("seq"), F.array_join(F.transform("all", lambda x: x["value"]), MAGIC).alias("value"))
    mended = digest(parsed(joined)).select("file", F.col("seq").alias("offset"), *fields)
    return real.join(torn.withColumnRenamed("owner", "offset"), ["file", "offset"], "left_anti").unionByName(mended)


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, rf"{ID_PREFIX}(-?\d+)", 1).try_cast("long")


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back; a revisit's length and digest are those its headers keep."""
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    got = read_warc(spark, path)
    revisit = F.col("type") == "revisit"
    return got.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("http_bytes")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("payload_sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, page_of(F.col("refers_to"))).alias("refers_to"),
    )


SQL = {
    "op1_warc_roundtrip": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS top FROM p)
        SELECT page_id, bytes::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN bytes >= {REVISIT_BYTES} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN bytes >= {REVISIT_BYTES} AND page_id < top THEN top END AS refers_to
        FROM g
    """
}
