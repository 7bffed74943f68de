"""Personal data: fixed kinds by pattern, and terms that disclose a protected value by how the corpus uses them together."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256
from math import log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, enter, free_names, ship, small_batches, table

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
#: What is protected beside these: values that a name calls secret, and long strings of letters and digits of at least so many characters and bits a character.
SECRET, SECRET_CHARS, SECRET_BITS = "secret", 16, 3.0
#: Words that a task counts before it puts their counts out.
HELD_WORDS = 200_000
#: Words on either side of a protected value that are held against it: so many of any length, and so many of LONG letters or more.
WINDOW, LONG = 5, 4
#: Different surroundings in which term and value must meet before the corpus counts as evidence.
SUPPORT = 3
#: Share of a value's information that a term gives away: from GENERALISE on it is replaced by its kind, from REMOVE on removed.
GENERALISE, REMOVE = 0.7, 0.85
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_not_local = re.compile(r"[^A-Za-z0-9._%+-]")
# a start inside a run of digits can match only what the run's start matches, so runs are tried once
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_assigned = re.compile(r"[:=][ \t]*[\"']?([^\s\"',;]{6,})")
_secret_name = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|(?:api|access|private|auth)[ _-]?key|credentials?)[\"']?[ \t]*\Z", re.IGNORECASE)
_dense = re.compile(rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{{SECRET_CHARS},}}+")
_word = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from the at signs, so that a long run without one costs nothing."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done:
            step = max(done, start - 64)
            part = text[step:start]
            cut_at = max((m.end() for m in _not_local.finditer(part)), default=None)
            if cut_at is not None:
                start = step + cut_at
                break
            start = step
        if start < at and (m := _domain.match(text, at + 1)):
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed kinds, by kind and then start; matches that fail a test are dropped, not tried anew."""
    out = [("email", a, b) for a, b in emails(text)]
    if _digit.search(text):
        out += [("ip", *m.span()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _card.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _phone.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return out


def bits(value: str) -> float:
    """Entropy of a string's characters, in bits a character."""
    return -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values())


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Credentials that overlap no base span: values with a digit behind a name for secrets, and dense strings of letters and digits."""
    if not _digit.search(text):
        return []
    found = {m.span(1) for m in _assigned.finditer(text) if _digit.search(m[1]) and _secret_name.search(text, max(0, m.start() - 24), m.start())}
    for m in _dense.finditer(text):
        digits = sum(map(str.isdigit, m[0]))
        if (digits >= 2 or digits and m[0].isupper()) and sum(map(str.isalpha, m[0])) >= 2 and bits(m[0]) >= SECRET_BITS:
            found.add(m.span())
    out, done = [], 0
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if a >= done and not any(a < y and x < b for _, x, y in base):
            out.append((SECRET, a, b))
            done = b
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def around(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, str, int, int, int]]:
    """For every protected value: the words near it, as (value, term, start, end, surroundings); values and surroundings are hashes."""
    out = []
    taken = sorted((a, b) for _, a, b in spans)
    words = [m.span() for m in _word.finditer(text)]
    kinds = [([s for s, _ in w], [e for _, e in w], w) for w in (words, [(s, e) for s, e in words if e - s >= LONG])]
    for kind, a, b in spans:
        value = re.sub(r"[^0-9+]", "", text[a:b]) if kind in ("card", "phone") else text[a:b].lower()
        # whole words only: one that reaches into the value is neither before nor behind it
        near = set()
        for starts, ends, held in kinds:
            n, m = bisect_right(ends, a), bisect_left(starts, b)
            near.update(held[max(0, n - WINDOW) : n], held[m : m + WINDOW])
        near = [(s, e) for s, e in sorted(near) if not any(s < y and x < e for x, y in taken)]
        terms = [text[s:e].lower() for s, e in near]
        h = lambda x: int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        of, where = h(f"{kind}:{value}"), h(" ".join(terms))
        out += [(of, t, s, e, where) for t, (s, e) in zip(terms, near, strict=True)]
    return out


def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("pii")
    near_type = pa.list_(pa.struct([("value", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("surroundings", pa.int64())]))
    for batch in batches:
        counts, base, near, secret = [[] for _ in KINDS], [], [], []
        for text in batch.column(2).to_pylist():
            spans = base_spans(text or "")
            secrets = secret_spans(text or "", spans)
            secret.append(joined(secrets))
            for k, kind in enumerate(KINDS):
                counts[k].append(sum(s[0] == kind for s in spans))
            base.append(joined(spans))
            near.append([dict(zip(("value", "term", "start", "end", "surroundings"), x, strict=True)) for x in around(text, spans + secrets)] if spans or secrets else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(base), pa.array([sha256(b.encode()).hexdigest() for b in base]), pa.array(secret), pa.array(near, near_type)], ["doc_id", "row", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "secret", "near"])


NEAR = "array<struct<value: long, term: string, start: long, end: long, surroundings: long>>"


def disclosing(found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame | None:
    """(value, term, share): terms whose use gives away at least GENERALISE of a value's information, as a table; None without any.

    share = log(p(value, term) / (p(value) p(term))) / -log p(value), over documents. How many documents hold a term is
    counted over all of them, for terms that meet a value in SUPPORT different surroundings (copies of a text are one).
    """
    pairs = found.select("row", F.explode("near").alias("x")).select("row", "x.*")
    met = cut(pairs.groupBy("value", "term").agg(F.count_distinct("row").alias("n_both"), F.count_distinct("surroundings").alias("places")).where(F.col("places") >= SUPPORT), "met")
    terms = cut(met.select("term").distinct(), "terms")
    n_terms = terms.count()
    if not n_terms:
        return None
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in terms.toLocalIterator())) if n_terms <= BROADCAST_ROWS // 10 else None

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("pii")
        counts: dict[str, int] = {}

        def drain() -> pd.DataFrame:
            out = pd.DataFrame({"term": list(counts), "n": list(counts.values())}).astype({"term": object, "n": "int64"})
            counts.clear()
            return out

        for pdf in batches:
            for text in pdf["text"]:
                words = set(_word.findall((text or "").lower()))
                for t in words & wanted.value if wanted else words:
                    counts[t] = counts.get(t, 0) + 1
                if len(counts) > HELD_WORDS:
                    yield drain()
        yield drain()

    n_term = rows.mapInPandas(held, "term string, n long")
    n_term = (n_term if wanted else n_term.join(terms, "term", "left_semi")).groupBy("term").agg(F.sum("n").alias("n_term"))
    n_value = found.select("row", F.explode(F.array_distinct(F.transform("near", lambda x: x["value"]))).alias("value")).groupBy("value").agg(F.count("*").alias("n_value"))
    total = float(found.count())
    joint = F.log(F.col("n_both") * total / (F.col("n_value") * F.greatest("n_term", "n_both")))
    share = met.join(n_value, "value").join(n_term, "term").where(F.col("n_value") < total).select("value", "term", (joint / F.log(total / F.col("n_value"))).alias("share"))
    return cut(share.where(F.col("share") >= GENERALISE), "disclosing")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_private (base and secret values), n_term.

    spans holds the base spans, then kind 'secret', and then kinds 'general' and 'removed' for terms that disclose a value near them, each in order of start;
    offsets are code points. Null texts are empty; empty texts have no spans; long ones are searched whole, and rows that repeat count one by one (their terms once, as
    one surrounding). A span that two values would have removed and generalised is removed. An empty table gives no rows; columns besides the two are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    found = cut(rows.mapInArrow(detect, f"doc_id long, row long, {counts}, base string, base_sha256 string, secret string, near {NEAR}"), "found")
    n_secret = F.when(F.col("secret") == "", 0).otherwise(F.size(F.split("secret", ","))).cast("long")
    found = found.withColumn("n_secret", n_secret).withColumn("n_private", sum((F.col(f"n_{k}") for k in KINDS), F.col("n_secret")))
    cols = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256"]
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    if (terms := disclosing(found, docs, text_col)) is None:
        return found.select(*cols, F.concat_ws(",", some("base"), some("secret")).alias("spans"), "n_secret", "n_private", F.lit(0).cast("long").alias("n_term"))
    at = found.where(F.size("near") > 0).select("row", F.explode("near").alias("x")).select("row", "x.value", "x.term", "x.start", "x.end")
    hit = at.join(terms, ["value", "term"]).groupBy("row", "start", "end").agg(F.max("share").alias("share"))
    kind = F.when(F.col("share") >= REMOVE, F.lit("removed")).otherwise(F.lit("general"))
    hit = hit.select("row", F.struct(kind.alias("kind"), "start", "end").alias("s")).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("more"))
    more = F.array_join(F.transform("more", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = found.drop("near").join(hit, "row", "left")
    return out.select(*cols, F.concat_ws(",", some("base"), some("secret"), F.when(F.col("more").isNotNull(), more)).alias("spans"), "n_secret", "n_private", F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_term"))


def redact(docs: DataFrame, private: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of its text replaced: base kinds and general terms by their name in brackets, removed terms by nothing.

    private has doc_id and spans, one row a document. Spans that overlap an earlier one are cut to what is left of them. Rows without spans stay as they are.
    """

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t: str | None, s: str | None) -> str | None:
            if not t or not s:
                return t
            out, at = [], 0
            for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(","))), key=lambda x: x[1:]):
                if b > at:
                    out += [t[at : max(a, at)], "" if kind == "removed" else "[TERM]" if kind == "general" else f"[{kind.upper()}]"]
                    at = b
            return "".join([*out, t[at:]])

        return pd.Series([one(t, s) for t, s in zip(text, spans, strict=True)])

    held, key = free_names(docs, "pii_spans", "pii_id")
    spans = private.select(F.col("doc_id").alias(key), F.col("spans").alias(held))
    return docs.join(spans, F.col(id_col).cast("long") == F.col(key), "left").withColumn(text_col, cleaned(F.col(text_col), F.col(held))).select(*docs.columns)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private(table(spark, sf_dir, "documents"))
