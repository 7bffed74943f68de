"""Toxicity: a lexicon learned from labels, matched through Levenshtein automata, and scored in context windows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, enter, free_names, ship, small_batches, table
from .lexicon_automaton import Automaton, budget_of
from .minhash import bands_of
from .shingles import shingle_sets

ship(__name__)

#: The model is fitted on at most so many labelled documents, those with the smallest hashes; one of each group of near copies counts.
TRAIN_DOCS = 12_000
FOLDS = 5
#: Log-likelihood ratio and share of toxic documents that a term needs.
MIN_RATIO, MIN_PURE = 27.0, 0.9
PREFIXES = range(4, 8)
WINDOW = 6
#: Words and terms that a task holds at once.
SEEN_WORDS, HELD_TERMS = 100_000, 50_000
#: Signs written for letters, and words that stand near reports and near addresses.
LEET = str.maketrans("01345789@$!|", "oieastbgasii")
REPORTS = frozenset("said says say called calls wrote writes quote quoted quotes word term sagte sagt nannte schrieb zitat wort dit écrit appelé mot citation dijo dice llamó escribió palabra cita".split())
ADDRESS = frozenset("you your you're youre u ur du dich dir dein deine ihr euch tu te toi ton vous votre usted ustedes ti tú tus".split())
_marks = re.compile("[\"“”„«»\\n]")
_ends = re.compile(r"^[\W_]+|[\W_]+$")
_inner = re.compile(r"[^\w@$!|]+|_+")
#: Prior means of the weights: bias, exact, misspelt, quoted, addressed, reported.
PRIOR = np.array([-3.0, 6.0, 7.0, 0.7, 1.0, -2.0])


def edits_for(term: str, is_open: bool) -> int:
    """Edits allowed for a term of the lexicon: an open prefix of 5 or more characters has one, whole words have their own."""
    return int(len(term) >= 5) if is_open else budget_of(term, False)


def words_in(token: str) -> list[str]:
    """The words of a lower-case token as the lexicon spells them."""
    out = []
    for part in _inner.split(_ends.sub("", token)):
        out.append(part)
        if part and not part.isalpha() and any(c.isalpha() for c in part):
            out.append(part.translate(LEET))
    return [w for w in out if len(w) > 2]


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between paired marks, of any length and over any lines, and lines after '>'; a mark without a partner quotes nothing.

    A straight mark opens before a word and closes behind one, so neither an inch sign nor a lost mark turns the pairs around; one that opens a line
    inside a quotation goes on with it, and one that opens elsewhere starts anew.
    """
    out, line = [], 0
    straight, double, angle = -1, [], []
    for m in _marks.finditer(text + "\n"):
        at, c = m.start(), m[0]
        if c == "\n":
            if text.startswith(">", line):
                out.append((line, at))
            line = at + 1
        elif c == '"':
            before, after = text[at - 1 : at], text[at + 1 : at + 2]
            opens = bool(after.strip()) and not (before.isalnum() or before in tuple(".,;:!?…)"))
            closes = bool(before.strip()) and not after.isalnum()
            if straight >= 0 and (closes or not opens):
                out.append((straight, at + 1))
                straight = -1
            elif opens and (straight < 0 or text[line:at].strip()):
                straight = at
        else:
            held = angle if c in "«»" else double
            top = text[held[-1]] if held else ""
            if c == "„" or c == "“" and top != "„" or c == "«" and top != "»" or c == "»" and top != "«":
                held.append(at)
            elif held:
                out.append((held.pop(), at + 1))
    return out


def situations(lower: str, tokens: list[str]) -> Iterator[tuple[str, bool, bool]]:
    """(token, quoted, reported) of the tokens of a lower-case text: inside a quotation, and at most WINDOW tokens behind a word of report."""
    spans = sorted(quotations(lower))
    at, k, reach, report = 0, 0, -1, -WINDOW - 1
    for n, token in enumerate(tokens):
        at = max(0, lower.find(token, at))
        end = at + len(token)
        while k < len(spans) and spans[k][0] < end:  # reach: how far the quotations go that opened before here
            reach = max(reach, spans[k][1])
            k += 1
        yield token, at < reach, n - report <= WINDOW
        if _ends.sub("", token) in REPORTS:
            report = n
        at = end


def fold(doc_id: Column) -> Column:
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % FOLDS


def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each label that say a word themselves, outside quotations and reports, or a word with a prefix, as partial counts."""
    enter("toxicity")
    counts: dict[tuple[str, bool], list[int]] = {}

    def drain() -> pd.DataFrame:
        out = pd.DataFrame([(t, p, *n) for (t, p), n in counts.items()], columns=["term", "prefix", "toxic", "clean"])
        counts.clear()
        return out

    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
            lower = (text or "").lower()
            words = {w for token in {t for t, quoted, reported in situations(lower, lower.split()) if not (quoted or reported)} for w in words_in(token)}
            terms = {(w, False) for w in words} | {(w[:k], True) for w in words for k in PREFIXES if len(w) >= k}
            for t in terms:
                counts.setdefault(t, [0, 0])[0 if toxic else 1] += 1
            if len(counts) > HELD_TERMS:
                yield drain()
    yield drain()


def choose(terms: pd.DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, bool]]:
    """The lexicon: words, and prefixes that many words share, which toxic documents hold far oftener than chance."""
    share = n_toxic / max(1, n_toxic + n_clean)
    a, n = terms["toxic"].to_numpy(dtype=float), (terms["toxic"] + terms["clean"]).to_numpy(dtype=float)
    pure = a / n
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (a * np.log(pure / share) + np.where(n > a, (n - a) * np.log((1 - pure) / (1 - share)), 0))
    good = terms[(ratio >= MIN_RATIO) & (pure >= MIN_PURE)]
    words = {t: n for t, n, p in zip(good["term"], good["toxic"], good["prefix"], strict=True) if not p}
    opened: set[str] = set()
    for t, n in sorted(((t, n) for t, n, p in zip(good["term"], good["toxic"], good["prefix"], strict=True) if p), key=lambda x: (len(x[0]), x[0])):
        # a prefix that one word accounts for is that word
        if not any(t[:k] in opened for k in range(1, len(t))) and not any(w.startswith(t) and m >= 0.6 * n for w, m in words.items()):
            opened.add(t)
    # words beside an open prefix of theirs stay, as they may be misspelt inside it
    return [(t, True) for t in sorted(opened)] + [(w, False) for w in sorted(words)]


class Scorer:
    """Features of a text: hits of the lexicon as exact, misspelt, quoted, addressed and reported ones."""

    def __init__(self, lexicon: list[tuple[str, bool]]) -> None:
        self.automaton, self.lexicon = Automaton(lexicon, edits_for), lexicon
        self.clean: set[str] = set()
        self.found: dict[str, tuple[int, int]] = {}

    def look(self, token: str) -> tuple[int, int] | None:
        return min((m for w in words_in(token) if (m := self.automaton.match(w))), default=None)

    def features(self, text: str | None) -> np.ndarray:
        out = np.array([1.0, 0, 0, 0, 0, 0])
        tokens = (text or "").lower().split()
        distinct = set(tokens)
        for token in distinct - self.clean - self.found.keys():
            if hit := self.look(token):
                self.found[token] = hit
            else:
                self.clean.add(token)
        if len(self.clean) > SEEN_WORDS:
            self.clean = set()
        if len(self.found) > SEEN_WORDS:
            self.found = {t: m for t in distinct if (m := self.look(t))}
        if distinct.isdisjoint(self.found):
            return out
        near = [_ends.sub("", t) for t in tokens]
        direct, fuzzy, quotes, addressed, reports = 0.0, 0.0, 0.0, 0.0, 0.0
        for k, (token, quoted, reported) in enumerate(situations(text.lower(), tokens)):
            if hit := self.found.get(token):
                # a quoted hit counts apart from others; a report before one that stands without marks has a weight of its own
                quotes += quoted
                direct += hit[0] == 0 and not quoted
                fuzzy += hit[0] > 0 and not quoted
                addressed += not quoted and any(w in ADDRESS for w in near[max(0, k - WINDOW) : k] + near[k + 1 : k + 1 + WINDOW])
                reports += reported and not quoted
        out[1:] = np.log1p([direct, fuzzy, quotes, addressed, reports])
        return out


def fit(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic weights, most probable under a normal prior around PRIOR; Newton steps, halved until they gain, as whole ones can diverge."""

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ w).sum() - y @ (x @ w) + strength / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), gradient)
        before, down = loss(w), gradient @ step
        while np.abs(step).max() >= 1e-8 and loss(w - step) > before - 1e-4 * down:
            step, down = step / 2, down / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("shingles")
    for batch in batches:
        rows = [bands_of(s)[:8] if len(s) else np.zeros(0, dtype=np.int64) for s in shingle_sets(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([r.tolist() for r in rows], pa.list_(pa.int64()))], ["id", "toxic", "text", "bands"])


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[tuple[str, bool]], np.ndarray]:
    """(lexicon, weights) from labelled documents whose fold is not 0; of near copies in the sample one counts.

    The sample is bounded by train_docs, so what the driver collects of it (ids and 8 band hashes a document, then terms that pass
    a first test, then six numbers a document) is bounded too. Labels without an id or a value are left out; of several labels of an id the largest counts, and of documents that repeat an id each
    is looked at until a near copy of it was. Null and empty texts count as clean or toxic documents without words; long ones are read whole. Ties of the sample's order go by id. Without usable labels the lexicon is empty.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("id")) != 0)
    chosen = cut(known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(train_docs), "train-ids")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "toxic", "text")
    sample = cut(rows.mapInArrow(sketch, "id long, toxic int, text string, bands array<long>"), "train-texts")
    first: dict[int, int] = {}
    keep, n = [], [0, 0]
    for r in sample.select("id", "toxic", "bands").orderBy("id").collect():
        if not any(b in first for b in r["bands"]):
            keep.append((r["id"],))
            n[0 if r["toxic"] else 1] += 1
        for b in r["bands"]:
            first.setdefault(b, r["id"])
    if not n[0] or not n[1]:
        return [], PRIOR
    spark = docs.sparkSession
    kept = cut(sample.join(F.broadcast(spark.createDataFrame(keep, "id long")), "id").select("toxic", "text"), "train-kept").repartition(8)
    terms = kept.mapInPandas(count_terms, "term string, prefix boolean, toxic long, clean long").groupBy("term", "prefix").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lexicon = choose(terms.where(f"toxic >= 3 AND toxic >= {MIN_PURE} * (toxic + clean)").toPandas(), *n)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enter("toxicity")
        scorer = Scorer(lexicon)
        for pdf in batches:
            yield pd.DataFrame({"x": [scorer.features(t).tolist() for t in pdf["text"]], "y": pdf["toxic"]})

    got = kept.mapInPandas(featured, "x array<double>, y int").toPandas()
    return lexicon, fit(np.array(got["x"].tolist()), got["y"].to_numpy(dtype=float))


def score(docs: DataFrame, lexicon: list[tuple[str, bool]], weights: np.ndarray, text_col: str = "text", score_col: str = "tox_score") -> DataFrame:
    """Every column of docs with score_col (0 to 1), from the whole text alone.

    A null or empty text has the score of a text without hits; a text of any length is read whole; repeats score alike, and ids,
    ties among them included, are not looked at. A column of docs named as score_col is replaced, any other stays. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(score_col)
    (held,) = free_names(docs, "tox_text")
    wide = docs.withColumn(held, F.col(text_col).cast("string"))
    schema = docs.withColumn(score_col, F.lit(0.5)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        scorer = Scorer(lexicon)
        for batch in batches:
            k = batch.num_columns - 1
            p = [1 / (1 + math.exp(-max(-30.0, min(30.0, float(scorer.features(t) @ weights))))) for t in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(p, pa.float64())], [*batch.schema.names[:k], score_col])

    return wide.mapInArrow(scored, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon, weights = train(docs, table(spark, sf_dir, "labels"))
    got = score(docs, lexicon, weights)
    return got.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))
