"""Collocations against plain counting, with odd texts, and the serialised tries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import collocations

DOCS = "doc_id long, lang string, text string, word string, f int, n int, lang_id string, `path` int"


def table(spark, rows):
    return spark.createDataFrame([(k, g, t, "w", 1, 2, "x", 3) for k, (g, t) in enumerate(rows)], DOCS)


def model(rows, least, top, inside=80, scale=2_000_000):
    f, n = defaultdict(Counter), Counter()
    for g, t in rows:
        g = "und" if g is None else g
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            for m in range(1, 5):
                f[g].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for g, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cands.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * a >= inside * counts[p[i:j]]:
                        gone.add(p[i:j])
        rank = []
        for p, a in cands.items():
            score, _, left, right = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            if p not in gone:
                rank.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(g, k + 1, p.decode(), -a, left, right, n[g], -s) for k, (s, a, p, left, right) in enumerate(sorted(rank)[:top])]
    return sorted(out)


ODD = [(None, None), ("en", ""), ("en", " \t.,;:!?\n\r\x0b\x0c"), (None, "One two, three"), ("und", "one TWO three"), ("É", "É é\xa0x a\u2028b É é\xa0x"), ("en", "ÄB äb Äb"), ("en", "solo")]


@pytest.mark.parametrize(("words", "size"), [(1 << 20, 8 << 20), (40, 600), (7, 50)])
def test_collocations(spark, monkeypatch, words, size):
    for name, value in (("SHARD_WORDS", words), ("RANGE_BYTES", size), ("MERGE_PATHS", 64)):
        monkeypatch.setattr(collocations, name, value)
    rng = random.Random(5)
    rows = list(ODD)
    for _ in range(150):
        said = [rng.choice("a b c d New York the of".split()) + rng.choice(["", "", "", ",", ". ", "\t"]) for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "en", "fr", None]), " ".join(said)))
    rows += [("en", "in the end of the day it is what it is")] * 20
    for least, top in ((2, 1000), (5, 7)):
        got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows), least=least, top=top).collect())
        assert got == model(rows, least, top)


def test_long_text(spark, monkeypatch):
    """Texts longer than a part, in one piece and in many."""
    monkeypatch.setattr(collocations, "CHUNK", 500)
    rng = random.Random(6)
    rows = [("en", " ".join(rng.choice("ab cd ef gh".split()) for _ in range(6000))), ("en", ", ".join("x y z" for _ in range(3000))), ("fr", "q" * 5000 + " r s t")]
    got = sorted(tuple(r) for r in collocations.collocations(table(spark, rows), least=3, top=None).collect())
    assert got == model(rows, 3, 10**6)


def test_empty_table(spark):
    assert collocations.collocations(table(spark, []).limit(0)).count() == 0
    assert collocations.collocations(table(spark, ODD[:3])).count() == 0


def test_counts_pass_64_bits(spark):
    """The score's product is decimal: counts of 10^16 and more."""
    from pyspark.sql import functions as F

    a, left, right = 10**16 + 7, 3 * 10**16 + 1, 2 * 10**16 + 5
    cut = spark.range(1).select(F.lit(a).alias("f"), F.lit(left).alias("l1"), F.lit(right).alias("r1")).select(collocations.lowest_cut(2, 2_000_000).alias("c")).first()["c"]
    assert cut["score"] == 2_000_000 * a // (left + right)


def test_serialised_paths():
    rng = np.random.default_rng(1)
    kinds, names = rng.integers(0, 1 << 63, 3, dtype=np.uint64), rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    ids, counts = np.concatenate([rng.integers(0, 3, (1, 300)), rng.integers(0, 50, (4, 300))]), rng.integers(1, 1 << 40, 300)
    p, c = collocations.parsed(collocations.serialised(kinds, names, ids, counts))
    assert (p[0] == kinds[ids[0]]).all() and (p[1:] == names[ids[1:]]).all() and (c == counts).all()
