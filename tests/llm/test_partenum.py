"""The n-gram join against all pairs, and PartEnum's guarantee on sets of every size."""

import random
import re

import numpy as np
import pytest

from tests.conftest import SF
from weftline.llm import partenum, set_links

DOCS = "doc_id long, text string, `bucket` string, `id` int, `lo` int, `size` string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, 2, "s") for i, t in rows], DOCS)


def sets_of(rows, words=4):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    return out


def model(rows, percent=85):
    sets = sets_of(rows)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}  # those that share a shingle are enough to look at
    for i, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(i)
    for a, b in sorted({(a, b) for at in held.values() for a in at for b in at if a < b}):
        x, y = sets[a], sets[b]
        if find(a) != find(b) and 100 * len(x & y) >= percent * len(x | y):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {(i, len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent", [85, 80, 92])
def test_alike_sets_share_a_signature(percent):
    """The hardest pairs: sets as different as the threshold allows, of every size."""
    rng = np.random.default_rng(percent)
    for size in [*range(1, 160), 300, 777, 2500]:
        for _ in range(6):
            a = rng.integers(0, 1 << 64, size, dtype=np.uint64)
            gone = rng.integers(0, size * (100 - percent) // 100 + 1)  # removing g and adding h keeps (size - g) / (size + h) >= percent
            most = 100 * (size - gone) // percent - size
            new = rng.integers(0, 1 << 64, rng.integers(0, most + 1) if most > 0 else 0, dtype=np.uint64)
            b = np.concatenate([a[gone:], new])
            if not len(b) or 100 * (size - gone) < percent * (size + len(new)) or (not gone and not len(new)):
                continue
            (x, p), (y, q) = (partenum.signatures_of(np.unique(s), percent) for s in (a, b))
            met = np.intersect1d(x, y).size
            assert met, (size, gone, len(new))
            most_apart = (100 - percent) * (len(a) + len(b)) // (100 + percent)
            if min(p[1], p[2], q[1], q[2]) > 0:  # what the condition on pairs rests on
                cells = p[1] + p[2] - 2 * most_apart if p[0] == q[0] else max(p, q)[1] - most_apart
                assert met >= cells - min(p[3], q[3])


def test_strangers_share_few():
    rng = np.random.default_rng(1)
    signs = [partenum.signatures_of(np.unique(rng.integers(0, 1 << 64, rng.integers(20, 200), dtype=np.uint64)))[0] for _ in range(2000)]
    flat = np.concatenate([np.unique(s) for s in signs])
    assert len(flat) - len(np.unique(flat)) <= 20


@pytest.mark.parametrize(("block", "features"), [(1024, 1 << 19), (20, 500)])
def test_join(spark, monkeypatch, block, features):
    monkeypatch.setattr(set_links, "BLOCK", block)
    monkeypatch.setattr(set_links, "FEW", 16 if block == 1024 else 3)
    monkeypatch.setattr(set_links, "BLOCK_FEATURES", features)
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "x" * 300_000), (5, "x" * 300_000), (6, "a b"), (9, "A  b"), (10, "a b c d e"), (11, "A B C D E"), (12, "a b c d f"), (13, "long " * 50_000)]
    for size in (9, 14, 25, 60, 200):
        base = [f"w{size}_{k}" for k in range(size)]
        for k in range(40):  # copies with a few words changed, so some link, some only through others, some not at all
            w = list(base)
            for _ in range(rng.randint(0, 1 + size // 60)):
                w[rng.randrange(size)] = f"x{rng.randrange(3)}"
            if rng.random() < 0.3:
                w += [f"y{rng.randrange(1000)}" for _ in range(rng.randint(0, 1 + size // 20))]
            rows.append((1000 * size + k, " ".join(w)))
    rows += [(900_000 + k, rows[40][1]) for k in range(30)]
    rng.shuffle(rows)
    got = partenum.ngram_join(table(spark, rows)).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == model(rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = partenum.op12_ngram_join(spark, SF).collect()
    assert {tuple(r) for r in got} == model([tuple(r) for r in docs]) and len(got) == len(docs)


def test_repeated_and_null_ids(spark):
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (7, "h i j k l m n"), (8, "h i j k l m n"), (None, "a b c d e f g")]
    got = partenum.ngram_join(table(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["component_id"]) for r in got], key=str) == [(7, 7), (7, 7), (7, 7), (8, 7), (None, None)]
    assert partenum.ngram_join(table(spark, rows).limit(0)).count() == 0


def test_signatures_are_shuffled_once(spark, monkeypatch):
    """Only buckets of more than FEW members are looked up among all signatures again; no link is lost in those, in small ones and where an id repeats."""
    near = lambda k, i: " ".join(f"g{k}x{j}" for j in range(60)) + f" t{k}x{i}"
    rows = [(1000 * k + i, near(k, i)) for k, n in enumerate([1, 2, 3, 5, set_links.FEW, set_links.FEW + 1, 40]) for i in range(n)]
    rows += [(2002, near(2, 7)), (5001, near(5, 1)), (4000, near(3, 9))]
    looked_up, join_sized = [], set_links.join_sized

    def seen(left, right, on, how, **more):
        if on == ["bucket"] and sorted(left.columns) == ["bucket", "id"] and "id" not in right.columns:
            looked_up.append((left, right))
        return join_sized(left, right, on, how, **more)

    monkeypatch.setattr(set_links, "join_sized", seen)
    got = {(r.doc_id, r.component_id) for r in partenum.ngram_join(table(spark, rows)).collect()}
    (left, right), *_ = [x for x in looked_up if "lo" in x[1].columns]
    held = {r.bucket: r.n for r in left.join(right.select("bucket"), "bucket").groupBy("bucket").agg({"*": "count"}).toDF("bucket", "n").collect()}
    assert held and min(held.values()) > set_links.FEW
    plan = set_links.first_members(left)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange hashpartitioning") == 1  # one of the limits is before the shuffle
    assert got == {(i, 3000 if i // 1000 == 4 else i // 1000 * 1000) for i, _ in rows}  # id 4000 has texts of two groups


@pytest.mark.parametrize("block", [1024, 25])
def test_sets_travel_once_for_buckets_of_the_same_copies(spark, monkeypatch, block):
    """Copies too far apart to link share many buckets, each with other members; what is compared is as few rows as there are copies, and the links among them are found."""
    monkeypatch.setattr(set_links, "BLOCK", block)
    rng, rows = random.Random(3), []
    for k in range(80):
        w = [f"w{j}" for j in range(120)]
        for at in rng.sample(range(120), 5):
            w[at] = f"x{k}y{at}"
        rows.append((k + 1, " ".join(w)))
        if k % 10 == 0:
            rows.append((k + 1001, " ".join([*w[:-1], "end"])))
    held, cut = {}, set_links.cut
    monkeypatch.setattr(set_links, "cut", lambda df, name: held.setdefault(name, cut(df, name)))
    got = {tuple(r) for r in partenum.ngram_join(table(spark, rows)).collect()}
    assert got == model(rows) and len({r[2] for r in got}) > 60
    compared = held["blocks"]
    per_id = compared.groupBy("id").count().agg({"count": "avg"}).first()[0]
    assert compared.count() and per_id <= (4 if block == 1024 else 16)


def test_buckets_are_merged_where_that_compares_no_more(spark):
    same = [(b, i, 5, 1 if i < 4 else i, 1) for b in (10, 11) for i in range(30) if i != 10 + b]  # nearly the same members
    other = [(b, 1000 * b + i, 5, 2 if i < 4 else 1000 * b + i, 2) for b in (20, 21) for i in range(30)]  # none in common
    rest = spark.createDataFrame(same + other, "bucket long, id long, size long, component long, big long")
    got = {(r.merged, r.bucket, r.id) for r in set_links.merged_buckets(rest).collect()}
    assert got == {(True, 1, i) for i in range(30)} | {(False, b, i) for b, i, *_ in other}
