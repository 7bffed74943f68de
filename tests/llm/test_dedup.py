"""Exact, near and line deduplication against brute force, with the edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import edit_distance, exact_dedup, line_dedup, minhash, set_links

DOCS = "doc_id long, text string, `key` string, `run` int, `bucket` string, `win` int"


def table(spark, rows):
    """doc_id and text, with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "k", 1, "b", 2) for i, t in rows], DOCS)


EDGES = [(1, None), (2, ""), (3, ""), (4, "x" * 300_000), (5, "x" * 300_000), (6, "a b"), (6, "a b"), (None, "a b"), (None, "only"), (9, "  \n"), (10, "a b c d e f"), (11, "A B C D E F")]


def model_exact(rows, largest=True):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    pick = max if largest else min
    out = []
    for i, t in rows:
        same = by[t or ""]
        known = [x for x in same if x is not None]
        best = pick(known) if known else None
        out.append((i, best, len(same), i == best, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("runs", [1, 16, 64])
def test_exact(spark, largest, runs):
    rows = EDGES + [(100 + k, f"t{k % 7}") for k in range(60)]
    got = exact_dedup.exact_dedup(table(spark, rows), largest=largest, runs=runs).collect()
    assert sorted(map(tuple, got), key=str) == model_exact(rows, largest)


def test_empty_tables(spark):
    none = table(spark, []).limit(0)
    assert exact_dedup.exact_dedup(none).count() == 0
    assert minhash.near_dedup(none).count() == 0
    classes = line_dedup.line_classes(none)
    assert classes.count() == 0 and line_dedup.drop_lines(none, classes).count() == 0


def model_near(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize(("few", "block", "features"), [(16, 1024, 1 << 19), (2, 30, 600)])
def test_near(spark, monkeypatch, few, block, features):
    for name, value in (("FEW", few), ("BLOCK", block), ("BLOCK_FEATURES", features)):
        monkeypatch.setattr(set_links, name, value)
    rng = random.Random(1)
    rows = [r for r in EDGES if r[0] not in (None, 6)]
    base = [f"w{k}" for k in range(60)]
    for k in range(120):  # a large group of near copies of one text
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, rows[15][1]) for k in range(30)] + [(3000 + k, " ".join(f"u{rng.randrange(500)}" for _ in range(40))) for k in range(20)]
    got = minhash.near_dedup(table(spark, rows)).collect()
    assert {tuple(r) for r in got} == model_near(rows) and len(got) == len(rows)


def test_near_repeated_and_null_ids(spark):
    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (7, "h i j k l m n"), (8, "h i j k l m n"), (None, "a b c d e f g")]
    got = minhash.near_dedup(table(spark, rows)).collect()
    assert sorted([(r["doc_id"], r["component_id"]) for r in got], key=str) == [(7, 7), (7, 7), (7, 7), (8, 7), (None, None)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(rng, s, n, alphabet):
    b = list(s)
    for _ in range(n):
        k, r = rng.randint(0, len(b)), rng.random()
        if r < 0.33 and b:
            b.pop(k - 1)
        elif r < 0.66:
            b.insert(k, rng.choice(alphabet))
        elif b:
            b[k - 1] = rng.choice(alphabet)
    return "".join(b)


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(8000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = mutate(rng, a, rng.randint(0, 5), "abcd")
        for k in (1, 2, 3, 4):
            assert edit_distance.within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_lines(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh  ") for _ in range(rng.randint(26, 44))) for _ in range(12)]
    rows = [(i, "\n".join(mutate(rng, rng.choice(base), rng.randint(0, 3), "zé") for _ in range(rng.randint(0, 4)))) for i in range(50)]
    rows += [(100, None), (101, ""), (102, "short\n\n"), (103, base[0]), (104, base[0]), (105, "y" * 200_000)]
    docs = table(spark, rows)
    classes = line_dedup.line_classes(docs)
    at = [(i, k, s) for i, t in rows for k, s in line_dedup.lines_of(t)]
    lines = sorted({s for _, _, s in at})
    root, links = {s: s for s in lines}, dict.fromkeys(lines, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, x in enumerate(lines):
        for y in lines[n + 1 :]:
            if abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2:
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    head, same = {}, {}
    for i, k, s in at:
        head[find(s)] = min(head.get(find(s), (i, k)), (i, k))
        same[s] = same.get(s, 0) + 1
    want = sorted((i, k, *head[find(s)], same[s], links[s], (i, k) == head[find(s)]) for i, k, s in at)
    assert sorted(map(tuple, classes.drop("text_key").collect())) == want
    kept = line_dedup.drop_lines(docs, classes)
    gone = {(r[0], r[1]) for r in want if not r[6]}
    model = {}
    for i, t in rows:
        left = None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (i, k) not in gone)
        if not any(g[0] == i for g in gone) or left.strip():
            model[i] = left
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == model and kept.columns == docs.columns


def test_components(spark):
    from weftline.llm.common import components

    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "src long, dst long")).collect()))
    assert set(got.values()) == {0, 100} and len(got) == 71
    assert components(spark.createDataFrame([], "src long, dst long").where(F.lit(True))).count() == 0


def test_short_lines(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcd") for _ in range(n)) for n in (1, 2, 5, 7, 7, 8, 9, 12, 15, 15, 16, 17, 20, 23) for _ in range(3)]
    rows = [(i, "\n".join(mutate(rng, rng.choice(base), rng.randint(0, 2), "abz") for _ in range(6)) + "\n \n}") for i in range(60)]
    docs = table(spark, rows)
    classes = line_dedup.line_classes(docs)
    at = [(i, k, s.strip()) for i, t in rows for k, s in enumerate(t.split("\n")) if s.strip()]
    lines = sorted({s for _, _, s in at})
    root, links = {s: s for s in lines}, dict.fromkeys(lines, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, x in enumerate(lines):
        for y in lines[n + 1 :]:
            if distance(x, y) <= min(2, min(len(x), len(y)) // 8):
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    head, same = {}, {}
    for i, k, s in at:
        head[find(s)] = min(head.get(find(s), (i, k)), (i, k))
        same[s] = same.get(s, 0) + 1
    want = sorted((i, k, *head[find(s)], same[s], links[s], (i, k) == head[find(s)]) for i, k, s in at)
    assert sorted(map(tuple, classes.drop("text_key").collect())) == want and same["}"] == 60 and max(links.values()) > 0
    assert sum("}" in r["text"] for r in line_dedup.drop_lines(docs, classes).collect()) == 1


def test_lines_of_repeated_ids(spark):
    again = "this line stands in two rows"
    rows = [(1, f"{again}\nmore of the first row"), (2, "a line of its own in row two"), (2, f"{again}\nsome other ending, all alone"), (None, "unlike all the other lines here"), (None, again), (2, "a line of its own in row two")]
    docs = spark.createDataFrame([(*r, "g", 1, [1]) for r in rows], "doc_id long, text string, gone_id string, gone_key int, gone_lines array<int>")
    kept = line_dedup.drop_lines(docs, line_dedup.line_classes(docs))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(got, key=str) == sorted([(1, "more of the first row"), (2, "a line of its own in row two"), (2, "some other ending, all alone"), (None, "unlike all the other lines here"), (None, again), (2, "a line of its own in row two")], key=str)


def test_many_lines_of_a_text(spark):
    text = "\n".join(f"line number {k} with words {k * 7919}" for k in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, text + "\nnothing but this is new in the second one")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs, spark.createDataFrame([(2, k) for k in range(20_000)], "doc_id long, line_no long").crossJoin(docs.where("doc_id = 2").selectExpr("xxhash64(text) as text_key")).selectExpr("*", "false as kept")).collect()}
    assert got == {1: text, 2: "nothing but this is new in the second one"}


def test_hot_segments(spark):
    """Many lines that share a segment: the key is split over a grid of tasks, and no link is lost."""
    rng = random.Random(9)
    rows = [(i, "\n".join(f"the same long beginning of a line {rng.randrange(60):02d}{rng.choice('abc')}" for _ in range(3))) for i in range(150)]
    docs = table(spark, rows)
    whole = sorted(map(tuple, line_dedup.line_classes(docs).collect()))
    keys = docs.select("text").coalesce(1).mapInArrow(line_dedup.frequent_keys(2), "key long, held long, asks long")
    assert keys.count() > 0
    assert sorted(map(tuple, line_dedup.line_classes(docs.coalesce(1), split=40).collect())) == whole
    lines = sorted({s for _, t in rows for s in t.split("\n")})
    n = {x: sum(x != y and distance(x, y) <= 2 for y in lines) for x in lines}
    at = {(i, k): s for i, t in rows for k, s in enumerate(t.split("\n"))}
    assert all(r[6] == n[at[r[0], r[2]]] for r in whole)
