"""Joins, indexes and clusterings of vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import similarity_join
from weftline.operators.vector_search import similar_pairs


def clustered(n, dims=16, groups=40, spread=0.15, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dims))


def frame(spark, x):
    return spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "id long, v array<double>")


@pytest.mark.parametrize(("threshold", "pivots", "block"), [(0.9, 30, 2048), (0.5, 30, 64), (0.97, 1, 100), (-0.5, 7, 2048)])
def test_threshold_join(spark, monkeypatch, threshold, pivots, block):
    monkeypatch.setattr(similarity_join, "BLOCK", block)
    x = clustered(600)
    x[::50] = x[0]  # a group of equal rows
    x[7] = 0
    x[11] = -x[12]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sim = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(sim >= threshold), strict=True)}
    unsure = {(i, j) for i, j in zip(*np.nonzero(np.abs(sim - threshold) < 1e-9), strict=True)}
    rows = frame(spark, unit).cache()
    got = similarity_join.threshold_pairs(rows, threshold, pivots=pivots).collect()
    assert len(got) == len({(r.i, r.j) for r in got})
    assert {(r.i, r.j) for r in got} ^ want <= unsure
    assert all(abs(r.sim - sim[r.i, r.j]) < 1e-9 for r in got)


def test_longer_vectors_and_odd_rows(spark):
    """Products of vectors of any length; NaN and null vectors are like nothing."""
    x = clustered(200, 4, 5) * np.random.default_rng(1).uniform(0.1, 3, (200, 1))
    rows = frame(spark, x).unionByName(spark.createDataFrame([(900, [float("nan")] * 4), (901, None)], "id long, v array<double>"))
    got = {(r.i, r.j) for r in similar_pairs(rows, "id", "v", 4.0, normalise=False).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 4), strict=True) if i != j}
    assert similar_pairs(rows.limit(0), "id", "v", 0.5).count() == 0


@pytest.mark.parametrize("k", [None, 3])
def test_rows_travel_a_bounded_number_of_times(spark, monkeypatch, k):
    """What is dealt grows with the rows, not with the cells they visit; cells larger than a block are cut."""
    monkeypatch.setattr(similarity_join, "TILE", 40)
    monkeypatch.setattr(similarity_join, "GRID", 4)
    monkeypatch.setattr(similarity_join, "BLOCK", 150)
    x = np.random.default_rng(2).normal(size=(600, 8))
    x[:200] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = similarity_join.threshold_pairs(frame(spark, x).cache(), 0.3, k=k, pivots=60)
    sim = np.array([(x * row).sum(1) for row in x])
    got = out.collect()
    pairs = {(r.i, r.j) for r in got}
    assert len(got) == len(pairs)
    if k is None:
        assert pairs == set(zip(*(t.tolist() for t in np.nonzero(sim >= 0.3)), strict=True))
    else:
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        assert all((i, int(j)) in pairs for i in range(600) for j in best[i] if sim[i, j] >= 0.3)
    assert similarity_join.block_rows(600) == 150 and similarity_join.block_rows(10**6) == 150


def test_compared_pairs_fall_with_the_threshold(spark):
    x = clustered(4000, 16, 60)
    rows = frame(spark, x / np.linalg.norm(x, axis=1, keepdims=True)).cache()
    compared = []
    for threshold in (0.5, 0.8, 0.9, 0.97, 0.995):
        w = similarity_join.work(similarity_join.cells(rows, threshold, 64)).select(F.sum(F.col("own") * (F.col("own") - 1) / 2 + F.col("own") * F.col("guests"))).first()[0]
        compared.append(w / (4000 * 3999 / 2))
    print("share of pairs compared", compared)
    assert compared == sorted(compared, reverse=True) and compared[2] < 0.3 and compared[-1] < 0.06


def test_proximity_graph(spark):
    """Recall against brute force at three sizes, and rows met that hardly grow with them."""
    from weftline.operators.proximity_graph import build_index, search_index

    share = []
    for n in (2000, 8000, 32_000):
        x = clustered(n, 24, 80, 0.3, n)
        asked = x[:: n // 50] + 0.05 * np.random.default_rng(2).normal(size=x[:: n // 50].shape)
        index = build_index(frame(spark, x), "id", "v", shard_rows=20_000)
        got = search_index(index, frame(spark, asked).toDF("query_id", "q")).collect()
        found = {}
        for r in got:
            found.setdefault(r.query_id, []).append(r)
        hits = 0
        for q, rows in found.items():
            d = np.sqrt(((x - asked[q]) ** 2).sum(1))
            hits += len({r.id for r in rows} & set(np.argsort(d, kind="stable")[:10].tolist()))
            assert [r.rank for r in sorted(rows, key=lambda r: (r.distance, r.id))] == list(range(1, 11)) and all(abs(r.distance - d[r.id]) < 1e-9 for r in rows)
        met = np.mean([rows[0].met for rows in found.values()])
        share.append(met / n)
        print(n, "rows: recall", hits / (10 * len(asked)), "met", met)
        assert len(found) == len(asked) and hits >= 0.95 * 10 * len(asked)
    assert share[1] < share[0] / 2 and share[2] < share[1]


@pytest.mark.parametrize("shard_rows", [500, 50_000])
def test_confirmed_neighbours(spark, monkeypatch, shard_rows):
    """A narrow beam misses rows of unstructured vectors; the check finds them all, in any number of blocks."""
    from weftline.operators import proximity_graph

    monkeypatch.setattr(proximity_graph, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(proximity_graph, "QUERIES", 20)
    x = np.random.default_rng(3).normal(size=(3000, 48))
    x[1::100] = x[::100]
    index = proximity_graph.build_index(frame(spark, x), "id", "v")
    asked = frame(spark, x[::100]).toDF("query_id", "q")
    found = proximity_graph.search_index(index, asked, 10, 10).cache()
    got = {(r.query_id, r.rank): r.id for r in proximity_graph.confirm_nearest(index, asked, found, 10).collect()}
    d = np.sqrt(((x[None] - x[::100][:, None]) ** 2).sum(2))
    want = {(q, n): i for q in range(30) for n, i in enumerate(np.argsort(d[q], kind="stable")[:10].tolist(), 1)}
    assert got == want and {(r.query_id, r.rank): r.id for r in found.collect()} != want
    few = proximity_graph.build_index(frame(spark, x[:4]), "id", "v")
    assert proximity_graph.confirm_nearest(few, asked, proximity_graph.search_index(few, asked, 10), 10).count() == 120


def test_index_odd_rows(spark, tmp_path):
    """Null vectors are not indexed; equal rows, a single row and an empty table are answered; an index can be kept."""
    from weftline.operators.proximity_graph import build_index, search_index

    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id int, q array<double>")
    rows = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(30)] + [(90, None), (91, [0.5, 0.0])], "id long, v array<double>")
    kept = build_index(rows, "id", "v", path=f"file://{tmp_path}/index")
    assert [(r.query_id, r.id) for r in search_index(kept, asked, 3).orderBy("rank").collect()] == [(1, 91), (1, 0), (1, 1)]
    assert [r.id for r in search_index(build_index(rows.where("id = 5"), "id", "v"), asked, 3).collect()] == [5]
    assert search_index(build_index(rows.limit(0), "id", "v"), asked, 3).count() == 0


def test_sql_uses_the_index(spark):
    from weftline.operators.proximity_graph import build_index
    from weftline.plans.serve import Service

    x = clustered(3000, 12, 30, 0.3, 4)
    nodes = frame(spark, x).select(F.col("id").cast("string").alias("id"), F.col("v").alias("embedding"), F.array().cast("array<string>").alias("edges"), F.lit("p").alias("proposition"))

    class Embedder:
        def embed(self, texts):
            return [[float(c) for c in x[int(t)] + 0.01] for t in texts]

    chunks = spark.createDataFrame([], "chunk_id int, messages_str string, embedding array<double>")
    plain, indexed = (Service(nodes, chunks, Embedder(), index=i) for i in (None, build_index(nodes, "id", "embedding")))
    for sql in (
        "SELECT n.id FROM CausalGraphNode n, QueryEmbedding q WHERE q.id = 2 ORDER BY n.embedding <-> q.embedding LIMIT 7",
        'SELECT n."id" FROM "CausalGraphNode" AS n, "QueryEmbedding" AS q WHERE q."id" = 1 ORDER BY n."embedding" <-> q."embedding" LIMIT 5;',
    ):
        a, b = (s.sql_query(sql, to_embed_nodes=["17", "1500"]) for s in (plain, indexed))
        assert a.collect() == b.collect() and len(b.collect()) in (5, 7)
    assert indexed.sql_query("SELECT count(*) AS n FROM CausalGraphNode", to_embed_nodes=["1"]).first()["n"] == 3000


def groups_of(labels):
    out = {}
    for k, c in labels.items():
        out.setdefault(c, set()).add(k)
    return {frozenset(g) for g in out.values()}


@pytest.mark.parametrize(("n", "clusters"), [(45, 7), (3, 5), (1, 2)])
def test_ward_against_plain_merging(spark, monkeypatch, n, clusters):
    """The single closest pair merged again and again, beside rounds of mutual neighbours in small blocks."""
    from weftline.operators import ward

    monkeypatch.setattr(ward, "LAST", 3)
    monkeypatch.setattr(ward, "BLOCK", 10)
    x = np.random.default_rng(5).standard_normal((n, 3))
    held = [[k] for k in range(n)]
    grow = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    while len(held) > clusters:
        _, i, j = min((grow(held[i], held[j]), i, j) for i in range(len(held)) for j in range(i))
        held[j] += held.pop(i)
    got = {r.id: r.cluster_label for r in ward.ward_clusters(frame(spark, x), clusters).collect()}
    assert groups_of(got) == {frozenset(h) for h in held}
    first = sorted({c: min(k for k in got if got[k] == c) for c in got.values()}.items())
    assert [c for c, _ in first] == list(range(len(first))) and [k for _, k in first] == sorted(k for _, k in first)


def test_ward_rounds_equal_one_block(spark, monkeypatch):
    from weftline.operators import ward

    x = clustered(1500, 6, 25, 0.4, 9)
    rows = frame(spark, x).cache()
    one = groups_of({r.id: r.cluster_label for r in ward.ward_clusters(rows, 25).collect()})
    monkeypatch.setattr(ward, "LAST", 300)
    monkeypatch.setattr(ward, "BLOCK", 400)
    many = groups_of({r.id: r.cluster_label for r in ward.ward_clusters(rows, 25).collect()})
    assert one == many and len(one) == 25


def test_ward_ties(spark, monkeypatch):
    """Equal rows and equal distances: any order of merging will do, and rounds come to an end."""
    from weftline.operators import ward

    monkeypatch.setattr(ward, "LAST", 4)
    rows = frame(spark, np.array([[float(k % 4), float(k // 4 % 4)] for k in range(64)]))
    got = groups_of({r.id: r.cluster_label for r in ward.ward_clusters(rows, 16).collect()})
    assert got == {frozenset(k for k in range(64) if k % 16 == g) for g in range(16)}
    assert ward.ward_clusters(rows.limit(0), 3).count() == 0


@pytest.mark.parametrize("far", [0.0, 1000.0])
def test_ward_close_pairs(far):
    """Single precision leaves few pairs to measure, the nearest among them; sizes differ, and a cluster is not its own neighbour."""
    from weftline.operators import ward

    rng = np.random.default_rng(3)
    y, ny = rng.standard_normal((400, 16)) + far, np.sort(rng.integers(1, 9, 400)).astype(float)
    y[7], y[300] = y[6], y[20]
    same = np.arange(100, 400, 5)
    same[:3] = -1
    x, nx = y[100:400:5], ny[100:400:5]
    d = ward.rise(x[:, None], nx[:, None], y[None], ny[None])
    d[np.arange(60)[3:], same[3:]] = np.inf
    middle = y.mean(0)
    for kind in (np.float32, np.float64):
        r, k = ward.close_pairs(x - middle, nx, y - middle, ny, same, kind)
        assert len(r) < 80 and {(a, b) for a, b in zip(*np.nonzero(d == d.min(1)[:, None]))} <= set(zip(r, k))
    assert ward.block_size(100_000) > 8192 and -(-600_000 // ward.block_size(600_000)) < 20  # a cluster travels to few


def test_ward_ends_in_a_task(spark, monkeypatch):
    """Some thousand clusters need no rounds, of which each would merge a few in a hundred; chains by products merge what plain differences do."""
    from weftline.operators import ward

    x = np.random.default_rng(2).standard_normal((2500, 8))
    n = np.random.default_rng(4).integers(1, 5, 120).astype(float)
    held, want = {k: (x[k], n[k]) for k in range(120)}, set()
    while len(held) > 1:
        d, a, b = min((float(ward.rise(*held[a], *held[b])), a, b) for a in held for b in held if a < b)
        want.add((round(d, 9), a, b))
        (c, i), (e, j) = held[a], held.pop(b)
        held[a] = ((c * i + e * j) / (i + j), i + j)
    assert {(round(d, 9), a, b) for d, a, b in ward.merge_all(x[:120], n)} == want
    monkeypatch.setattr(ward, "nearest", lambda *a: pytest.fail("a round"))
    assert len(set(r.cluster_label for r in ward.ward_clusters(frame(spark, x), 25).collect())) == 25


def test_ward_merges_on_what_is_known(spark, monkeypatch):
    """Lists and bounds let most pairs merge without a search, and give the tree of one task; equal rows need no search at all."""
    from weftline.operators import ward

    x = np.random.default_rng(8).standard_normal((900, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).round(6)
    x[600:, :] = x[7]
    calls, search = [], ward.nearest
    monkeypatch.setattr(ward, "LAST", 330)
    monkeypatch.setattr(ward, "BLOCK", 300)
    monkeypatch.setattr(ward, "nearest", lambda *a: calls.append(1) or (search(*a) if len(calls) < 4 else pytest.fail("too many rounds")))
    got = ward.ward_merges(frame(spark, x)).collect()
    held = [*range(600)]
    want = ward.merge_all(x[:600], np.array([1.0 + 300 * (k == 7) for k in held]))
    assert len(got) == 899 and sum(r.d == 0 for r in got) == 300
    assert {(round(r.d, 6), r.a, r.b) for r in got if r.d > 0} == {(round(d, 6), a, b) for d, a, b in want}
