"""Hand fixtures: the tricky behaviours one by one, against small models in plain Python."""

import datetime as dt
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import lists, text, tolerant_json
from weftline.functions import vectors as V
from weftline.operators import entities, external, graph, relational, sequences, vector_search
from weftline.plans import assistant, human
from weftline.plans.serve import Service, translate
from weftline.sources import readers, sinks
from weftline.sources.snapshots import Conflict, Store
from weftline.streaming import events as streams

T0 = dt.datetime(2024, 1, 1)
NODE = f"id string, n {tolerant_json.NODE_TYPE}"


def at(k, **more):
    return T0 + dt.timedelta(**(more or {"minutes": k}))


def one(df):
    return df.first()[0]


def test_squash(spark):
    rows = [("alice", "me", "hi", at(1)), ("alice", "me", "hi", at(2)), ("me", "alice", "hi", at(3)), ("alice", "me", "hi", at(4))]
    out = sequences.squash_runs(spark.createDataFrame(rows, "`from` string, `to` string, content string, datetime timestamp"), ["from", "to"], ["datetime"], "content", "datetime").orderBy("datetime").collect()
    assert [r["count"] for r in out] == [2, 1, 1]
    assert out[0]["content"] == "Sent 2 of hi" and out[0]["datetime"] == at(1)


@pytest.mark.parametrize(("content", "kind", "title", "want"), [("", 2, None, "MEDIA: VIDEO"), ("", 99, None, "MEDIA: UNKNOWN"), ("see https://x.y/z now", 0, "T$1", "see Sent a link: T$1 now"), ("https://x.y", 7, "T", "Sent a link: T"), ("plain", 1, "T", "plain")])
def test_media_text(spark, content, kind, title, want):
    df = spark.createDataFrame([(content, kind, title)], "c string, k int, t string")
    assert one(df.select(text.media_text(F.col("c"), F.col("k"), F.col("t")))) == want


def test_rechunk(spark):
    df = spark.createDataFrame([(k + 1, n, at(k)) for k, n in enumerate([3, 3, 5, 9, 2])], "chunk_id int, n long, earliest timestamp")
    assert dict(map(tuple, sequences.rechunk(df, 7).collect())) == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5}


def test_lookback(spark):
    days = [(k, at(0, days=k), at(0, days=k)) for k in range(1, 13)] + [(13, at(0, days=42), at(0, days=42))]
    dense = [(k, at(k), at(k)) for k in range(1, 13)]
    for rows, want in ((days, {k: min(k - 1, 7) for k in range(2, 13)} | {13: 1}), (dense, {k: min(k - 1, 10) for k in range(2, 13)})):
        df = spark.createDataFrame([("x", *r) for r in rows], "p string, chunk_id int, start_dt timestamp, end_dt timestamp")
        pairs = sequences.lookback(df, partition=["p"])
        assert {r["chunk_id"]: r["count"] for r in pairs.groupBy("chunk_id").count().collect()} == want
        assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, sequences.lookback_sorted(df, "chunk_id", "start_dt", "end_dt", ["p"]).collect()))


@pytest.mark.parametrize("compat", [False, True])
def test_period(spark, compat):
    rows = [(a, b, s, e) for a in ("2024-01-01",) for b in ("2024-01-01", "2024-01-02") for s in (None, "09:00:00", "soon") for e in (None, "09:00:00", "17:00:00", "x")]
    df = spark.createDataFrame(rows, "a string, b string, s string, e string")
    got = [r[0] for r in df.select(text.relevance_period(F.col("a"), F.col("b"), F.col("s"), F.col("e"), compat)).collect()]

    def model(a, b, s, e):
        hs, he = (x is not None and x[:1].isdigit() for x in (s, e))
        if compat:
            hs, he = not hs, not he
        parts = [a, b, s, e]
        if a == b:
            out = [a] if not hs and not he else [a, " at ", s] if hs and he and s == e else [a, " from ", s, " to ", e] if hs and he else [a, " at ", s if hs else e]
            if hs and he and (s is None or e is None):
                return None
        else:
            out = [a, " to ", b] if not hs and not he else [a, " at ", s, " to ", b, " at ", e] if hs and he else [a, " at ", s, " to ", b] if hs else [a, " to ", b, " at ", e]
        del parts
        return None if any(x is None for x in out) else "".join(out)

    assert got == [model(*r) for r in rows]


def test_subject_and_ids(spark):
    df = spark.createDataFrame([("alice and bob met",), ("bob ran",), ("bobcat",), ("carol",)], "t string")
    assert [r[0] for r in df.select(text.subject(F.col("t"), "alice", "bob")).collect()] == ["both", "bob", "bob", "both"]
    ids = spark.createDataFrame([(0, "A b"), (0, "a-b"), (0, "a_b")], "row int, id string")
    assert {r["id"]: r["new_id"] for r in entities.sanitise_ids(ids).collect()} == {"A b": "row0_a_b", "a-b": "row0_a_b_2", "a_b": "row0_a_b_3"}
    assert one(spark.range(1).select(text.strip_row_prefix(F.lit("row12_x")))) == "x"


def test_small_text_functions(spark):
    f = lambda c: one(spark.range(1).select(c))
    assert f(text.without_think(F.lit("<think>a\nb</think> c"))) == "c"
    assert f(text.fenced(F.lit("x ```json\n{1}\n``` y"))).strip() == "{1}" and f(text.fenced(F.lit("x"))) == "x"
    assert f(text.json_object(F.lit("a {b {c}} d"))) == "{b {c}}" and f(text.json_object(F.lit("a"))) is None
    assert f(text.without_parens(F.lit("Work (12)"))) == "Work" and f(text.without_ansi(F.lit("\x1b[31mx\x1b[0m"))) == "x"
    assert f(text.wrapped(F.lit("aa bb cc"), 5)) == "aa bb\ncc\n"
    assert f(text.apple_time(F.lit(0))) == dt.datetime(2001, 1, 1)
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert [f(text.node_datetime(x)) for x in (a(), a(None), a("b", "b"), a("c", "a", None))] == ["Unknown", "Unknown", "b", "from a to c"]
    m = spark.createDataFrame([([("me", T0, "hi"), ("bob", T0, None)],)], "m array<struct<`from`: string, datetime: timestamp, content: string>>")
    assert one(m.select(text.transcript(F.col("m"), "alice"))) == "alice at 2024-01-01 00:00:00: hi"


def test_lists(spark):
    nodes = [("a", None, "p", [], ["b"], "x"), ("b", None, "p", [], [], "x"), ("c", None, "p", ["z"], [], "x"), ("d", None, "p", [], [], "x")]
    df = spark.createDataFrame([(nodes,)], f"nodes array<{tolerant_json.NODE_TYPE}>")
    assert [n["id"] for n in one(df.select(lists.roots(F.col("nodes"))))] == ["a", "d"]
    r = spark.createDataFrame([("n", ["x"], ["y"]), ("m", [], None)], "id string, caused array<string>, caused_by array<string>")
    assert [x[0] and [tuple(y) for y in x[0]] for x in r.select(lists.relationships(F.col("id"), F.col("caused"), F.col("caused_by"))).collect()] == [[("n", "x"), ("y", "n")], None]
    z = spark.createDataFrame([([1, 2, 3], ["a"])], "x array<int>, y array<string>")
    assert [tuple(s) for s in one(z.select(lists.zip_shortest(["x", "y"], F.col("x"), F.col("y"))))] == [(1, "a")]
    assert one(spark.range(1).select(lists.mean(F.array(F.lit(1), F.lit(None), F.lit(3))))) == 2.0


def test_merge_links(spark):
    chunks = spark.createDataFrame([(1, [("a", None, "p", ["s"], [], "t"), ("b", None, "p", [], [], "t")])], f"chunk_id int, subgraph_combined array<{tolerant_json.NODE_TYPE}>")
    links = spark.createDataFrame([(1, [("a", ["x"], []), ("a", ["y"], ["z"]), ("q", ["w"], [])])], f"chunk_id int, links {human.LINKS}")
    out = relational.merge_links(chunks, links).first()["subgraph_combined"]
    assert [(n["id"], n["caused_by"], n["caused"]) for n in out] == [("a", ["s", "y"], ["z"]), ("b", [], [])]


def test_dedup_and_uniquify(spark):
    v = lambda d: [float(np.cos(d)), float(np.sin(d))]
    rows = [("b", v(0.0), [("b", "a")], 1), ("a", v(0.4), [("a", "d")], 2), ("c", v(0.8), [], 3), ("d", v(2.0), [], 4), ("b", v(0.0), [("b", "d")], 5)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>, relationships array<struct<source: string, target: string>>, ord int")
    out = {r["id"]: r for r in entities.merge_entities(df, "id", "embedding", 0.9, ["embedding"], [("ords", "ord")], "relationships", "ord").collect()}
    assert set(out) == {"a", "d"} and out["a"]["frequency"] == 4 and out["a"]["ords"] == [1, 2, 3, 5]
    assert out["a"]["edges"] == ["d"] and out["a"]["embedding"] == rows[0][1] and out["d"]["edges"] == []
    frame = lambda ids: spark.createDataFrame([(i, [i], [(i, i)]) for i in ids], "id string, edges array<string>, relationships array<struct<source: string, target: string>>")
    ids = entities.uniquify_ids([frame(["x", "y"]), frame(["x", "x_2"]), frame(["x"])]).collect()
    assert len({r["id"] for r in ids}) == 5 and all(r["edges"] == [r["id"]] and r["relationships"][0]["source"] == r["id"] for r in ids)


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "src string, dst string")
    n = spark.createDataFrame([(x, 1) for x in "abcdz"], "id string, frequency int")
    assert graph.shortest_path(e, "a", "d") == ["a", "b", "d"] and graph.shortest_path(e, "d", "a") is None and graph.shortest_path(e, "q", "a") is None
    assert [r["id"] for r in graph.isolated(n, e).collect()] == ["z"]
    assert {r["id"]: r["depth"] for r in graph.relatives(e, "a", "children", 3).collect()} == {"b": 1, "c": 1, "d": 2}
    assert {r["id"] for r in graph.relatives(e, "d", "parents").collect()} == {"b", "c"} and graph.relatives(e, "q").count() == 0
    assert graph.incident(e, "b").count() == 2
    rows = spark.createDataFrame([("a", ["b", "x"]), ("b", [])], "id string, edges array<string>")
    nodes, edges = graph.build(rows)
    assert nodes.count() == 3 and edges.count() == 2
    found = dict(map(tuple, graph.components(spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 51)], "src long, dst long")).collect()))
    assert set(found.values()) == {0, 50} and len(found) == 23
    assert graph.causal_chain(n, e, "d", "a")[0] in "ad" and graph.causal_chain(n, e, "d", "q") == []


@pytest.mark.parametrize("directed", [True, False])
def test_pagerank(spark, directed):
    pairs, ids = [(0, 1), (1, 2), (2, 0), (2, 3)], range(4)
    e = spark.createDataFrame(pairs, "src long, dst long")
    reset = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 3, 2.0), (2, 1, 0.0)], "seed int, id long, weight double")
    got = graph.pagerank(spark.createDataFrame([(i,) for i in ids], "id long"), e, reset, directed=directed, rounds=60, tolerance=1e-12)
    a = np.zeros((4, 4))
    for s, d in pairs:
        a[s, d] = 1
        if not directed:
            a[d, s] = 1
    for seed, p in ((0, np.array([0.25, 0.75, 0, 0])), (1, np.array([0, 0, 0, 1.0]))):
        r = p.copy()
        for _ in range(60):
            out = a.sum(1)
            r = 0.15 * p + 0.85 * ((np.where(out > 0, r / np.maximum(out, 1), 0)) @ a + r[out == 0].sum() * p)
        mine = {x["id"]: x["score"] for x in got.where(F.col("seed") == seed).collect()}
        assert abs(sum(mine.values()) - 1) < 1e-9 and all(abs(mine.get(i, 0) - r[i]) < 1e-6 for i in ids)
    assert got.where("seed = 2").count() == 0


def test_tolerant_json(spark):
    good = '[{"source": "a", "target": "b"}]'
    for t, want in ((good, True), (f"Sure:\n```json\n{good}\n```", True), (good[:-1] + ",]", True), ("[{'source': 'a', 'target': 'b'", True), ('[{"x": 1}]', False), ("no", False), (None, False), ("", False)):
        assert (tolerant_json.parse(t, "links") is not None) is want, t
    df = spark.createDataFrame([(good,), ("no",)], "t string").select(tolerant_json.parse_column(F.col("t"), "links").alias("v"))
    assert [r["v"] and r["v"][0]["target"] for r in df.collect()] == ["b", None]
    assert tolerant_json.parse("bad", "category") == {"category": "", "is_personal": False}
    assert tolerant_json.parse('{"sentiment": 0.5}', "sentiment") == 0.5 and tolerant_json.parse('{"decision": "MAYBE"}', "verdict") is None
    with pytest.raises(ValueError):
        tolerant_json.parse_strict("bad", "links")


def test_external(spark):
    class Flaky(external.DeterministicLLM):
        def complete(self, messages):
            if "fail" in messages[-1]["content"]:
                raise external.CallFailed("no")
            return super().complete(messages)

    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "fail", "c"]), (3, [])], "k int, p array<string>")
    calls = external.complete(df, Flaky(lambda m: m[-1]["content"].upper()), "k", "p")
    assert {r["k"]: r["answers"] for r in calls.collect()} == {1: ["A", "B"], 2: [], 3: []}
    assert external.complete(df.limit(0), Flaky(), "k", "p").count() == 0
    assert external.usage(calls, "large").first()["failed"] == 2

    class Broken(external.DeterministicLLM):
        def complete(self, messages):
            raise KeyError("a mistake in the client")

    with pytest.raises(Exception, match="a mistake in the client"):
        external.complete(df, Broken(), "k", "p")
    e = external.embed(spark.createDataFrame([("x",), (None,)], "t string"), external.DeterministicEmbedder(8), "t").collect()
    assert len(e[0]["embedding"]) == 8 and e[1]["embedding"] is None
    assert external.run_sequence(external.DeterministicLLM(lambda m: m[-1]["content"] + "!"), ["a", lambda prev: prev + "b"])[0] == ["a!", "a!b!"]
    script = iter(['{"actions": [{"name": "add", "args": {"x": 2}}]}', "hm", '{"result": {"decision": "refine", "new_hypothesis": "h2"}}', '{"result": {"decision": "accept"}}'])
    results, traces = external.validate_hypothesis(external.DeterministicLLM(lambda m: next(script)), "h", {"add": lambda x: x + 1})
    assert [r["decision"] for r in results] == ["refine", "accept"] and any('"add": 3' in t.content for t in traces)


def test_evidence_grows(spark):
    claims = spark.createDataFrame([("u", "c1", "first", [1.0, 0.0], 1), ("u", "c2", "second", [0.8, 0.6], 2), ("u", "c3", "third", [-1.0, 0.0], 3)], "user string, label string, description string, embedding array<double>, ord int")
    evidence = spark.createDataFrame([("u", "e", "base", [1.0, 0.0])], "user string, label string, description string, embedding array<double>")
    out = {r["label"]: r for r in assistant.grown_evidence(claims, evidence, lambda t, e: {"supports": True, "confidence": 0.9}).collect()}
    assert out["c2"]["evidence"] == ["e", "c1"] and out["c3"]["supports"] is False


def test_prefix_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((25, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[24] = x[1] * 0.99
    df = spark.createDataFrame([(k, k, x[k].tolist()) for k in range(25)], "id long, o int, e array<double>")
    got = vector_search.prefix_neighbours(df, "id", "e", ["o"], 20, 0.7).where("id = 24").collect()
    assert {r["prev"] for r in got if r["sim"] > 0} == {1} and {r["prev"] for r in got if r["sim"] == 0} == set(range(5, 24))
    assert vector_search.prefix_neighbours(df, "id", "e", ["o"], 20, 0.7).where("id = 0").count() == 0


@pytest.mark.parametrize(("kind", "above"), [("float", 0.3), ("double", -0.5)])
def test_prefix_neighbours_by_blocks(spark, monkeypatch, kind, above):
    """Many blocks find what comparing all with all earlier ones does, in order of ties, with copies, nulls and vectors that are not finite; a row travels no more than once to each block, and once to each stretch."""
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (300, 8)).astype(float)
    x[40:90], x[120], x[130], x[140, 3] = x[7], 0, np.inf, np.nan
    rows = [(500 - k, k, None if k == 150 else x[k].tolist()) for k in range(300)]
    df = spark.createDataFrame(rows, f"id long, o int, e array<{kind}>")
    ordered = df.select("id", F.col("e").alias("v"), (F.col("o") + 1).cast("long").alias("ord"))
    got = vector_search.nearest_earlier(ordered, 5, above, 16).collect()
    want = set()
    for a in range(300):
        if a not in (130, 140, 150):
            seen = sorted((-float(x[a] @ x[b]), b) for b in range(a) if b not in (130, 140, 150))[:5]
            want |= {(500 - a, a + 1, 500 - b, b + 1, -s) for s, b in seen if -s > above}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    monkeypatch.setattr(vector_search, "block_rows", lambda n: 32)
    assert {(r.id, r.prev, r.sim) for r in vector_search.prefix_neighbours(df, "id", "e", ["o"], 5, above).where("sim <> 0").collect()} == {(w[0], w[2], w[4]) for w in want if w[4]}


def test_vectors(spark):
    f = lambda c: one(spark.range(1).select(c))
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert f(V.norm(a)) == 5 and f(V.cosine(a, z)) is None and f(V.padded(a, 3)) == [3.0, 4.0, 0.0] and f(V.padded(a, 1)) == [3.0]
    w = spark.createDataFrame([(k, [x]) for k, x in enumerate([0.0, 0.1, 5.0, 5.1, 9.0])], "id int, e array<double>")
    assert [r["cluster_label"] for r in vector_search.cluster(w, "id", "e", 3).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    df = spark.createDataFrame([(k, [float(k), float(2 * k), 1.0]) for k in range(10)], "id int, embedding array<double>")
    out, models = human.reduced(df, 5, 1)
    assert all(len(r["reduced_embedding"]) == 5 for r in out.collect())
    d = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.1]), (3, [9.0, 9.0])], "id int, v array<double>")
    assert [(r["i"], r["j"]) for r in vector_search.lsh_pairs(d, "id", "v", 0.5).collect()] == [(1, 2)]


def test_change_points_and_segment():
    x = np.array([0.0] * 20 + [50.0] * 20)
    assert sequences.change_points(x) == [20, 40]
    pdf = pd.DataFrame({"index": range(60), "content": "x"})
    out = sequences.segment(lambda w: {"decision": "SPLIT" if len(w) >= 39 else "NO_SPLIT", "sentiment": 0.5})(pdf)
    assert out["chunk_id"].tolist() == [0] * 39 + [1] * 21 and out["sentiment"].notna().sum() == 39


def test_grid_fill_and_rows(spark):
    df = spark.createDataFrame([(1, at(0), None), (2, at(200), 5), (3, at(201), None)], "k int, ts timestamp, v int")
    assert [r["n"] for r in sequences.hourly_grid(df, "ts", F.lit(1)).orderBy("hour").collect()] == [1, 0, 0, 2]
    assert [r["v"] for r in sequences.fill_both(df, "v", ["k"]).orderBy("k").collect()] == [5, 5, 5]
    assert [r["index"] for r in sequences.with_row_index(df, F.desc("k")).orderBy("k").collect()] == [2, 1, 0]
    assert sequences.with_row_index(df.limit(0), "k").count() == 0


def test_change_points_of_long_series():
    """The median of all pairs without listing them, and a series whose kernel would not fit."""
    rng = np.random.default_rng(12)
    for n in (2, 3, 10, 201):
        x = np.round(rng.normal(size=n), 1)
        d = (x[:, None] - x[None]) ** 2
        assert abs(sequences.median_gap(x) - np.median(d[np.triu_indices(n, 1)])) < 1e-12
    levels = rng.permutation(np.arange(60) * 3.0)
    x = np.concatenate([rng.normal(v, 0.3, 1000) for v in levels])
    ends = sequences.change_points(x)
    assert len(ends) >= 50 and ends[-1] == len(x) and all(min(e % 1000, -e % 1000) <= 3 for e in ends)


def test_rechunk_in_blocks(spark, monkeypatch):
    """Blocks of any length against one pass, with partitions of many lengths, empty chunks and chunks beyond the least size."""
    rng = np.random.default_rng(13)
    rows = [(g, k, int(rng.choice([0, 1, 1, 2, 3, 9])), int(k)) for g, n in (("a", 97), (None, 40), ("b", 1), ("c", 12)) for k in range(n)]

    def plain(g, least):
        out, acc, held = {}, 0, []
        mine = [r for r in rows if r[0] == g]
        for _, k, n, _ in mine:
            acc, held = acc + n, [*held, k]
            if acc >= least or k == mine[-1][1]:
                out |= {(g, c): k for c in held}
                acc, held = 0, []
        return out

    df = spark.createDataFrame(rows, "g string, chunk_id long, n int, earliest int")
    for least, block in ((7, 5), (20, 4), (1, 3), (300, 10)):
        monkeypatch.setattr(sequences, "RECHUNK_BLOCK", block)
        got = {(r["g"], r["chunk_id"]): r["new_chunk"] for r in sequences.rechunk(df, least, partition=["g"]).collect()}
        assert got == {k: v for g in ("a", None, "b", "c") for k, v in plain(g, least).items()}
    alone = {("a", r["chunk_id"]): r["new_chunk"] for r in sequences.rechunk(df.where("g = 'a'").drop("g"), 300).collect()}
    assert alone == plain("a", 300)


def test_one_transaction(spark, tmp_path, monkeypatch):
    """A writer that dies between tables, or comes second, changes nothing; readers keep what they opened."""
    store = Store(spark, f"file://{tmp_path}/store")
    table = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    state = lambda tables: {n: sorted(map(tuple, t.collect())) for n, t in tables.items()}
    assert store.tables() == {}
    assert store.upsert({"a": (table((1, "x"), (1, "y")), ["k"]), "b": (table((1, "x")), ["k"])}) == 1
    pinned, first = store.tables(), {"a": [(1, "y")], "b": [(1, "x")]}
    assert state(pinned) == first

    class Broken:
        columns = ["k", "v"]

        def withColumn(self, *_):  # noqa: N802
            raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        store.upsert({"a": (table((1, "new"), (2, "new")), ["k"]), "b": (Broken(), ["k"])})
    assert state(store.tables()) == first
    base, folders = store.manifest()
    assert store.upsert({"b": (table((2, "z")), ["k"])}) == 2
    with pytest.raises(Conflict):
        store.commit(base, folders)
    assert state(store.tables()) == {"a": [(1, "y")], "b": [(1, "x"), (2, "z")]} and state(pinned) == first == state(store.tables(1))
    store.vacuum()
    assert store.versions() == [2] and state(store.tables()) == {"a": [(1, "y")], "b": [(1, "x"), (2, "z")]} and len(list((tmp_path / "store" / "b").iterdir())) == 1


def test_many_chains(spark):
    """Pairs at once, from both ends, against breadth-first search one by one; half of them have no path."""
    rng = np.random.default_rng(8)
    n = 60
    links = {(int(a), int(b)) for a, b in rng.integers(0, n // 2, (70, 2))} | {(int(a) + n // 2, int(b) + n // 2) for a, b in rng.integers(0, n // 2, (60, 2))}
    edges = spark.createDataFrame(sorted(links), "src int, dst int")
    pairs = [(k, int(a), int(b)) for k, (a, b) in enumerate(rng.integers(0, n + 3, (300, 2)))]
    follow = {}
    for a, b in sorted(links):
        if a != b:
            follow.setdefault(a, []).append(b)
    ends = {x for a, b in links if a != b for x in (a, b)}

    def plain(a, b):
        front = {a: [a]}
        seen = {a}
        while front and b not in front:
            new = {}
            for path in sorted(front.values()):
                for d in follow.get(path[-1], []):
                    if d not in seen:
                        new[d] = min(new.get(d, [*path, d]), [*path, d])
            seen |= set(new)
            front = new
        return front.get(b)

    table = spark.createDataFrame(pairs, "pair int, a int, b int").coalesce(1)
    got = {r["pair"]: list(r["path"]) for r in graph.shortest_paths(edges, table).collect()}
    want = {k: p for k, a, b in pairs if a in ends and b in ends and (p := plain(a, b))}
    assert got == want and 30 < len(want) < 270
    nodes = spark.createDataFrame([(k, 1 + k % 3) for k in range(n)], "id int, frequency int")
    few = table.where("pair < 12")
    chains = {}
    for r in graph.causal_chains(nodes, edges, few).orderBy("pair", "place").collect():
        chains.setdefault(r["pair"], []).append((r["id"], r["linked"]))
    for k, a, b in pairs[:12]:
        one = graph.causal_chain(nodes, edges, a, b) if k == 0 else None
        mine = [x for x, _ in chains.get(k, [])]
        assert one is None or a == b or mine == one
        assert (k in chains) == (a < n and b < n) and all(linked == (k in want or a == b) for _, linked in chains.get(k, []))


def test_relational(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "n")], "k int, v string")
    assert {r["k"]: r["v"] for r in relational.refresh(a, b, ["k"]).collect()} == {1: "x", 2: "n", 3: "z"}
    assert relational.drop_keys(a, b, ["k"]).count() == 1
    p = spark.createDataFrame([(1, 2), (3, 3)], "f int, s int")
    assert relational.either_join(a, p, "k", "f", "s").count() == 3
    users = spark.createDataFrame([(1, "alice"), (2, "bob")], "id int, name string")
    nodes = spark.createDataFrame([("n", [1, 9], "both"), ("m", [1], "bob")], "id string, chunk_ids array<int>, user string")
    links = relational.connect(nodes, spark.createDataFrame([(1,)], "chunk_id int"), users)
    assert links["node_chunk"].count() == 2 and links["node_user"].count() == 3
    with pytest.raises(ValueError):
        relational.sample_rows(a, 5, "k")
    assert relational.histogram(a, "v").count() == 3


def test_sources_and_sinks(spark, tmp_path):
    p = f"file://{tmp_path}"
    archive = '[{"id": "c", "title": "t", "mapping": {"z": {"message": {"author": {"role": "user"}, "create_time": 5.0, "content": {"parts": ["q"]}}}, "a": {"message": {"author": {"role": "assistant"}, "create_time": 6.0, "content": {"parts": ["r"]}}}, "n": {"message": null}}}]'
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("conversations.json", archive)
    m = readers.read_archive(spark, f"{p}/x.zip")
    assert [r["role"] for r in m.orderBy("place").collect()] == ["user", "assistant"]
    assert readers.parsed_conversations(m).first().asDict() == {"conversation_id": "c", "title": "t", "date": "1970-01-01", "time": "00:00:05", "question": "q", "answer": "r"}
    (tmp_path / "r.json").write_text('[{"datetime": "2024-01-01 00:00:00", "content": "hi", "from": "a", "count": 1}]')
    assert readers.read_messages(spark, f"{p}/r.json").first()["datetime"] == T0
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    for _ in range(2):
        sinks.upsert(spark, f"{p}/t", df, ["k"])
    sinks.upsert(spark, f"{p}/t", spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert dict(map(tuple, spark.read.parquet(f"{p}/t").collect())) == {1: "a", 2: "c", 3: "d"}
    sinks.write_partitions(df, f"{p}/parts", ["k"])
    sinks.write_partitions(spark.createDataFrame([(2, "z")], "k int, v string"), f"{p}/parts", ["k"])
    assert {r["k"]: r["v"] for r in spark.read.parquet(f"{p}/parts").collect()} == {1: "a", 2: "z"}
    n, e = spark.createDataFrame([("a&", "x<")], "id string, about string"), spark.createDataFrame([("a&", "b")], "src string, dst string")
    sinks.write_graphml(n, e, str(tmp_path / "g.graphml"))
    nodes, edges = readers.read_graphml(spark, f"{p}/g.graphml")
    assert nodes.first()["attributes"] == {"about": "x<"} and edges.first()["src"] == "a&"
    sinks.save_traces(spark, [external.Trace("user", "x")], f"{p}/traces")
    assert spark.read.parquet(f"{p}/traces").count() == 1
    chats = readers.chat_export(
        spark.createDataFrame([(1, None, 1, 0.0, "t", 0, None), (2, 5, 0, 1.0, "u", 0, None)], "session int, member int, from_me int, date double, text string, type int, title string"),
        spark.createDataFrame([(1, "12@s.net", "bob"), (2, "9@g.us", "grp")], "id int, jid string, name string"), spark.createDataFrame([(5, "12@s.net", "bo")], "id int, jid string, name string"),
    )
    assert [(r["from"], r["to_phone_number"]) for r in chats.collect()] == [("me", "12")]


def test_service(spark):
    emb = external.DeterministicEmbedder(8)
    v = emb.embed(["x", "y"])
    nodes = spark.createDataFrame([("a", "x", ["d1"], 2, [1], ["b"], v[0]), ("b", "y", None, 1, [2], [], v[1])], "id string, proposition string, datetimes array<string>, frequency int, chunk_ids array<int>, edges array<string>, embedding array<double>")
    chunks = spark.createDataFrame([(1, "raw one"), (2, "raw two")], "chunk_id int, messages_str string")
    s = Service(nodes, chunks, emb)
    assert [r["id"] for r in s.similar_nodes("x").collect()] == ["a"] and s.causal_chain("a", "b") == ["a", "b"]
    assert s.children("a").first()["datetime"] == "Unknown" and s.parents("b").first()["datetime"] == "d1" and s.raw_data("a") == "raw one" and s.raw_data("?") == ""
    out = s.sql_query("""SELECT n.id, n.embedding, n.embedding <=> q.embedding AS d FROM "CausalGraphNode" n, "QueryEmbedding" q WHERE q.type = 'node' AND 'a <=> b' <> '' ORDER BY d LIMIT 1""", ["y"])
    assert out.columns == ["id", "d"] and out.first()["id"] == "b"
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            s.sql_query(bad)
    assert "l2" not in translate("SELECT '<->'")
    assert s.tools()["rawData"]("b") == "raw two"


class Counted(external.DeterministicLLM):
    """Writes a file a call, so that calls of all workers can be counted."""

    def __init__(self, answer, folder):
        super().__init__(answer)
        self.folder = str(folder)

    def complete(self, messages):
        import hashlib
        import tempfile

        if "Sentiment" in messages[-1]["content"]:  # nodes that say the same ask the same
            return super().complete(messages)
        name = hashlib.md5(repr(messages).encode()).hexdigest()
        with tempfile.NamedTemporaryFile(prefix=name, dir=self.folder, delete=False):
            pass
        return super().complete(messages)

    def most(self):
        import collections
        import os

        return max(collections.Counter(f[:32] for f in os.listdir(self.folder)).values())


def test_backoff():
    import threading
    import time

    calls, asked = [], external.Backoff(0.05)

    def flaky(k):
        calls.append(time.monotonic())
        if len(calls) < 3:
            raise external.RetryLater
        return k

    assert asked.call(flaky, 7) == 7 and calls[1] - calls[0] >= 0.045 and calls[2] - calls[1] >= 0.09
    asked.slow()
    began = time.monotonic()
    others = [threading.Thread(target=asked.call, args=(int,)) for _ in range(3)]
    for t in others:
        t.start()
    for t in others:
        t.join()
    assert time.monotonic() - began >= 0.04
    with pytest.raises(external.RetryLater):
        external.Backoff(0.0).call(lambda: (_ for _ in ()).throw(external.RetryLater()))
    with pytest.raises(external.CallTimeout):
        external.Backoff(0.0).call(time.sleep, 5, timeout=0.05)
    slow = type("Slow", (), {"complete": lambda self, m: time.sleep(5)})()
    assert external.run_sequence(slow, ["a"], timeout=0.05)[0] == []


def test_ids_of_many_frames(spark):
    frame = lambda ids, links: spark.createDataFrame([(i, [t], [(i, t)]) for i, t in zip(ids, links, strict=True)], "id string, edges array<string>, relationships array<struct<source: string, target: string>>")
    got = entities.uniquify_ids([frame(["x"], ["x"]) for _ in range(12)] + [frame(["x", "x_2", "x_3"], ["x_3", "x", "gone"])]).collect()
    assert len({r["id"] for r in got}) == 15
    assert all(r["edges"] == [r["relationships"][0]["target"]] and r["relationships"][0]["source"] == r["id"] for r in got)
    assert sum(r["edges"] == ["gone"] for r in got) == 1


def test_branches(spark, tmp_path):
    """Both branches from end to end with scripted answers; each prompt is sent once."""
    emb = external.DeterministicEmbedder(8)
    node = lambda i: '[{"id": "%s", "proposition": "alice did %s", "caused": [], "caused_by": []}]' % (i, i)  # noqa: E731, UP031
    said = {"split": '{"decision": "SPLIT", "sentiment": -0.5}', "meta": node("m x"), "context": node("c"), "attributes": node("a")}

    def answer(messages):
        p = messages[-1]["content"]
        if "split" in p:
            return said["split"]
        if "earlier" in p:
            return '[{"id": "row1_a", "caused_by": ["row0_c"]}]'
        if "Sentiment" in p:
            return '{"sentiment": 0.25}'
        if "Why" in p:
            return '{"hypothesis": "h"}'
        if "one proposition" in p:
            return '{"proposition": "alice did much"}'
        return next((said[k] for k in ("meta", "context", "attributes") if f"its {k}" in p), "talk")

    llm = Counted(answer, tmp_path)
    messages = spark.createDataFrame([("c", "alice", "me", at(k), f"t{k}") for k in range(45)], "conversation string, `from` string, `to` string, datetime timestamp, content string")
    chunks = human.chunks_rechunked(human.chunks_sequential(messages, llm))
    rows = human.chunk_rows(chunks, "bob").drop("conversation")
    assert rows.count() == 3
    graphs = human.sanitized(human.chunk_subgraphs(rows, llm))
    linked = human.cross_chunk_links(graphs, llm)
    assert any(n["caused_by"] == ["row0_c"] for r in linked.collect() for n in r["subgraph_combined"])
    nodes = human.nodes_deduplicated(human.node_embeddings(linked, emb), "alice", "bob", llm, emb)
    assert nodes.count() == 3 and {r["frequency"] for r in nodes.collect()} == {3}
    assert {r["sentiment"] for r in human.node_sentiments(nodes, llm).collect()} == {0.25}
    assert human.seed_hypotheses(rows, llm).first()["hypothesis"] == "h"

    def answer2(messages):
        p = messages[-1]["content"]
        if "Summarise" in p:
            return '[{"question": "q2", "answer": "a"}]' if "q2" in p else '[{"question": "q", "answer": "a"}]'
        if "category" in p:
            return '{"category": "work", "is_personal": true}'
        if p.startswith("List causal links"):
            return '[{"source": "one", "target": "two"}]'
        if p.startswith("List inferrables"):
            assert "observables: [{" in p
            return '[{"label": "two", "description": "likely two"}]'
        label = "one" if p.startswith("List observables") else "three"
        return '[{"label": "%s", "description": "about %s"}]' % (label, label)  # noqa: UP031

    llm2 = Counted(answer2, tmp_path)
    parsed = spark.createDataFrame([("k", "t", "2024-01-01", "10:00:00", "q", "a"), ("l", "t", "2024-01-02", "10:00:00", "q2", "")], "conversation_id string, title string, date string, time string, question string, answer string")
    assert assistant.transcripts(parsed.select("*"), keep_empty=True).count() == 2
    sk = assistant.skeletons_embedded(assistant.skeletons(assistant.transcripts(parsed), llm2), emb)
    cat = assistant.categorized(assistant.clustered(sk, 1), llm2)
    claims = assistant.claims(cat, llm2)
    found = assistant.graph_nodes(claims)
    assert claims.count() == 2 and {r["label"] for r in found.collect()} >= {"one", "one_2", "two", "two_2"}
    merged = assistant.deduplicated(found, external.DeterministicLLM(lambda m: '{"proposition": "both"}'), emb)
    assert merged.agg(F.sum("frequency")).first()[0] == 6
    assert llm.most() == llm2.most() == 1
    # a batch that fails leaves [] to the next, and its row goes
    failing = external.DeterministicLLM(lambda m: "no JSON" if m[-1]["content"].startswith("List observables") and "ANSWER" not in m[-1]["content"] else answer3(m))
    seen = []

    def answer3(m):
        seen.append(m)
        return answer2(m) if "observables: []" not in m[-1]["content"] else '[{"label": "z", "description": "after a failure"}]'

    assert assistant.claims(cat, failing).count() == 0


def test_streams(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, at(0), 1.0), (1, at(5), 2.0), (1, at(200), 3.0)], "user_id int, ts timestamp, value double").write.parquet(f"{src}/u=1")
    seen = []
    streams.after_each(streams.discover(spark, src, "user_id int, ts timestamp, value double"), str(tmp_path / "ck"), lambda df, k: seen.extend(r["partition"] for r in df.select("partition").distinct().collect())).awaitTermination(60)
    assert seen == ["u=1"]
    read = spark.readStream.schema("user_id int, ts timestamp, value double").parquet(f"{src}/u=1")
    for k, df in enumerate((streams.windowed(read, "ts", "user_id", "value"), streams.sessions(read, "ts", "user_id"))):
        q = df.writeStream.format("memory").queryName(f"out{k}").outputMode("complete" if k == 0 else "append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("out0").collect()) == [1, 2]


def test_orchestrator_and_retries():
    inner = external.DeterministicLLM(lambda m: '{"result": {"said": "%s"}}' % m[1]["content"])  # noqa: UP031
    script = iter(['{"actions": [{"name": "causal", "args": {"query": "why"}}, {"name": "counts", "args": {"query": "how many"}}, {"name": "suggestNextQuestions", "args": {"horizontal": ["a"], "vertical": []}}]}', '{"result": {"done": true}}'])
    outer = external.DeterministicLLM(lambda m: next(script))
    result, traces, asked = external.orchestrate(outer, "s", "task", {"causal": (inner, "c", {}), "counts": (inner, "q", {})})
    assert result == {"done": True} and asked == [{"horizontal": ["a"], "vertical": []}]
    assert any('"said": "why"' in t.content and '"said": "how many"' in t.content for t in traces) and sum(t.role == "system" for t in traces) == 3
    tries, waits = [], []

    def step():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("gone")
        return "ok"

    assert external.with_retries(step, jitter=lambda: 1.0, sleep=waits.append) == "ok" and waits == [30.0, 60.0]
    with pytest.raises(OSError):
        external.with_retries(lambda: (_ for _ in ()).throw(OSError()), 1, sleep=waits.append)
    assert len({k for k in external.MODELS if k not in ("small-hosted", "large", "reasoning", "embedder")}) == 19


def test_delivery():
    posted = []

    def post(p):
        posted.append(p)
        if p == "c":
            raise ConnectionError
        return p != "b"

    done = streams.deliver({"a", "b", "c"}, set(), post)
    assert done == {"a"} and posted == ["a", "b", "c"]
    assert streams.deliver({"b", "c", "d"}, done, lambda p: True) == {"b", "c", "d"}


def test_more_sources(spark, tmp_path):
    import sqlite3

    db = sqlite3.connect(tmp_path / "chat.sqlite")
    db.executescript("""CREATE TABLE ZWACHATSESSION (Z_PK, ZCONTACTJID, ZPARTNERNAME); CREATE TABLE ZWAGROUPMEMBER (Z_PK, ZMEMBERJID, ZCONTACTNAME);
        CREATE TABLE ZWAMESSAGE (ZCHATSESSION, ZGROUPMEMBER, ZISFROMME, ZMESSAGEDATE, ZTEXT, ZMESSAGETYPE);
        INSERT INTO ZWACHATSESSION VALUES (1, '49123@s.net', 'Ann'), (2, 'x@status', 'S'), (3, 'y@g.us', 'G');
        INSERT INTO ZWAMESSAGE VALUES (1, NULL, 1, 0, 'hi', 0), (1, NULL, 0, 60.0, 'ho', 0), (2, NULL, 0, 1, 'no', 0), (3, NULL, 0, 1, 'no', 0);""")
    db.commit()
    db.close()
    got = sorted((r["datetime"], r["from"], r["to"], r["from_phone_number"], r["content"]) for r in readers.read_chat_store(spark, f"file://{tmp_path}/chat.sqlite").collect())
    assert got == [("2001-01-01 00:00:00", "me", "Ann", "me", "hi"), ("2001-01-01 00:01:00", "Ann", "me", "49123", "ho")]

    (tmp_path / "t.csv").write_text('a,b\n1,""\n2,"x, ""y"""\n')
    assert [(r["a"], r["b"]) for r in readers.read_csv_strings(spark, f"file://{tmp_path}/t.csv").collect()] == [("1", None), ("2", 'x, "y"')]
    messages = spark.createDataFrame([("c", "t", 0, "user", 1e9, "q"), ("c", "t", 1, "assistant", 1e9, ""), ("c", "t", 2, "user", 1e9, "r")], readers.ARCHIVE_MESSAGES)
    assert {r["answer"] for r in readers.parsed_conversations(messages).collect()} == {""}
    assert {r["answer"] for r in readers.parsed_conversations(messages, keep_empty=False).collect()} == {None}
    users, phones = spark.createDataFrame([(1, "A"), (2, "B")], "id int, name string"), spark.createDataFrame([("11", 1), ("22", 2)], "phone string, user_id int")
    assert [tuple(r) for r in readers.partners(users, phones, ["22", "33"]).collect()] == [("22", "B")]
    assert readers.lookup(users, F.col("name") == "B")["id"] == 2 and readers.lookup(users, F.col("name") == "C") is None
    assert [r["id"] for r in readers.limited(users, 1, "id").collect()] == [1] and readers.limited(users, None).count() == 2
    users.write.parquet(f"file://{tmp_path}/store/a/b")
    assert readers.under_prefix(spark, f"file://{tmp_path}/store/", "/a/b/").count() == 2


def test_more_sinks(spark, tmp_path):
    root = f"file://{tmp_path}/graph"
    nodes = spark.createDataFrame([("row1_a", ["row2_b"], [1], "ann"), ("row2_b", [], [1, 2], "both")], "id string, edges array<string>, chunk_ids array<int>, user string")
    chunks, users = spark.createDataFrame([(1, "x"), (2, "y")], "chunk_id int, messages_str string"), spark.createDataFrame([(7, "ann"), (8, "bob")], "id int, name string")
    for _ in range(2):  # twice is once
        sinks.save_graph(spark, root, nodes, chunks, users)
    held = Store(spark, root)
    read = lambda name: sorted(map(tuple, held.tables()[name].collect()))
    assert read("node_chunk") == [("a", 1), ("b", 1), ("b", 2)] and read("node_user") == [("a", 7), ("b", 7), ("b", 8)]
    assert [r[0] for r in read("nodes")] == ["a", "b"] and held.tables()["nodes"].where("id = 'a'").first()["edges"] == ["b"]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception, match="(?i)parquet"):  # a table that can't be read is not taken for none
        sinks.upsert(spark, f"file://{tmp_path}/broken", users, ["id"])
    assert (tmp_path / "broken" / "part-0.parquet").read_text() == "not a table"
    sinks.write_json(users, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").count() == 2
    e = spark.createDataFrame([([float(k), float(k % 3), 1.0],) for k in range(9)], "embedding array<double>")
    models = vector_search.fit_pca(e, "embedding", 2)
    sinks.save_models(models, f"file://{tmp_path}/models")
    kept = vector_search.apply_pca(e, sinks.load_models(f"file://{tmp_path}/models"), "embedding", 4).collect()
    assert [r["reduced_embedding"] for r in kept] == [r["reduced_embedding"] for r in vector_search.apply_pca(e, models, "embedding", 4).collect()]
    odd = spark.createDataFrame([('a"<&', "x > y"), ("b", None)], "id string, said string")
    sinks.write_graphml(odd, spark.createDataFrame([('a"<&', "b")], "src string, dst string"), f"file://{tmp_path}/odd.graphml")
    n, g = readers.read_graphml(spark, f"file://{tmp_path}/odd.graphml")
    assert {r["id"]: r["attributes"].get("said") for r in n.collect()} == {'a"<&': "x > y", "b": None} and g.first()["src"] == 'a"<&'


def test_long_paths_and_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(80)], "src int, dst int")
    assert graph.shortest_path(edges, 0, 80) == list(range(81)) and graph.shortest_path(edges, 0, 80, most=10) is None
    found = graph.components(edges)
    assert found.count() == 81 and found.select("component").distinct().count() == 1


def test_lookback_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(g, k, at(s := rng.randrange(5000)), at(s + rng.randrange(3000)) if rng.random() < 0.95 else None) for g in ("a", None) for k in rng.sample(range(500), 60)]
    chunks = spark.createDataFrame(rows, "g string, chunk_id int, start_dt timestamp, end_dt timestamp")
    want = set()
    for g, k, start, _ in rows:
        before = sorted((r for r in rows if r[0] == g and r[1] < k and r[3] is not None), key=lambda r: (-r[3].timestamp(), r[1]))[:4]
        want |= {(g, k, r[1], n) for n, r in enumerate(before, 1) if n <= 2 or (start - r[3]).total_seconds() <= 3600}
    for block in (20_000, 7):
        monkeypatch.setattr(sequences, "LOOK_BLOCK", block)
        got = sequences.lookback(chunks, partition=["g"], most=4, always=2, within="INTERVAL 1 HOUR").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
        alone = sequences.lookback(chunks.where("g = 'a'").drop("g"), most=4, always=2, within="INTERVAL 1 HOUR").collect()
        assert {("a", *r) for r in alone} == {w for w in want if w[0] == "a"}


def test_change_points_against_all_partitions():
    rng = np.random.default_rng(6)
    for n in (7, 12, 16):
        x = np.concatenate([rng.normal(0, 0.2, n // 2), rng.normal(4, 0.2, n - n // 2)])
        d = (x[:, None] - x[None]) ** 2
        k = np.exp(-np.clip(d / np.median(d[np.triu_indices(n, 1)]), 1e-2, 1e2))
        cost = lambda a, b: np.trace(k[a:b, a:b]) - k[a:b, a:b].sum() / (b - a)

        def best(b, cost=cost, n=n):
            options = [(cost(a, b) + (np.log(n) if a else 0) + rest, [*ends, b]) for a in [0, *range(3, b - 2)] if b - a >= 3 for rest, ends in [best(a) if a else (0.0, [])]]
            return min(options, key=lambda o: o[0])

        assert sequences.change_points(x, 3) == best(n)[1]


def test_compression_ratio(spark):
    import gzip

    texts = ["", "a", "abc" * 500, "ünï " * 40, None]
    got = [r["r"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", vector_search.compression_ratio(F.col("t")).alias("r")).orderBy("k").collect()]
    assert got == [None if not t else len(t.encode()) / len(gzip.compress(t.encode(), mtime=0)) for t in texts]


def test_stream_of_messages_in_segments(spark, tmp_path):
    """Windows that stay open from batch to batch give the same chunks as one batch."""
    decide = lambda rows: {"decision": "SPLIT" if rows[-1]["index"] % 5 == 4 else "NO_SPLIT", "sentiment": rows[0]["index"] / 10}
    src = f"file://{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame([(c, i, f"m{i}") for c in ("a", "b") for i in range(k * 13, (k + 1) * 13)], "conversation string, index long, content string").coalesce(1).write.mode("append").parquet(src)
    read = spark.readStream.schema("conversation string, index long, content string").option("maxFilesPerTrigger", 1).parquet(src)
    out = streams.segmented(read, "conversation", decide, first=4, step=3, force=10)
    q = out.writeStream.format("memory").queryName("segments").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = {(r["conversation"], r["index"]): (r["chunk_id"], r["sentiment"]) for r in spark.table("segments").collect()}
    whole = sequences.segment(decide, first=4, step=3, force=10)(pd.DataFrame({"index": range(39), "content": [f"m{i}" for i in range(39)]}))
    closed = whole[whole["chunk_id"] < whole["chunk_id"].max()]
    assert got == {(c, i): (k, s) for c in ("a", "b") for i, k, s in zip(closed["index"], closed["chunk_id"], closed["sentiment"], strict=True)} and len(got) > 40


def test_graphml_in_many_blocks(spark, tmp_path, monkeypatch):
    """One file read by many tasks gives what a parser gives, wherever its blocks end; what tags alone don't tell is parsed whole."""
    body = "".join(f"<node id='n{k}'>\n <data key=\"d0\">a &lt;b&gt; &#38; {k} > {k}\n</data><data key='d1'/></node>\n<edge source=\"n{k}\" target='n{k + 1}'><data key='d2'>e</data></edge>" for k in range(40))
    keys = '<key id="d0" for="node" attr.name="said"/><key id="d2" for="edge" attr.name="w"/>'
    file = f"<?xml version='1.0'?>\n<g:graphml xmlns:g='x' xmlns='x'>{keys}<graph id='G'>{body}<node id='last'/></graph></g:graphml>"
    (tmp_path / "plain.graphml").write_text(file)
    (tmp_path / "odd.graphml").write_text(file.replace("<graph id='G'>", "<graph id='G'><!-- <node id='no'/> -->"))
    want_nodes = sorted([(f"n{k}", ("d1", ""), ("said", f"a <b> & {k} > {k}\n")) for k in range(40)] + [("last",)])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for name, bound in (("plain", 97), ("plain", 1000), ("odd", 333)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", bound)
            with monkeypatch.context() as m:
                if name == "plain":  # no task may have the whole file
                    m.setattr(readers, "whole_graphml", None)
                nodes, edges = readers.read_graphml(spark, f"file://{tmp_path}/{name}.graphml")
            assert sorted((r["id"], *sorted(r["attributes"].items())) for r in nodes.collect()) == want_nodes
            assert sorted(map(tuple, edges.collect())) == sorted((f"n{k}", f"n{k + 1}") for k in range(40))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / "cut.graphml").write_text(file[: len(file) // 2])
    with pytest.raises(Exception, match="ParseError|no element found"):
        readers.read_graphml(spark, f"file://{tmp_path}/cut.graphml")[0].collect()


def test_contain_compares_what_it_finds(spark):
    """Slots and equality find what comparing all does, with ranges of no length, backward ones, nulls and ends that touch."""
    from weftline.operators import relational

    rng = np.random.default_rng(4)
    p = [(k, int(rng.integers(0, 2)), at(0, seconds=int(rng.integers(0, 5000)))) for k in range(300)] + [(900, None, at(1)), (901, 0, None)]
    r = [(k, int(rng.integers(0, 2)), at(0, seconds=(s := int(rng.integers(0, 5000)))), at(0, seconds=s + int(rng.choice([0, 0, 40, 3000, -5])))) for k in range(200)] + [(990, 0, None, at(9)), (991, None, at(0), at(99))]
    want = {(a, b) for a, d, t in p for b, e, s, u in r if None not in (d, e, t, s, u) and d == e and s <= t <= u}
    points, ranges = spark.createDataFrame(p, "p long, day int, t timestamp"), spark.createDataFrame(r, "r long, day int, s timestamp, e timestamp")
    out = relational.contain(points, ranges, "day", "t", "s", "e")
    got = out.select("p", "r").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want and sorted(out.columns) == ["day", "e", "p", "r", "s", "t"]
    assert "_slot" in out._jdf.queryExecution().optimizedPlan().toString()
    still = relational.contain(points, ranges.where("s = e"), "day", "t", "s", "e").select("p", "r").collect()
    assert sorted(map(tuple, still)) == sorted((a, b) for a, b in want if r[b][2] == r[b][3])


def test_contain_copies_ranges_as_input_allows(spark):
    """Many long ranges and few points: copies of ranges are bounded by rows of input, and all that is found stays."""
    from weftline.operators import relational

    points = spark.range(50).select(F.col("id").alias("p"), F.lit(0).alias("day"), (F.col("id") * 97).alias("t"))
    ranges = spark.range(400).select(F.col("id").alias("r"), F.lit(0).alias("day"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + F.when(F.col("id") % 4 == 0, 0).otherwise(900)).alias("e"))
    out = relational.contain(points, ranges, "day", "t", "s", "e")
    got = sorted(map(tuple, out.select("p", "r").collect()))
    assert got == sorted((p, r) for p in range(50) for r in range(400) if 0 <= 97 * p - 10 * r <= (900 if r % 4 else 0))
    plan = out._jdf.queryExecution().optimizedPlan()
    made = [(plan.p(k).nodeName(), k) for k in range(100) if plan.p(k) is not None]
    spread = next(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.p(k)) for name, k in made if name == "Generate")
    assert 300 < spread.count() <= 450 + 2 * 300


def test_short_change_points_are_the_same():
    rng = np.random.default_rng(6)
    for n in (1, 5, 6, 40, 99):
        x = np.sort(rng.choice([rng.random(n) * 700, rng.integers(0, 9, n) * 50.0], (20, 1))[:, 0] if n > 1 else rng.random((20, 1)), axis=1)
        x[3] = 7.0
        assert sequences.short_change_points(x) == [sequences.change_points(row) for row in x]


def test_change_point_sessions_many_users(spark, monkeypatch):
    """Users come in batches of any size, null is one of them, and long ones are searched alone: no group is formed for each."""
    rng = np.random.default_rng(8)
    rows = [(None if u == 3 else u, k, at(0, seconds=int(t))) for u in range(30) for k, t in enumerate(np.sort(rng.integers(0, 10**6, rng.integers(1, 60))))]
    df = spark.createDataFrame(rows, "u long, k long, ts timestamp")
    monkeypatch.setattr(sequences, "TOGETHER", 100)
    monkeypatch.setattr(sequences, "SHORT", 40)
    out = sequences.change_point_sessions(df, ["u"], "k", "ts")
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["k"]):
        got.setdefault(r["u"], []).append(r["session"])
    for u in range(30):
        x = np.array([r[2].timestamp() / 3600 for r in rows if r[0] == (None if u == 3 else u)])
        assert got[None if u == 3 else u] == np.searchsorted(sequences.change_points(x), np.arange(len(x)), side="right").tolist()
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_lookback_forms_no_group_a_user(spark):
    chunks = spark.createDataFrame([(u, k, at(k), at(k)) for u in range(5) for k in range(4)], "u long, chunk_id int, start_dt timestamp, end_dt timestamp")
    out = sequences.lookback(chunks, partition=["u"])
    assert out.count() == 30 and "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_compression_ratio_takes_few_texts_at_once(spark):
    out = spark.range(1).select(vector_search.compression_ratio(F.lit("a" * 100)).alias("r"))
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString() and one(out) > 1
