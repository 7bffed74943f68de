"""Archives, search, mixing, packing and the pipeline: round trips and brute force."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftline.llm import ann, common, cutting_stock, mixing, packing, warc
from tests.conftest import SF

FALSE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_warc(spark):
    rows = [(i, f"http://h/{i}", "x" * (i * 37 % 1500) + FALSE * (i % 4) + ("WARC/1." if i % 5 == 0 else "") + "é" * (i % 7)) for i in range(80)]
    rows += [(900, None, None), (901, "u\r\nv", ""), (902, "u", "z" * 300_000)] + [(1000 + i, "u", rows[40 + i % 3][2]) for i in range(9)]
    pages = spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, body string").coalesce(2)
    path = common.new_path(spark, "warc")
    warc.write_warc(pages, path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), i)
    try:
        for size in ("2k", "128m"):  # many byte ranges a file, and one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r["record_id"]: r for r in warc.read_warc(spark, path).collect()}
            assert len(got) == len(rows)
            for i, _, h in rows:
                r, b = got[f"<urn:x-page:{i}>"], (h or "").encode()
                if len(b) >= 1000 and top[h] != i:
                    assert (r["type"], r["digest"], r["http_bytes"], r["refers_to"]) == ("revisit", hashlib.sha1(b).hexdigest(), len(b), f"<urn:x-page:{top[h]}>")
                else:
                    assert (r["type"], r["payload_sha1"], r["payload_bytes"]) == ("response", hashlib.sha1(b).hexdigest(), len(b))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    path = common.new_path(spark, "warc-empty")
    warc.write_warc(pages.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_warc_odd_ids(spark):
    rows = [(5, "a", "y" * 2000), (5, "a", "y" * 2000), (None, "b", "y" * 2000), (4, "c", "y" * 2000)]
    path = common.new_path(spark, "warc-odd")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    assert sorted(r["type"] for r in warc.read_warc(spark, path).collect()) == ["response", "response", "response", "revisit"]


def test_ann(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.array(v["embedding"].tolist(), dtype=float), v["vec_id"].to_numpy()
    got, hit, total = ann.op5_ann(spark, SF).toPandas(), 0, 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        mine = got[got["query_id"] == q].sort_values("rank")
        hit += len(set(mine["vec_id"]) & set(ids[np.lexsort((ids, d))[:10]]))
        total += 10
        assert all(abs(s - d[ids == i][0]) < 1e-12 for s, i in zip(mine["score"], mine["vec_id"], strict=True)) and list(mine["rank"]) == list(range(1, 11))
    assert hit / total >= 0.9


def test_ann_edges(spark):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, float("nan")]), (4, [1.0, None]), (5, [1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0, float("inf")])]
    rows += [(100 * i, [1.0, float(i)]) for i in range(5)] + [(1001 + i, [1.0, 2.0]) for i in range(30)] + [(1001, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, leaf int, tree int")
    got = ann.knn(df, "id % 100 = 0").collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 200] == list(range(1001, 1011))
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 300][:2] == [(200, 1.0), (400, 1.0)]
    assert ann.knn(df.limit(0), "id % 100 = 0").count() == 0 and ann.knn(df.where("vec_id = 100"), "id % 100 = 0").count() == 0
    assert len(ann.knn(df.where("vec_id IN (100, 200, 300)"), "id % 100 = 0").collect()) == 6


def test_ann_repeats_lengths_and_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(100, [1.0, 0.0, 0.01 * k]) for k in range(200)] + [(k, [*map(float, rng.standard_normal(3))]) for k in range(1, 60)]
    rows += [(200, [1.0, 2.0]), (201, [1.0, 2.5]), (300, [1e300, -1e300, 3.0, 1.0]), (301, [1e300, 1e300, 3.0, 1.0]), (302, [-1e300, 1e299, 3.0, 1.0])]
    got = ann.knn(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 100 = 0").collect()
    mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 100)
    want = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, [1.0, 0.0, 0.0], strict=True)))), i) for i, v in rows if 0 < i < 60)[:10]
    true = {i: d for d, i in want}
    assert [n for n, _, _ in mine] == list(range(1, 11)) and len({i for _, i, _ in mine} & true.keys()) >= 8 and all(abs(d - true[i]) < 1e-12 for _, i, d in mine if i in true)
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 200] == [(201, 0.5)]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 300] == [301, 302]


def test_mixing(spark):
    docs = [(i, "big" if i % 3 else ("small" if i % 2 else None), "t") for i in range(3000)] + [(None, "big", None), (7, "big", ""), (7, "big", "")]
    df = spark.createDataFrame([(*d, 0.5, "z") for d in docs], "doc_id long, source string, text string, mix_rate double, mix_n string")
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    out = mixing.mix(df, weights=weights, epochs=2.0)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert None not in n and abs(n["big"] - 1500) < 150 and abs(n["small"] - 4500) < 400
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, mixing.mix(df, weights=weights, epochs=2.0).collect()), key=str)
    places = sorted(r["position"] for r in mixing.shuffled(out).select("position").collect())
    assert places == list(range(out.count()))
    assert mixing.mix(df.limit(0)).count() == 0
    counts = collections.Counter(r["doc_id"] for r in mixing.mix(spark.createDataFrame([(i, "a") for i in range(400)], "doc_id long, source string"), epochs=60.0).collect())
    assert abs(np.mean(list(counts.values())) - 60) < 2 and abs(np.var(list(counts.values())) - 60) < 20


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(packing.tokenizer_file())
    t.encode_special_tokens = True
    return t


def check_pieces(rows, got, tokenizer, sequence=4096):
    want, by, sequences = collections.Counter(), collections.defaultdict(list), collections.defaultdict(list)
    for i, t in rows:
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])] += 1
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for (i, ids), n in want.items():
        a = np.array(ids, dtype="<u4")
        for start in range(0, len(a), sequence):
            piece = a[start : start + sequence]
            crc = zlib.crc32(piece.tobytes())
            assert sum((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) == (start, len(piece), crc, len(a)) for r in by[i]) == n
    assert len(got) == sum(n * -(-len(ids) // sequence) for (_, ids), n in want.items())
    padding = tokens = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= sequence
        padding += 0 if at & (at - 1) == 0 else sequence - at
        tokens += at
    return padding / (padding + tokens)


def test_packing(spark, tokenizer):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + [(-1, None), (-2, ""), (-3, "Σίσυφος ΟΔΟΣ İstanbul 日本語 don't we'll  ½ ²x y \xad z<|endoftext|>"), (-4, "it's!'s '' 's"), (None, "n"), (-5, "same"), (-5, "same"), (-6, "long " * 30_000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, size string, rank int")
    assert check_pieces(rows, packing.pack(df, packing.tokenizer_file()).collect(), tokenizer) < 0.05
    assert packing.pack(df.limit(0), packing.tokenizer_file()).count() == 0
    ids = packing.pack(df.where("doc_id = -4"), packing.tokenizer_file(), with_ids=True).first()["ids"]
    assert ids == tokenizer.encode("it's!'s '' 's", add_special_tokens=False).ids + [2]


def test_cutting_stock():
    rng = np.random.default_rng(0)
    for sizes in ([512] * 3, [1], rng.integers(1, 513, 400), rng.integers(1, 60, 3000), []):
        h = dict(collections.Counter(int(s) for s in sizes))
        held, bins = collections.Counter(), 0
        for pattern, n in cutting_stock.whole_patterns(h, 512):
            assert sum(s * k for s, k in pattern.items()) <= 512
            bins += n
            for s, k in pattern.items():
                held[s] += k * n
        assert all(held[s] >= n for s, n in h.items())
        assert bins <= 1.15 * sum(s * n for s, n in h.items()) / 512 + 1 or max(h) > 256


def test_pipeline(spark, tokenizer):
    """Each stage against what a plain version keeps of its own input."""
    import corpus_pipeline as cp
    from tests.llm.test_dedup import model_near

    docs = common.table(spark, SF, "documents").limit(120)
    held, seen = docs, {}
    for name, stage in cp.STAGES:
        before = held
        held = common.cut(stage(spark, held, SF), name)
        seen[name] = (before, held)
        if name != "packing":
            assert held.columns == docs.columns
    rows = lambda d: [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    before, after = map(rows, seen["toxicity"])
    assert set(after) <= set(before) and len(after) > 0.7 * len(before)
    before, after = map(rows, seen["line_dedup"])
    lines = [s.strip() for _, t in after for s in (t or "").split("\n") if len(s.strip()) >= 24]
    assert len(lines) == len(set(lines)) and {i for i, _ in after} <= {i for i, _ in before}
    before, after = map(rows, seen["near_dedup"])
    assert {i for i, _ in after} == {i for i, _, _, kept in model_near(before) if kept}
    before, after = map(rows, seen["mixing"])
    assert set(after) <= set(before)
    before, after = seen["packing"]
    check_pieces(rows(before), after.collect(), tokenizer)


def test_packing_special_tokens(spark):
    whole = Tokenizer.from_file(packing.tokenizer_file())  # as it is by default
    texts = ["end <|endoftext|> next", "<|startoftext|>a<|endoftext|>", "é日 <|endoftext|>", "END <|ENDOFTEXT|> next", "plain <|other|> text", "x<|endoftext|> <|endoftext|>y's 12"]
    ids = packing.Ids(open(packing.tokenizer_file()).read(), literal=False)
    assert [a.tolist() for a in ids.of(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for literal in (False, True, False):
        whole.encode_special_tokens = literal
        got = {r["doc_id"]: r["ids"] for r in packing.pack(df, packing.tokenizer_file(), with_ids=True, literal=literal).collect()}
        assert got == {k: whole.encode(t, add_special_tokens=False).ids + [2] for k, t in enumerate(texts)}
    assert got[0] == [806, 49407, 1131, 2]


def test_packing_query_has_the_default(spark, tmp_path):
    spark.createDataFrame([(1, "end <|endoftext|> next")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert packing.op8_pack(spark, str(tmp_path)).first()["doc_tokens"] == 4


def test_warc_ids_with_several_payloads(spark):
    a, b, c = "a" * 2000, "b" * 2000, "c" * 2000
    rows = [(5, a), (5, b), (5, c), (9, a), (8, b)]
    path = common.new_path(spark, "warc-several")
    warc.write_warc(spark.createDataFrame([(i, "u", h, "s", "r") for i, h in rows], "page_id long, url string, html string, sha string, refers_to string"), path)
    got = sorted((r["record_id"], r["type"], r["digest"], r["refers_to"]) for r in warc.read_warc(spark, path).collect())
    sha = lambda h: hashlib.sha1(h.encode()).hexdigest()
    name = lambda i: f"<urn:x-page:{i}>"
    assert got == sorted([(name(5), "revisit", sha(a), name(9)), (name(5), "revisit", sha(b), name(8)), (name(5), "response", sha(c), None), (name(9), "response", sha(a), None), (name(8), "response", sha(b), None)], key=str)


def test_mixing_at_high_rates(spark):
    docs = spark.createDataFrame([(k, "a") for k in range(20)], "doc_id long, source string")
    for rate in (31.0, 33.0, 1000.0, 20_000.0):
        n = [r["n"] for r in docs.select(mixing.copies_of(docs["doc_id"].cast("string"), mixing.F.lit(rate), "s").alias("n")).collect()]
        assert len(set(n)) > 5 and abs(np.mean(n) - rate) < 5 * (rate / 20) ** 0.5 and abs(np.std(n) / rate**0.5 - 1) < 0.6
    assert {r["n"] for r in docs.select(mixing.copies_of(docs["doc_id"].cast("string"), mixing.F.lit(0.0), "s").alias("n")).collect()} == {0}


def test_pipeline_odd_rows(spark):
    """Null, empty, long and repeated rows, an empty table, and columns named as the stages name theirs."""
    import corpus_pipeline as cp

    names = ["tox_score", "tox_text", "gone_id", "gone_lines", "gone_key", "mix_n", "mix_rate", "mix_source", "mix_null", "mix_copy", "mix_key", "size", "part", "rank", "bucket", "win", "component"]
    docs = common.table(spark, SF, "documents").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (900, "", "x", None, 0), (900, "", "x", None, 0), (901, "word " * 40_000, "x", "hot", 1), (901, "other text", "x", "hot", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd.select(*[odd[c].cast(t).alias(c) for c, t in docs.dtypes])).selectExpr("*", *(f"'{n}!' as {n}" for n in names))
    for held in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            n, columns = held.count(), held.columns
            held = common.cut(stage(spark, held, SF), name)
            if name != "packing":
                assert held.columns == columns and held.where(" OR ".join(f"{n} <> '{n}!'" for n in names)).count() == 0
            assert n == 0 or held.count() > 20
