"""Repeated lines: an edit join over segments, verified by banded bit-parallel edit distance.

A line is cut into one segment more than the edits that its length allows; two lines within the edits of the shorter share one of its segments, shifted by
what the segment's place and the lengths allow. Every distinct line puts out the hashes of its segments and of the
substrings that could be another line's segment, packed by bucket, so a key is 8 bytes in a block and never a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, components, cut, enter, free_names, join_sized, ship, shuffle_partitions, small_batches, table, worker_cache
from .edit_distance import within
from .shingles import U, mix64

ship(__name__)

EDITS = 2
#: A line has one edit for so many characters, up to EDITS; shorter lines have none and are joined where they are equal.
EDIT_CHARS = 8
#: Distinct lines that are keyed at once, by characters.
BLOCK_CHARS = 1 << 19
#: Lines that a task remembers having put out; beyond that it may put them out again.
SEEN_LINES = 250_000
#: A key with more entries than this is split, found by the keys with HOT_LINES entries or more in one of every HOT_EVERY batches; HOT_KEYS at most, the most frequent ones.
HOT_ENTRIES, HOT_LINES, HOT_EVERY, HOT_KEYS = 200_000, 32, 4, 100_000
#: Pairs of a key that are looked at in one go.
PAIR_BLOCK = 1 << 20
BASE = 0x2545F4914F6CDD1D | 1
_code = np.random.default_rng(5).integers(1, 1 << 63, 4096, dtype=np.uint64)
_fold = np.array([1 << (4 * k) for k in range(16)], dtype=np.uint64)


def line_id(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def lines_of(text: str | None) -> list[tuple[int, str]]:
    """(number, line) of the lines that are not blank."""
    return [(k, s) for k, line in enumerate((text or "").split("\n")) if (s := line.strip())]


def allowed(length: np.ndarray | int, edits: int) -> np.ndarray | int:
    """Edits of a line of this length; of two lines, the shorter one's count."""
    return np.minimum(edits, length // EDIT_CHARS)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = worker_cache()
    if len(kept.get("line_up", ())) <= n:
        for key, base in (("line_up", BASE), ("line_down", pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n + 1, BLOCK_CHARS + 1), base, dtype=np.uint64)
            steps[0] = 1
            kept[key] = np.cumprod(steps)
    return kept["line_up"], kept["line_down"]


def segment(length: np.ndarray, k: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment k of lines of these lengths; the last ones are longer by one where it doesn't divide."""
    short, longer = length // (edits + 1), length % (edits + 1)
    from_long = edits + 1 - longer
    return k * short + np.maximum(0, k - from_long), short + (k >= from_long)


def keys_of(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, probe, letters) of the segments and probes of distinct lines: line is a place in the list; letters counts characters in 16 classes of 4 bits."""
    size = np.array([len(x) for x in lines], dtype=np.int64)
    chars = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    up, down = powers(len(chars))
    sums = np.zeros(len(chars) + 1, dtype=np.uint64)
    np.cumsum((_code[chars & 4095] + chars.astype(np.uint64)) * up[: len(chars)], out=sums[1:])
    of = np.repeat(np.arange(len(lines)), size)
    counts = np.bincount(of * 16 + (chars * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.int64), minlength=16 * len(lines)).reshape(-1, 16)
    letters = ((counts & 15).astype(np.uint64) * _fold).sum(axis=1)
    key, line, probe = [], [], []

    def put(rows: np.ndarray, start: np.ndarray, length: np.ndarray, of_length: np.ndarray, k: int, is_probe: bool) -> None:
        ok = np.flatnonzero((start >= 0) & (start + length <= size[rows]))
        a = starts[rows[ok]] + start[ok]
        found = (sums[a + length[ok]] - sums[a]) * down[a]
        key.append(mix64(found + of_length[ok].astype(np.uint64) * U(0x9E3779B97F4A7C15) + U((k + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))))
        line.append(rows[ok])
        probe.append(np.full(len(ok), is_probe))

    # lines that hold segments are the shorter ones of their pairs, so their lengths say how many edits there are
    for n in range(1, edits + 1):
        for less in range(n + 1):
            rows = np.flatnonzero(allowed(size - less, edits) == n)
            of_length = size[rows] - less
            for k in range(n + 1):
                at, length = segment(of_length, k, n)
                if not less:
                    put(rows, at, length, of_length, k, False)
                for shift in range(max(-k, less - (n - k)), min(k, less + n - k) + 1):
                    put(rows, at + shift, length, of_length, k, True)
    return np.concatenate(key), np.concatenate(line), np.concatenate(probe), letters


ENTRY = np.dtype([("key", "<u8"), ("line", "<i8"), ("letters", "<u8"), ("probe", "u1")])


def new_lines(texts: list[str | None], edits: int, seen: set[int], held: dict[int, str]) -> Iterator[dict[int, str]]:
    """Blocks of distinct lines that may have edits, by id, of about BLOCK_CHARS characters; what is left stays in held."""
    chars = sum(map(len, held.values()))
    for text in texts:
        for _, s in lines_of(text):
            if allowed(len(s), edits) and (h := line_id(s)) not in seen:
                seen.add(h)
                held[h] = s
                chars += len(s)
                if chars >= BLOCK_CHARS:
                    yield held
                    held.clear()
                    chars = 0
                    if len(seen) > SEEN_LINES:  # repeats only cost a second copy of their keys
                        seen.clear()


def frequent_keys(edits: int):
    """(key, held, asks): how many lines of every HOT_EVERYth batch hold and probe for a key, of keys that are frequent there. It only says what to split, so it may miss some."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lines")
        for n, batch in enumerate(batches):
            if n % HOT_EVERY:
                continue
            held: dict[int, str] = {}
            for block in [*map(dict, new_lines(batch.column(0).to_pylist(), edits, set(), held)), held]:
                if block:
                    key, _, probe, _ = keys_of(list(block.values()), edits)
                    names, at, n_all = np.unique(key, return_inverse=True, return_counts=True)
                    asks = np.bincount(at, weights=probe, minlength=len(names)).astype(np.int64)
                    often = n_all >= HOT_LINES
                    yield pa.RecordBatch.from_arrays([pa.array(names[often].view(np.int64)), pa.array((n_all - asks)[often]), pa.array(asks[often])], ["key", "held", "asks"])

    return count


def emit_keys(bits: int, edits: int, hot):
    """(bucket, i, j, block): entries of keys packed by bucket; a hot key is a bucket of its own, whose holders are dealt to rows i and whose probes to columns j of a grid."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lines")
        hot_keys, n_rows, n_columns = hot.value
        seen: set[int] = set()
        held: dict[int, str] = {}

        def drain(block: dict[int, str]) -> pa.RecordBatch:
            ids, lines = np.array(list(block), dtype=np.int64), list(block.values())
            key, line, probe, letters = keys_of(lines, edits)
            order = np.argsort(key, kind="stable")
            record = np.zeros(len(key), dtype=ENTRY)
            record["key"], record["line"], record["letters"], record["probe"] = key[order], ids[line[order]], letters[line[order]], probe[order]
            out: list[tuple[int, int, int, bytes]] = []
            if len(hot_keys):
                at = np.minimum(np.searchsorted(hot_keys, record["key"]), len(hot_keys) - 1)
                is_hot = hot_keys[at] == record["key"]
                for q in np.unique(at[is_hot]).tolist():
                    mine = record[is_hot & (at == q)]
                    place = mix64(mine["line"].view(np.uint64))
                    row, column = place % U(n_rows[q]), place % U(n_columns[q])
                    for i in range(int(n_rows[q])):
                        for j in range(int(n_columns[q])):
                            part = mine[np.where(mine["probe"] == 1, column == j, row == i)]
                            out += [(-1 - q, i, j, part.tobytes())] if len(part) else []
                record = record[~is_hot]
            bucket = (record["key"] >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(record), dtype=np.int64)
            names, first = np.unique(bucket, return_index=True)
            out += [(n, 0, 0, record[x:y].tobytes()) for n, x, y in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(record)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "i", "j", "block"])

        for batch in batches:
            for block in new_lines(batch.column(0).to_pylist(), edits, seen, held):
                yield drain(block)
        if held:
            yield drain(held)

    return emit


def match_bucket(edits: int):
    """Pairs of lines of which one has a segment that the other probes for, unless their character counts are too far apart."""

    def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.zeros(np.broadcast_shapes(a.shape, b.shape), dtype=np.int64)
        for k in range(16):
            d = ((a >> U(4 * k)) - (b >> U(4 * k))).astype(np.int64) & 15
            total += np.minimum(d, 16 - d)
        return total > 2 * edits

    def match(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = np.concatenate([np.frombuffer(b, dtype=ENTRY) for pdf in blocks for b in pdf["block"]])
        every = every[np.argsort(every["key"], kind="stable")]
        key = every["key"]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))

        def told(src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
            pairs = np.unique(np.stack([np.minimum(src, dst), np.maximum(src, dst)], axis=1), axis=0) if len(src) else np.zeros((0, 2), dtype=np.int64)
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        # keys of two entries, which most are, in one go
        two = first[size == 2]
        a, b = every[two], every[two + 1]
        ok = (a["probe"] != b["probe"]) & (a["line"] != b["line"])
        a, b = a[ok], b[ok]
        ok = ~far(a["letters"], b["letters"])
        src, dst, n = [a["line"][ok]], [b["line"][ok]], 0
        for f, m in zip(first[size > 2], size[size > 2], strict=True):
            group = every[f : f + m]
            _, one = np.unique(group[["line", "probe"]], return_index=True)
            group = group[one]
            held, asks = group[group["probe"] == 0], group[group["probe"] == 1]
            step = max(1, PAIR_BLOCK // max(1, len(asks)))
            for k in range(0, len(held), step):
                part = held[k : k + step]
                i, j = np.nonzero(~far(part["letters"][:, None], asks["letters"][None, :]) & (part["line"][:, None] != asks["line"][None, :]))
                src.append(part["line"][i])
                dst.append(asks["line"][j])
                n += len(i)
                if n > PAIR_BLOCK:  # pairs go out as they come, so a task holds no more than these
                    yield told(np.concatenate(src), np.concatenate(dst))
                    src, dst, n = [], [], 0
        yield told(np.concatenate(src or [np.zeros(0, dtype=np.int64)]), np.concatenate(dst or [np.zeros(0, dtype=np.int64)]))

    return match


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("lines")
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            found = [lines_of(text) for text in part.column(2).to_pylist()]
            of = np.repeat(np.arange(part.num_rows), [len(x) for x in found])
            no = np.fromiter((k for x in found for k, _ in x), dtype=np.int64, count=len(of))
            line = np.fromiter((line_id(s) for x in found for _, s in x), dtype=np.int64, count=len(of))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), part.column(1).take(pa.array(of)), pa.array(no), pa.array(line)], ["doc_id", "text_key", "line_no", "line"])


def similar_lines(docs: DataFrame, text_col: str = "text", edits: int = EDITS, split: int = HOT_ENTRIES) -> DataFrame:
    """(a, b): ids of every two different lines within the edits that the shorter one's length allows, `edits` at most, a < b, as a table.

    A key that more than about `split` lines hold or probe for is cut into a grid of tasks, each with a part of its holders and a part of its probes.
    """
    spark = docs.sparkSession
    bits = (4 * shuffle_partitions(spark) - 1).bit_length()
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(frequent_keys(edits), "key long, held long, asks long").groupBy("key").agg(F.sum("held").alias("held"), F.sum("asks").alias("asks"))
    often = counts.where((F.col("held") > 0) & (F.col("asks") > 0) & ((F.col("held") + F.col("asks")) * HOT_EVERY > split))
    found = often.orderBy(F.desc(F.col("held") + F.col("asks")), "key").limit(HOT_KEYS).toPandas()
    keys = found["key"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    parts = lambda c: np.maximum(1, -(-found[c].to_numpy(dtype=np.int64) * HOT_EVERY // split))[order]
    hot = spark.sparkContext.broadcast((keys[order], parts("held"), parts("asks")))
    blocks = texts.mapInArrow(emit_keys(bits, edits, hot), "bucket long, i int, j int, block binary")
    pairs = cut(blocks.groupBy("bucket", "i", "j").applyInPandas(match_bucket(edits), "a long, b long").distinct(), "line-pairs")
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct(), "line-wanted")
    n = wanted.count()
    few = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in wanted.toLocalIterator()], dtype=np.int64))) if n <= BROADCAST_ROWS else None

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: dict[int, str] = {}
            for text in batch.column(0).to_pylist():
                out.update((h, s) for _, s in lines_of(text) if (h := line_id(s)) not in seen)
            ids = np.array(list(out), dtype=np.int64)
            if few is not None and len(ids) and len(few.value):
                at = np.minimum(np.searchsorted(few.value, ids), len(few.value) - 1)
                ids = ids[few.value[at] == ids]
            elif few is not None:
                ids = ids[:0]
            seen.update(ids.tolist())
            if len(seen) > SEEN_LINES:
                seen = set()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([out[h] for h in ids.tolist()], pa.string())], ["line", "s"])

    spelt = texts.mapInArrow(spelled, "line long, s string")
    spelt = spelt if few is not None else spelt.join(wanted, "line", "left_semi")
    spelt = cut(spelt.groupBy("line").agg(F.min("s").alias("s")), "line-texts")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([within(x, y, int(allowed(min(len(x), len(y)), edits))) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    both = pairs.join(spelt.select(F.col("line").alias("a"), F.col("s").alias("s_a")), "a").join(spelt.select(F.col("line").alias("b"), F.col("s").alias("s_b")), "b")
    return cut(both.select("a", "b", "s_a", "s_b").mapInArrow(near, "a long, b long"), "line-links")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, split: int = HOT_ENTRIES) -> DataFrame:
    """One row per line that is not blank: doc_id, text_key (a hash of the row's text), line_no (from 0), class_doc_id, class_line_no, n_same, n_links, kept.

    Lines are what stands between line feeds, without white space at the ends. Equal lines of any length, and lines that steps of at
    most `edits` edits join (one for EDIT_CHARS characters of the shorter line, so none for the shortest), are a class, named by its first line in order of doc_id, line_no and text_key; that
    one is kept. n_same counts the line's equal occurrences, n_links the different lines so joined to it. Null and empty texts have no lines; a text of any length is read whole.
    Rows that repeat an id and a text share one decision: both are kept, or neither is; rows that repeat an id alone are texts of their own. A null id comes first. An empty table gives no rows; other columns
    are not read. Lines are told apart by 64-bit digests.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    at = cut(rows.mapInArrow(occurrences, "doc_id long, text_key long, line_no long, line long"), "line-occurrences")
    links = similar_lines(docs, text_col, edits, split)
    of = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "line-classes").withColumnRenamed("id", "line")
    n_links = links.select(F.explode(F.array("a", "b")).alias("line")).groupBy("line").agg(F.count("*").alias("n_links"))
    of = cut(of.join(n_links, "line"), "line-linked")
    place = F.struct("doc_id", "line_no", "text_key")
    first = at.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n_same"))
    # only lines that repeat or have links need more than their own row says
    firsts = cut(join_sized(first, of, ["line"], "left").where("n_same > 1 OR component IS NOT NULL"), "line-firsts")
    heads = cut(firsts.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("head")), "line-class-heads")
    told = join_sized(firsts, heads, ["component"], "left", BROADCAST_ROWS // 2)
    told = cut(told.select("line", F.coalesce("head", "first").alias("head"), "n_same", F.coalesce("n_links", F.lit(0)).alias("n_links")), "line-heads")
    out = join_sized(at, told, ["line"], "left", BROADCAST_ROWS // 4)
    head = F.coalesce("head", place)
    return out.select(
        "doc_id", "text_key", "line_no", head["doc_id"].alias("class_doc_id"), head["line_no"].alias("class_line_no"),
        F.coalesce("n_same", F.lit(1)).cast("long").alias("n_same"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), place.eqNullSafe(head).alias("kept"),
    )


def drop_lines(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the lines that are not kept; a document that loses every line that has any words goes, as all it said is said before.

    Documents without such lines stay as they are, null and empty ones too. Rows are found by id and text, so rows that repeat an id alone lose their own lines only.
    All columns of docs stay, whatever their names. A text with any number of lines takes time in proportion to them.
    """
    g_id, g_key, g_lines = free_names(docs, "gone_id", "gone_key", "gone_lines")
    gone = classes.where("NOT kept").groupBy(F.col("doc_id").alias(g_id), F.col("text_key").alias(g_key)).agg(F.collect_set(F.col("line_no").cast("int")).alias(g_lines))
    here = F.col(id_col).cast("long").eqNullSafe(F.col(g_id)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(g_key))
    df = docs.join(gone, here, "left")
    lines = F.split(text_col, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), g_lines)
    left = F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")
    df = df.withColumn(text_col, F.when(F.col(g_lines).isNull(), F.col(text_col)).otherwise(left))
    return df.where(F.col(g_lines).isNull() | F.col(text_col).rlike(r"\S")).select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"))
