"""Phrase collocations: count tries of a shard's n-grams, serialised in the order of their paths, merged range by range.

Tries have depth 4 and are counted in three passes, as every part of a phrase is at least as frequent as the phrase: words; then, to know what can be frequent, pairs of
frequent words by 40 bits of their hashes; then all paths of two words and more along such pairs. What is frequent is told to tasks by a bitmap of bounded size, which like
the short hashes may let others through and so only saves work. A shard's trie goes out in blobs, one for each range of prefixes. A path's prefix is its language
and up to three words; ranges cut the hashes of prefixes, so no frequent word or pair gathers in one of them, and paths are sorted by hash. Merging a
range gives the counts of words with their spellings, of pairs, of quadruples, and of triples as sums over their children; what is
rarer than the least count goes there. In the merged trie a node's parent gives its left parts and its suffix link its right parts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, enter, join_sized, shuffle_partitions, ship, small_batches, table
from .shingles import CHUNK, STEP, U, mix64, texts_of, word_hashes

ship(__name__)

DEPTH = 4
LEAST, SCALE, INSIDE, TOP = 30, 2_000_000, 80, 2000
#: Words of a shard's trie, and bytes of text whose paths make one range.
SHARD_WORDS, RANGE_BYTES = 1 << 20, 8 << 20
#: Paths that a merge holds before it adds up equal ones.
MERGE_PATHS = 1 << 20
#: Bits of a bitmap of frequent words or pairs for each of them, and at most.
BITS, MOST_BITS = 16, 1 << 27
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ends_word = np.zeros(256, dtype=bool)
_ends_piece = np.zeros(256, dtype=bool)
_ends_piece[[ord(c) for c in ".,;:!?\x0a\x0b\x0c\x0d"]] = True
_ends_word[[0x20, 0x09]] = True
_ends_word |= _ends_piece
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
PATH = ["lang_id", "w1", "w2", "w3", "w4"]


def hash_of(text: str) -> np.uint64:
    """The hash of a label, told apart from words by a tab, which no word holds."""
    data = np.frombuffer(f"\t{text}".encode(), dtype=np.uint8)
    return word_hashes(data, np.zeros(1, dtype=np.int64), np.zeros(256, dtype=bool))[0][0]


class Shard:
    """The words of some texts: hashes, where each word's text and piece change, and one spelling of each."""

    def __init__(self) -> None:
        self.words, self.langs, self.firsts, self.places, self.data, self.n = [], [], [], [], [], 0
        self.breaks, self.last = 0, -1

    def add(self, langs: list, column: pa.Array) -> None:
        ids = np.array([hash_of(lang) for lang in langs], dtype=np.uint64)
        for row, _, data, offsets in texts_of(column):
            starts, a = offsets[:-1], 0
            while a < len(data):  # a long text in parts that end with a word
                z = min(len(data), a + 2 * CHUNK) if len(starts) == 1 else len(data)
                while z < len(data) and not _ends_word[data[z]]:
                    ahead = np.flatnonzero(_ends_word[data[z : z + CHUNK]])
                    z = z + int(ahead[0]) if len(ahead) else min(len(data), z + CHUNK)
                self.add_bytes(_lower[data[a:z]], starts if a == 0 else np.zeros(1, dtype=np.int64), ids[row:])
                a = z
            self.breaks += 1

    def add_bytes(self, data: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        found, at = word_hashes(data, starts, _ends_word)
        row_of = np.searchsorted(starts, at, side="right") - 1
        ends = np.cumsum(_ends_piece[data])
        breaks = self.breaks + ends[at] + row_of  # all only grow, so the sum changes where a text or a piece does
        self.breaks += int(ends[-1]) + len(starts) - 1
        if not len(found):
            return
        self.words.append(found)
        self.langs.append(ids[row_of])
        self.firsts.append(breaks != np.concatenate([[self.last], breaks[:-1]]))
        self.last, self.n = int(breaks[-1]), self.n + len(found)
        self.places.append(at + sum(map(len, self.data)))
        self.data.append(data)

    def spellings(self, rows: np.ndarray) -> list[bytes]:
        """What stands at these words."""
        data, at = np.concatenate(self.data), np.concatenate(self.places)[rows]
        starts = np.concatenate(self.places)
        ends = np.flatnonzero(_ends_word[data])
        stop = np.append(ends, len(data))[np.searchsorted(ends, at)]
        after = np.append(starts, len(data))[np.searchsorted(starts, at, side="right")]  # a text can end without a separator
        raw = data.tobytes()
        return [raw[a:z] for a, z in zip(at.tolist(), np.minimum(stop, after).tolist(), strict=True)]

    def trie(self, frequent: np.ndarray | None) -> Trie:
        """Words alone, or with a bitmap of pairs the paths of two words and more along them."""
        names, w, kinds, g, one, two, linked = self.hashed()
        if frequent is None:
            top, counts = counted(one)
            return Trie(kinds, names, self.spellings(top), one[top], g[top], w[top], counts, one[:0], np.zeros((5, 0), dtype=w.dtype), counts[:0])
        linked &= in_bitmap(pair_keys(two), frequent)
        pair, triple = np.flatnonzero(linked), np.flatnonzero(linked & ahead(linked, 1))
        third = np.concatenate([np.zeros(len(pair), dtype=w.dtype), ahead(w, 2)[triple]])
        fourth = np.concatenate([np.zeros(len(pair), dtype=w.dtype), np.where(ahead(linked, 2)[triple], ahead(w, 3)[triple], 0)])
        row = np.concatenate([pair, triple])
        prefix = mix64(two[row] * U(STEP) + names[third])
        at, counts = counted(mix64(prefix * U(STEP) + names[fourth]))
        row, none = row[at], np.zeros(0, dtype=np.int64)
        return Trie(kinds, names, [], one[:0], none, none, none, prefix[at], np.stack([g[row], w[row], ahead(w, 1)[row], third[at], fourth[at]]), counts)

    def hashed(self) -> tuple[np.ndarray, ...]:
        """Words (0: none) and the number of each place's, languages alike, hashes of words and of pairs in their language, and whether a pair stands in one piece."""
        word, lang, first = np.concatenate(self.words), np.concatenate(self.langs), np.concatenate(self.firsts)
        names, w = np.unique(word, return_inverse=True)
        kinds, g = np.unique(lang, return_inverse=True)
        names, w = np.concatenate([np.zeros(1, dtype=np.uint64), names]), w + 1
        one = mix64(kinds[g] * U(STEP) + word)
        linked = ~ahead(first, 1)
        linked[-1:] = False
        return names, w, kinds, g, one, mix64(one * U(STEP) + names[ahead(w, 1)]), linked

    def pairs(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of pairs of words in the bitmap, sorted, and their counts."""
        *_, one, two, linked = self.hashed()
        known = in_bitmap(one, frequent)
        keys = pair_keys(two[linked & known & ahead(known, 1)])
        at, counts = counted(keys)
        return keys[at], counts


def ahead(x: np.ndarray, k: int) -> np.ndarray:
    """What stands k places on, 0 beyond the end."""
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), dtype=x.dtype)])


def pair_keys(two: np.ndarray) -> np.ndarray:
    return mix64(two * U(STEP)) >> U(24)


class Trie(NamedTuple):
    """Labels (languages, words); level one (spelling, prefix hash, language, word, count); deeper paths (prefix hash, five labels, count), sorted by hash."""

    kinds: np.ndarray
    names: np.ndarray
    spelt: list[bytes]
    top: np.ndarray
    top_kind: np.ndarray
    top_name: np.ndarray
    top_counts: np.ndarray
    prefix: np.ndarray
    ids: np.ndarray
    counts: np.ndarray


def ordered(keys: np.ndarray) -> np.ndarray:
    """Places in the order of keys. Sorting high bits with places in the low ones is several times as fast as argsort; it is used unless two keys share their high bits."""
    bits = U(max(1, len(keys) - 1).bit_length())
    low = U((1 << int(bits)) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    held = keys[order]
    clash = (held[1:] & ~low == held[:-1] & ~low) & (held[1:] != held[:-1])
    return np.argsort(keys) if clash.any() else order


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in the order of keys, and how often it is there."""
    order = ordered(keys)
    held = keys[order]
    new = np.ones(len(held), dtype=bool)
    new[1:] = held[1:] != held[:-1]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(held)))


def in_bitmap(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set; bits: 64 to a number, a power of two of them in all."""
    at = keys & U(64 * len(bits) - 1)
    return (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) > 0


def range_of(prefix: np.ndarray, ranges: int) -> np.ndarray:
    return (((prefix >> U(32)) * U(ranges)) >> U(32)).astype(np.int64)


def in_ranges(prefix: np.ndarray, ranges: int) -> dict[int, np.ndarray]:
    """Places of each range, in their order."""
    at = range_of(prefix, ranges)
    order = np.argsort(at, kind="stable")
    here, first = np.unique(at[order], return_index=True)
    return dict(zip(here.tolist(), np.split(order, first[1:]), strict=True)) if len(here) else {}


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers one after the other, compressed."""
    body = b"".join(len(a).to_bytes(4, "little") + a.dtype.char.encode() + a.tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpacked(blob: bytes) -> list[np.ndarray]:
    body, at, out = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), 0, []
    while at < len(body):
        n, kind = int.from_bytes(body[at : at + 4], "little"), np.dtype(chr(body[at + 4]))
        out.append(np.frombuffer(body, dtype=kind, count=n, offset=at + 5))
        at += 5 + n * kind.itemsize
    return out


def thin(x: np.ndarray, kind: type = np.uint64) -> np.ndarray:
    """Bytes of whole numbers, those of one weight together, which compress better."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).ravel()


def thick(x: np.ndarray, kind: type = np.uint64) -> np.ndarray:
    return np.ascontiguousarray(x.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def serialised(kinds: np.ndarray, names: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Paths as indexes into the words that they hold, column by column."""
    used = np.zeros(len(names), dtype=bool)
    used[ids[1:]] = True
    place = np.cumsum(used) - 1
    return packed(kinds, names[used], *(thin(c, np.uint32) for c in (ids[0], *place[ids[1:]])), thin(counts))


def parsed(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(paths as five rows of labels, counts) of a blob."""
    kinds, names, lang, *words, counts = unpacked(blob)
    return np.stack([kinds[thick(lang, np.uint32)], *(names[thick(c, np.uint32)] for c in words)]), thick(counts).astype(np.int64)


def shards(ranges: int, pairs: bool = False, frequent=None):
    """The tries of a task's rows, or keys of their pairs, a row for each range that they reach; frequent: a broadcast bitmap."""

    def rows_of(shard: Shard, names: dict) -> Iterator[pa.RecordBatch]:
        if pairs:
            keys, counts = shard.pairs(frequent.value)
            ends = np.searchsorted(keys, [(r << 40) // ranges for r in range(1, ranges)])
            for r, (k, n) in enumerate(zip(np.split(keys, ends), np.split(counts, ends), strict=True)):
                if len(k):
                    blob = packed(thin(np.diff(k, prepend=U(0))), thin(n))
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([[]], pa.list_(pa.string())), pa.array([b""], pa.binary()), pa.array([blob], pa.binary())], ["range", "langs", "words", "paths"])
            return
        t = shard.trie(frequent.value if frequent else None)
        tops, deeper = in_ranges(t.top, ranges), in_ranges(t.prefix, ranges)
        for r in sorted({*tops, *deeper}):
            top, deep = tops.get(r, np.zeros(0, dtype=np.int64)), deeper.get(r, np.zeros(0, dtype=np.int64))
            said = b"\t".join([t.spelt[k] for k in top.tolist()])
            words = packed(t.top_kind[top].astype(np.uint32), t.names[t.top_name[top]], t.top_counts[top].astype(np.uint64), np.frombuffer(said, dtype=np.uint8))
            paths = serialised(t.kinds, t.names, t.ids[:, deep], t.counts[deep])
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([[names[int(h)] for h in t.kinds.tolist()]], pa.list_(pa.string())), pa.array([words], pa.binary()), pa.array([paths], pa.binary())], ["range", "langs", "words", "paths"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tries")
        shard, names = Shard(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names.update({int(hash_of(lang)): lang for lang in set(langs)})
            for a, z in slices(batch.column(1)):
                shard.add(langs[a:z], batch.column(1).slice(a, z - a))
                if shard.n >= SHARD_WORDS:
                    yield from rows_of(shard, names)
                    shard, names = Shard(), {int(hash_of(lang)): lang for lang in set(langs)}
        if shard.n:
            yield from rows_of(shard, names)

    return run


def slices(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes of text."""
    a, held = 0, 0
    for k, value in enumerate(column):
        held += len(value.as_buffer() or b"") if value.is_valid else 0
        if held >= size:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(column):
        yield a, len(column)


def prefixes(paths: np.ndarray) -> np.ndarray:
    """Hashes of languages and first three words, as a shard makes them."""
    h = mix64(paths[0] * U(STEP) + paths[1])
    for c in paths[2:4]:
        h = mix64(h * U(STEP) + c)
    return h


def added_up(paths: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of paths as one, sorted by keys: those of one key once, with the sum of their counts."""
    order = ordered(keys)
    held = keys[order]
    new = np.ones(len(held), dtype=bool)
    new[1:] = held[1:] != held[:-1]
    at = np.flatnonzero(new)
    return paths[:, order[at]], np.add.reduceat(counts[order], at) if len(at) else counts


class Range:
    """The blobs of one range as they come: words with their spellings, and runs of paths, which are merged whenever enough have come."""

    def __init__(self) -> None:
        self.words, self.runs, self.held = {}, [], 0

    def add(self, langs: list[str], words: bytes, paths: bytes) -> None:
        kind, name, n, said = unpacked(words)
        for k, h, c, word in zip(kind.tolist(), name.view(np.int64).tolist(), n.tolist(), said.tobytes().decode().split("\t") if len(kind) else [], strict=True):
            known = self.words.get((langs[k], h))
            self.words[langs[k], h] = (c + known[0], known[1]) if known else (c, word)
        self.runs.append(parsed(paths))
        self.held += len(self.runs[-1][1])
        if self.held > MERGE_PATHS and self.held > 2 * len(self.runs[0][1]):
            self.runs = [self.merged()]
            self.held = len(self.runs[0][1])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        paths, counts = np.concatenate([p for p, _ in self.runs], axis=1), np.concatenate([c for _, c in self.runs])
        return added_up(paths, counts, mix64(prefixes(paths) * U(STEP) + paths[4]))

    def rows(self, least: int) -> Iterator[pa.RecordBatch]:
        """Words and longer nodes with at least `least`, and of each language one row for all occurrences of rarer words, without a word."""
        rare = Counter()
        for (lang, _), (n, _) in self.words.items():
            rare[lang] += n if n < least else 0
        said = [w for w in self.words.items() if w[1][0] >= least] + [((lang, 0), (n, None)) for lang, n in rare.items() if n]
        for a in range(0, len(said), 10_000):
            part = said[a : a + 10_000]
            langs = [k[0] for k, _ in part]
            ids = {g: int(np.int64(hash_of(g).view(np.int64))) for g in set(langs)}
            zero = pa.array(np.zeros(len(part), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([v[1] for _, v in part], pa.string()), pa.array([ids[g] for g in langs], pa.int64()), pa.array([k[1] for k, _ in part], pa.int64()), *[zero] * 3, pa.array([v[0] for _, v in part], pa.int64())], ["lang", "word", *PATH, "f"])
        paths, counts = self.merged()
        deep = paths[3] > 0
        above = paths[:, deep].copy()
        above[4] = 0
        trios, sums = added_up(above, counts[deep], prefixes(above))  # a triple is the sum of its children, the absent fourth word among them
        whole = ~deep | (paths[4] > 0)
        paths, counts = np.concatenate([paths[:, whole], trios], axis=1), np.concatenate([counts[whole], sums])
        kept = np.flatnonzero(counts >= least)
        none = pa.nulls(len(kept), pa.string())
        yield pa.RecordBatch.from_arrays([none, none, *(pa.array(p[kept].view(np.int64)) for p in paths), pa.array(counts[kept])], ["lang", "word", *PATH, "f"])


def merged_pairs(least: int):
    """Keys of pairs that occur `least` times, where keys are equal together."""

    def frequent(runs: list) -> Iterator[pa.RecordBatch]:
        keys, counts = np.concatenate([k for k, _ in runs]), np.concatenate([n for _, n in runs])
        found, sums = added_up(keys[None], counts.astype(np.int64), keys)
        yield pa.RecordBatch.from_arrays([pa.array(found[0][sums >= least].view(np.int64))], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tries")
        at, runs = None, []
        for batch in batches:
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                if r != at and runs:
                    yield from frequent(runs)
                    runs = []
                at = r
                keys, counts = (thick(x) for x in unpacked(blob.as_py()))
                runs.append((np.cumsum(keys, dtype=np.uint64), counts))
        if runs:
            yield from frequent(runs)

    return run


def merged_ranges(least: int):
    """Words and nodes of each range; a partition holds whole ranges, sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("tries")
        at, held = None, Range()
        for batch in batches:
            for r, langs, words, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if r != at and at is not None:
                    yield from held.rows(least)
                    held = Range()
                at = r
                held.add(langs, words.as_py(), paths.as_py())
        if at is not None:
            yield from held.rows(least)

    return run


def count_tries(docs: DataFrame, lang_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(words(lang, lang_id, w1, word, f) with f >= least, and rows of w1 = 0 for all rarer ones; nodes(lang_id, w1..w4, f) of two words and more with f >= least)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    nodes = "lang string, word string, " + ", ".join(f"{c} long" for c in [*PATH, "f"])

    def met(merge, schema: str, name: str, pairs: bool = False, frequent: np.ndarray | None = None) -> DataFrame:
        tries = rows.mapInArrow(shards(ranges, pairs, None if frequent is None else spark.sparkContext.broadcast(frequent)), "range int, langs array<string>, words binary, paths binary")
        return cut(tries.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(merge, schema), name)

    words = met(merged_ranges(least), nodes, "words")
    pairs = met(merged_pairs(least), "key long", "pairs", True, bitmap(words.where("w1 <> 0").select("lang_id", "w1")))
    deep = met(merged_ranges(least), nodes, "nodes", False, bitmap(pairs))
    return words.select("lang", "lang_id", "w1", "word", "f"), deep.select(*PATH, "f")


def bitmap(nodes: DataFrame) -> np.ndarray:
    """Bits set for words (their language and hash) or pairs (their keys); at most MOST_BITS, however many there are."""
    n = 1 << max(6, min(MOST_BITS, BITS * nodes.count()).bit_length() - 1)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, *labels = (np.asarray(c).view(np.uint64) for c in batch.columns)
            for label in labels:
                at = mix64(at * U(STEP) + label)
            at = at & U(n - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> U(6)).astype(np.int64)), pa.array((U(1) << (at & U(63))).view(np.int64))], ["at", "bits"])

    found = nodes.mapInArrow(words, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n // 64, dtype=np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def parts_of(nodes: dict[int, DataFrame], m: int) -> DataFrame:
    """Phrases of m words with the counts l1.. of their first words (from the parent) and r1.. of the rest (from the suffix link)."""
    words = [f"w{k}" for k in range(1, m + 1)]
    # what a node inherits: its parent's count is that of its first m - 1 words, and the parent's own left parts are its first words
    parent = nodes[m - 1].select("lang_id", *words[:-1], *[F.col(f"l{k}") for k in range(1, m - 1)], F.col("f").alias(f"l{m - 1}"))
    suffix = nodes[m - 1].select("lang_id", *[F.col(f"w{k}").alias(f"w{k + 1}") for k in range(1, m)], *[F.col(f"r{k}").alias(f"r{k + 1}") for k in range(1, m - 1)], F.col("f").alias("r1"))
    return join_sized(join_sized(nodes[m], parent, ["lang_id", *words[:-1]], "inner"), suffix, ["lang_id", *words[1:]], "inner")


def lowest_cut(m: int, scale: int) -> Column:
    """Struct (score, k, l, r) of the cut with the lowest score, the smallest k of equal ones."""
    cuts = [F.struct(F.expr(f"CAST(f AS DECIMAL(19,0)) * {scale} DIV (CAST(l{k} AS DECIMAL(19,0)) + r{k})").cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, m)]
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, scale: int = SCALE, inside: int = INSIDE, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to 4 words of each language (all if None), best first.

    A-Z are lower-cased, texts are cut into pieces at . , ; : ! ? and line ends, pieces into words at spaces and tabs; other
    white space belongs to words. Null texts count as empty, a null language is `und`. Candidates have a = f(phrase) >= least; score is floor(scale * a / (l + r)) at the
    cut where it is lowest (of equal ones the first); a candidate whose words lie inside a longer one with 100 f(longer) >= inside * a goes.
    Ties go by a, falling, then by phrase in byte order. Long texts are read whole; repeated rows count each; an empty table gives no rows; other columns are not read.
    """
    words, deep = count_tries(docs, lang_col, text_col, least)
    nodes = {1: words.where("w1 <> 0").select("lang_id", "w1", "f")}
    level = {2: "w3 = 0", 3: "w3 <> 0 AND w4 = 0", 4: "w4 <> 0"}
    for m, which in level.items():
        nodes[m] = deep.where(which).select("lang_id", *[f"w{k}" for k in range(1, m + 1)], "f")
        nodes[m] = cut(parts_of(nodes, m), f"parts-{m}")
    key = lambda at: F.struct("lang_id", *[F.col(f"w{k}") if k else F.lit(0).cast("long") for k in [*at, 0, 0, 0, 0][:4]])
    spans = {3: ((1, 2), (2, 3)), 4: ((1, 2, 3), (2, 3, 4), (1, 2), (2, 3), (3, 4))}
    covered = reduce(DataFrame.unionByName, [nodes[m].select(F.explode(F.array(*[named(key(s)) for s in spans[m]])).alias("path"), "f") for m in spans])
    covered = covered.groupBy("path").agg(F.max("f").alias("longer"))
    found = reduce(DataFrame.unionByName, [nodes[m].select(named(key(range(1, m + 1))).alias("path"), F.col("f").alias("a"), lowest_cut(m, scale).alias("cut")) for m in level])
    kept = found.join(covered, "path", "left").where(F.col("longer").isNull() | (F.lit(100).cast("decimal(5,0)") * F.col("longer") < F.lit(inside).cast("decimal(5,0)") * F.col("a")))
    kept = kept.select(*[F.col("path")[c].alias(c) for c in PATH], "a", "cut")
    spelt = words.where("w1 <> 0").select("lang_id", "w1", "lang", "word")
    for k in range(1, DEPTH + 1):
        name = spelt.select("lang_id", F.col("w1").alias(f"w{k}"), F.col("word").alias(f"word{k}"), *(["lang"] if k == 1 else []))
        kept = join_sized(kept, name, ["lang_id", f"w{k}"], "inner" if k < 3 else "left")
    totals = words.groupBy("lang_id").agg(F.sum("f").alias("n"))
    kept = join_sized(kept, cut(totals, "totals"), ["lang_id"], "inner")
    out = kept.select("lang", "lang_id", F.concat_ws(" ", *[f"word{k}" for k in range(1, DEPTH + 1)]).alias("phrase"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:  # first in each of many parts of a language, then among those
        dealt = out.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession))))
        out = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang_id", "part").orderBy(*order))).where(F.col("rank") <= top)
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("lang_id").orderBy(*order)).cast("long"))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def named(path: Column) -> Column:
    return path.cast("struct<" + ",".join(f"{c}:bigint" for c in PATH) + ">")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = {
    "op13_collocations": f"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
        grams AS (SELECT lang, w[i : i + m - 1] AS g FROM starts, range(1, 5) AS sizes(m) WHERE i + m - 1 <= len(w)),
        f AS (SELECT lang, g, count(*) AS f FROM grams GROUP BY ALL),
        totals AS (SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
        cands AS (SELECT lang, g, f AS a FROM f WHERE len(g) >= 2 AND f >= {LEAST}),
        cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM cands),
        scored AS (
          SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, (c.a::HUGEINT * {SCALE}) // (x.f + y.f) AS score
          FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1 : len(c.g)]),
        low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        inner_parts AS (SELECT DISTINCT c.lang, c.a AS longer, c.g[i : j] AS g FROM cands c, range(1, 4) AS s(i), range(2, 5) AS e(j) WHERE j > i AND j <= len(c.g) AND j - i + 1 < len(c.g)),
        kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM inner_parts p WHERE p.lang = low.lang AND p.g = low.g AND 100::HUGEINT * p.longer >= {INSIDE}::HUGEINT * low.a)),
        ranked AS (
          SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM kept
          QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) <= {TOP})
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
        FROM ranked JOIN totals USING (lang)
    """
}
