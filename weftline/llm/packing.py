"""Packing documents into token sequences: cutting stock over the histogram of lengths, then ranked documents take the patterns' places."""

from __future__ import annotations

import itertools
import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, enter, ship, small_batches, table, worker_cache
from .cutting_stock import whole_patterns

ship(__name__)

SEQUENCE = 4096
END_ID = 2
#: Lengths count in units of so many tokens, so the linear program has at most SEQUENCE / UNIT rows.
UNIT = 8
#: Pieces are ranked in about so many parts inside their lengths, so that no task holds all pieces of a length and what is broadcast of the parts is bounded.
RANK_PARTS = 1 << 18
#: Beyond so many tokens between white space, or words, a Python worker forgets their ids.
CACHE_TOKENS = 250_000
#: The tokenizer file's own word pattern (a fixed value), for texts of Latin-1 characters; others go to the library whole.
_kind = {k: "".join(re.escape(chr(i)) for i in range(256) if unicodedata.category(chr(i))[0] == k) for k in "LN"}
_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_kind['L']}]+|[{_kind['N']}]|[^\s{_kind['L']}{_kind['N']}]+")
_plain = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*\Z")


class Known(dict):
    """Texts in the order in which they were first asked for, with the ids of each; those asked for whose ids are not put yet are in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.flat, self.begin = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 16, dtype=np.int64)
        self.n = 0

    def __missing__(self, text: str) -> int:
        self.new.append(text)
        self[text] = at = len(self)
        return at

    def at(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, texts), dtype=np.int64, count=len(texts))

    def put(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Ids of the next texts, one text's behind the other's, and where each text's end."""
        used = int(self.begin[self.n])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(ends) >= len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.flat[used : used + len(ids)] = ids
        self.begin[self.n + 1 : self.n + 1 + len(ends)] = used + ends
        self.n += len(ends)

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these texts one behind the other, and where each text's end."""
        first = self.begin[at]
        size = self.begin[at + 1] - first
        ends = np.cumsum(size)
        return self.flat[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)], ends


class Ids:
    """Token ids of texts, exactly those of the library, with the ids of what stands between white space kept from text to text.

    With literal, the names of special tokens in a text are text; without, as the library has it by default, they are those tokens.
    """

    def __init__(self, spec: str, literal: bool = True) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.encode_special_tokens = literal
        names = [t["content"].lower() for t in json.loads(spec).get("added_tokens") or [] if t["content"] and not (literal and t.get("special"))]
        self.names = re.compile("|".join(map(re.escape, names))) if names else None
        self.starts = "".join({n[0] for n in names})
        self.by_word = '"end_of_word_suffix":"</w>"' in spec.replace(" ", "") and "Lowercase" in spec
        # words that are split and lower-cased here need the model alone
        model = json.loads(spec) | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.bare = Tokenizer.from_str(json.dumps(model)) if self.by_word else self.whole
        # a word ends with an id whose token says so
        vocabulary = self.bare.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.tokens, self.words = Known(), Known()

    def spell(self) -> None:
        """Put the ids of the new words behind those of the others."""
        fresh, self.words.new = self.words.new, []
        for k in range(0, len(fresh), 512):
            part = fresh[k : k + 512]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            self.words.put(ids, np.flatnonzero(self.ends_word[ids]) + 1)

    def learn(self) -> None:
        """Put the ids of the new tokens behind those of the others."""
        split, self.tokens.new = [_words.findall(t) for t in self.tokens.new], []
        if len(self.words) > CACHE_TOKENS:
            self.words = Known()
        at = self.words.at(list(itertools.chain.from_iterable(split)))
        if self.words.new:
            self.spell()
        ids, ends = self.words.ids(at)
        self.tokens.put(ids, np.concatenate([[0], ends])[np.cumsum([len(w) for w in split])])

    def plain(self, text: str, low: str) -> bool:
        """Whether words of the text can be found here: Latin-1 characters only, and no name of an added token."""
        return bool(_plain.match(text)) and not (self.names and any(c in low for c in self.starts) and self.names.search(low))

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.tokens) > CACHE_TOKENS:
            self.tokens = Known()
        lower = [t.lower() for t in texts]
        places = [self.tokens.at(low.split()) if self.by_word and self.plain(t, low) else None for t, low in zip(texts, lower, strict=True)]
        if self.tokens.new:
            self.learn()
        for text, at in zip(texts, places, strict=True):
            yield self.tokens.ids(at)[0] if at is not None else np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cut_pieces(spec, end_id: int, sequence: int, with_ids: bool, literal: bool):
    def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("packing")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        kept = worker_cache()
        if kept.get("ids_literal") != literal or kept.get("ids_spec") is not spec.value and kept.get("ids_spec") != spec.value:
            kept["ids_spec"], kept["ids_literal"], kept["ids"] = spec.value, literal, Ids(spec.value, literal)
        ids = kept["ids"]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                of, start, length, crc, total, held = [], [], [], [], [], []
                for row, found in enumerate(ids.of([t or "" for t in part.column(1).to_pylist()])):
                    all_ids = np.concatenate([found, end]).astype("<u4", copy=False)
                    for a in range(0, len(all_ids), sequence):
                        piece = all_ids[a : a + sequence]
                        of.append(row)
                        start.append(a)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(len(all_ids))
                        if with_ids:
                            held.append(piece)
                numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *numbers, *([pa.array(held, pa.list_(pa.int64()))] if with_ids else [])], names)

    return cutting


def places(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each size in a pattern: size, first rank, items of it in a bin, bins, first sequence, first slot."""
    out, rank, sequence = [], {}, 0
    for pattern, bins in patterns:
        slot = 0
        for size, n in sorted(pattern.items(), reverse=True):
            out.append((size, rank.get(size, 0), n, bins, sequence, slot))
            rank[size] = rank.get(size, 0) + n * bins
            slot += n
        sequence += bins
    return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, sequence: int = SEQUENCE, with_ids: bool = False, literal: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document is its ids and end_id, so a null or empty text is one token; literal says whether the names of special tokens are text in it. It is cut only where it is longer than a
    sequence: whole sequences first, then the rest. Rests and whole pieces are counted by length in
    units; column generation finds patterns that fill sequences, and pieces, ranked inside their length, take the
    patterns' places. Rows that repeat an id are packed one by one; ids may be null; ties of length go by id and start. Texts of any length are tokenized whole. An empty table gives no rows; columns besides the two are not read.
    The driver holds the histogram (at most sequence / UNIT numbers) and the patterns (about as many).
    """
    spark = docs.sparkSession
    small_batches(spark)
    spec = spark.sparkContext.broadcast(Path(tokenizer_path).read_text())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<long>" if with_ids else "")
    pieces = cut(rows.mapInArrow(cut_pieces(spec, end_id, sequence, with_ids, literal), schema), "pieces")
    sized = pieces.withColumn("size", F.expr(f"int((length + {UNIT - 1}) DIV {UNIT})"))
    histogram = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count("*").alias("n")).collect()}
    found = places(whole_patterns(histogram, sequence // UNIT))
    if not found:
        return pieces.selectExpr("*", "bigint(0) as sequence_id", "bigint(0) as offset")
    held = spark.createDataFrame(found, "size int, first long, items int, bins long, first_sequence long, first_slot int")
    # one row for each length and part: sequence / UNIT + RANK_PARTS rows at most
    rows_each = max(256, -(-sum(histogram.values()) // RANK_PARTS))
    parts = spark.createDataFrame([(size, -(-n // rows_each)) for size, n in histogram.items()], "size int, parts long")
    sized = sized.join(F.broadcast(parts), "size").withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), "parts")).drop("parts")
    before = cut(sized.groupBy("size", "part").agg(F.count("*").alias("n")), "part-counts").selectExpr("size", "part", "sum(n) over (partition by size order by part) - n as before")
    ranked = sized.join(F.broadcast(before), ["size", "part"]).withColumn("rank", F.expr("before + row_number() over (partition by size, part order by doc_id, start) - 1"))
    put = ranked.join(F.broadcast(held), "size").where("rank >= first AND rank < first + items * bins")
    put = put.withColumn("sequence_id", F.expr("first_sequence + (rank - first) DIV items")).withColumn("slot", F.expr("first_slot + (rank - first) % items"))
    put = put.withColumn("offset", F.expr("sum(length) over (partition by sequence_id order by slot) - length"))
    return put.select(*pieces.columns, F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def tokenizer_file() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(), literal=False)
