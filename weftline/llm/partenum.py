"""Exact Jaccard join of word n-gram sets by PartEnum signatures.

Sizes are cut into bands, so that sets alike enough lie in one band or in neighbours; a set signs for its own band and the next. Within a
band such sets differ in at most k features. The feature domain is cut into cells: with k + 1 + t of them at least t + 1 cells
agree whole, with k + 3 at least three. Signatures are projections on enumerated subsets of cells, so sets alike enough share one.
A cell that agrees may be empty in both; if all that agree are, then the sets share t + 1 empty cells, so they share EMPTY of their first
ones (all but the last t + 1 - EMPTY in the order of cells), and subsets of those are enumerated too.
As a pair of sizes a and b differs in at most h = (1 - j) / (1 + j) (a + b) features, all cells but h agree: a pair that shares
fewer signatures, empty cells allowed for, is dropped unseen.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, enter, join_sized, ship, small_batches, table, worker_cache
from .exact_dedup import merge_runs
from .set_links import component_ids
from .shingles import STEP, U, mix64, shingle_sets

ship(__name__)

WORDS, PERCENT = 4, 85
#: Below this a cell would hold few features, and nearly all sets some empty ones.
LEAST_PERCENT = 80
#: Up to so many differences all subsets of FEW_CELLS cells are enumerated; beyond, single cells with features, and subsets of EMPTY empty ones.
FEW, FEW_CELLS, EMPTY = 3, 3, 3


def band_starts(percent: int, largest: int = 1 << 40) -> list[int]:
    """The smallest size of each band; a band that starts at l ends at floor(100 l / percent)."""
    out = [1]
    while out[-1] < largest:
        out.append(100 * out[-1] // percent + 1)
    return out


def layout(band: int, percent: int):
    """For a band: the cells' edges in the domain of hashes, and the subsets to enumerate (None: single cells) or slack t; None if only equal sets link."""
    largest = band_starts(percent)[band + 1] - 1
    k = 2 * largest * (100 - percent) // (100 + percent)
    if k == 0:
        return None
    slack = 2 + k // 12
    cells = k + FEW_CELLS if k <= FEW else k + 1 + slack
    edges = np.array([(j << 64) // cells for j in range(1, cells)], dtype=np.uint64)
    salt = mix64(np.arange(1, cells + 1, dtype=np.uint64) * U(STEP) + U(band + 1))
    subsets = np.array(list(combinations(range(cells), FEW_CELLS))) if k <= FEW else None
    return edges, salt, subsets, slack


def signatures_of(found: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, list[int]]:
    """Signatures of a sorted set of hashes (cells are intervals of hashes, so each is a slice of the set); and its band, the cells of this band and the next (0 where subsets are enumerated) and its empty ones."""
    kept = worker_cache().setdefault(f"partenum_{percent}", {})
    if not kept:
        kept["starts"] = np.array(band_starts(percent))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix64(found + U(STEP)))])
    own = int(np.searchsorted(kept["starts"], len(found), side="right")) - 1
    out, shape = [], [own, 0, 0, 0]
    for band in (own, own + 1):
        if band not in kept:
            kept[band] = layout(band, percent)
        if not kept[band]:
            continue
        edges, salt, subsets, slack = kept[band]
        at = np.concatenate([[0], np.searchsorted(found, edges), [len(found)]])
        held = sums[at[1:]] - sums[at[:-1]]
        if subsets is not None:
            out.append(mix64(held[subsets].sum(axis=1) ^ mix64(salt[subsets].sum(axis=1))))
            continue
        empty = at[1:] == at[:-1]
        shape[1 + band - own] = len(empty)
        shape[3] += int(empty.sum())
        out.append(mix64(held[~empty] ^ salt[~empty]))
        if empty.sum() > slack:
            first = np.flatnonzero(empty)[: int(empty.sum()) - slack - 1 + EMPTY]
            some = np.array(list(combinations(first, EMPTY)))
            out.append(mix64(~salt[some].sum(axis=1)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64), shape


#: What pairs alike enough share at least: in one band two layouts, in neighbours one; nothing is known where subsets are enumerated.
ENOUGH = """CASE WHEN least(own_a, next_a, own_b, next_b) = 0 THEN true
    WHEN band_a = band_b THEN met >= own_a + next_a - 2 * floor({0} * (size_a + size_b) / {1}) - least(empty_a, empty_b)
    ELSE met >= if(band_a < band_b, own_b, own_a) - floor({0} * (size_a + size_b) / {1}) - least(empty_a, empty_b) END"""


SHAPE = ["band", "own", "next", "empty"]


def signed_rows(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("shingles")
        for batch in batches:
            size, key, signs, shapes, ends = [], [], [np.zeros(0, dtype=np.int64)], [], [0]
            for found in shingle_sets(batch.column(1), words):
                size.append(len(found))
                key.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                mine, shape = signatures_of(found, percent) if len(found) else (signs[0], [0, 0, 0, 0])
                signs.append(mine)
                shapes.append(shape)
                ends.append(ends[-1] + len(mine))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(signs)))
            shaped = [pa.array(c, pa.int32()) for c in np.array(shapes, dtype=np.int32).reshape(-1, 4).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), lists, *shaped], ["id", "size", "key", "signs", *SHAPE])

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A-Z are lower-cased; words are what stands between ASCII white space; a set is the distinct shingles of `words` words, or the whole
    sequence of fewer. Null, empty and blank texts have no set and link with nothing. Documents link when 100 * |A and B| >=
    percent * |A or B|, and component_id is the smallest doc_id that links reach. The join misses no link: sets are told apart
    by 64-bit hashes alone. Rows that repeat an id are one vertex with all their links; a null id comes back as its own null component; long texts are
    hashed whole; ties don't arise. An empty table gives no rows; other columns are not read.

    Documents with equal sets are one class first (merged by a tree), and only a class's smallest document signs. percent is 80 to 100.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent is {LEAST_PERCENT} to 100")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(rows.mapInArrow(signed_rows(words, percent), "id long, size long, key binary, signs array<long>, band int, own int, next int, empty int"), "signed")
    known = F.col("key").isNotNull() & F.col("id").isNotNull()
    classes = cut(merge_runs(signed.where(known).select("id", "size", "key", *SHAPE), largest=False).drop("n"), "classes")
    others = classes.where("id <> win").select("id", "key").distinct()
    named = join_sized(signed.where(known), cut(others, "others"), ["id", "key"], "left_anti").select("id", F.explode("signs").alias("bucket"))
    sizes = cut(classes.where("id = win").select("id", "size", *SHAPE).distinct(), "sizes")
    found = component_ids(rows, named, sizes, percent, words, ENOUGH.format(100 - percent, 100 + percent))
    out = join_sized(classes.select("id", "size", "win"), found.select(F.col("id").alias("win"), "component"), ["win"], "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component", "win").alias("component_id"))
    alone = signed.where(~known).select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(alone)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
