"""Near-duplicate documents by min-max hashing, with links confirmed on full shingle sets.

Under each of PERMUTATIONS hash functions both the minimum and the maximum of a set are kept, so a
signature of 128 values costs 64 evaluations. Bands of 4 values name buckets. A pair at
similarity 0.75 shares none of the 32 bands with probability (1 - 0.75^4)^32, 5e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, enter, join_sized, ship, small_batches, table
from .exact_dedup import merge_runs
from .set_links import component_ids
from .shingles import STEP, U, WORDS, mix64, shingle_sets

ship(__name__)

PERMUTATIONS = 64
BAND_FUNCTIONS = 2  # each gives two values
PERCENT = 75
_rng = np.random.default_rng(11)
_mul = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
_add = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def bands_of(found: np.ndarray) -> np.ndarray:
    """The band hashes of a set of shingle hashes."""
    low, high = np.full(PERMUTATIONS, ~U(0)), np.zeros(PERMUTATIONS, dtype=np.uint64)
    for k in range(0, len(found), 4096):
        under = _mul[:, None] * found[None, k : k + 4096] + _add[:, None]
        np.minimum(low, under.min(axis=1), out=low)
        np.maximum(high, under.max(axis=1), out=high)
    both = np.stack([low, high], axis=1).reshape(-1, 2 * BAND_FUNCTIONS)
    name = np.arange(len(both), dtype=np.uint64)
    for k in range(both.shape[1]):
        name = mix64(name * U(STEP) + both[:, k])
    return name.view(np.int64)


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("shingles")
    for batch in batches:
        ids, n, key, bands, sizes = batch.column(0), [], [], [], [0]
        for found in shingle_sets(batch.column(1)):
            n.append(len(found))
            key.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            if len(found):
                bands.append(bands_of(found))
            sizes.append(sizes[-1] + (len(bands[-1]) if len(found) else 0))
        flat = np.concatenate(bands) if bands else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], ["id", "size", "key", "bands"])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    A-Z are lower-cased; words are what stands between ASCII white space; a set is the distinct
    5-word shingles, or the whole sequence of fewer words. Null, empty and blank texts have no set and link with
    nothing. Documents link when 100 * |A and B| >= percent * |A or B|, confirmed on full sets of 64-bit shingle hashes;
    component_id is the smallest doc_id that links reach. Rows that repeat an id are one vertex with all their links;
    a null id comes back as its own null component. An empty table gives no rows; other columns are not read.

    Documents with equal sets are one class (merged by a tree, so a class of any size is cheap); what the buckets hold is linked
    as set_links says, so near copies by the thousand never become pairs, and no candidate is left out.
    Long texts are hashed whole; ties don't arise, as every document has its own least id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(rows.mapInArrow(signatures, "id long, size long, key binary, bands array<long>"), "signatures")
    classes = cut(merge_runs(signed.where("key IS NOT NULL AND id IS NOT NULL"), largest=False).drop("key", "n"), "classes")
    reps = classes.where("id = win")
    found = component_ids(rows, reps.select("id", F.explode("bands").alias("bucket")), reps.select("id", "size").distinct(), percent, WORDS)
    out = join_sized(classes.select("id", "size", "win"), found.select(F.col("id").alias("win"), "component"), ["win"], "left")
    out = out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component", "win").alias("component_id"))
    alone = signed.where("key IS NULL OR id IS NULL").select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
