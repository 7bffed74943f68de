"""Whitening of embeddings: MLlib's singular value decomposition of exactly centred integer rows.

Sums are exact, so x less its mean is off by one rounding at most; the singular values s of the
centred rows give the eigenvalues s^2 / n of the covariance with divisor n. The total variance is not taken
from the spectrum but from the rows' exact squared deviations.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_names, table

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Up to so many dimensions the whole spectrum is computed at once, in double precision; beyond it the leading part by Arnoldi iteration.
WHOLE = 4096
#: Entries must be smaller than this to be long integers after scaling.
LARGEST = 2.0**52


def integer_rows(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, x): the rows whose vector can be scaled, as long integers."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < LARGEST))  # NaN is larger than any number
    x = F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return df.where((F.size(v) > 0) & whole).select(F.col(id_col).alias("id"), x.alias("x"))


def literal(values, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def deviation(x: Column, means: Column, rests: Column, n: int) -> Column:
    """Sum of (n x - S)^2 with S = n * mean + rest, as decimal(38,0); null beyond 38 digits."""
    count = F.lit(n).cast("decimal(18,0)")
    off = F.zip_with(F.zip_with(x, means, lambda a, m: (a - m).cast("decimal(19,0)") * count), rests, lambda a, r: F.try_subtract(a, r.cast("decimal(18,0)")))
    square = F.transform(off, lambda a: F.try_multiply(a, a).cast("decimal(38,0)"))
    return F.aggregate(square, F.lit(0).cast("decimal(38,0)"), lambda s, a: F.try_add(s, a).cast("decimal(38,0)"))


def whiten(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error), a row for each row of df that takes part and each component up to `components`.

    Vectors that are null or empty or hold a null, NaN, infinite or over-large (2^52) entry take no part, nor do those
    of another length than most have (of lengths equally frequent the longest counts). Null and repeated ids are rows of their own. Equal
    eigenvalues have the eigenvectors that the decomposition gives; directions without variance (singular values below 2 sqrt(d * 2.2e-16) of the largest) have no component, so a
    table of equal rows, or of one, gives no rows, and neither does an empty one. deviation is decimal(38,0). Other columns are not read.
    """
    spark = df.sparkSession
    name = free_names(df.select(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")
    rows = cut(integer_rows(df, id_col, vector), "integers")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d, n = (sizes["d"], sizes["n"]) if sizes else (1, 0)
    fit = rows.where(F.size("x") == d)
    sums = {r["pos"]: int(r["s"]) for r in fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("s")).collect()}
    means, rests = zip(*(divmod(sums.get(k, 0), max(n, 1)) for k in range(d)), strict=True)
    centred = F.zip_with(F.zip_with("x", literal(means, "long"), lambda a, m: (a - m).cast("double")), literal([r / max(n, 1) for r in rests], "double"), lambda a, r: a - r)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)

    values, directions = decompose(fit.select(centred.alias("c")), d, components if d > WHOLE else d) if n > 1 and any_variance(fit) else ([], np.zeros((d, 0)))
    values = [s * s / n for s in values[:components]]
    names = [f"w{k}" for k in range(len(values))]
    moved = fit.select("id", deviation(F.col("x"), literal(means, "long"), literal(rests, "long"), n).alias("deviation"), centred.alias("c"))
    axes = [literal([float(a) / math.sqrt(e) for a in directions[:, k]], "double") for k, e in enumerate(values)]
    square = F.coalesce(F.col("deviation").cast("double"), dot("c", "c") * float(n) * float(n))
    white = cut(moved.select("id", "deviation", square.alias("square"), *[dot("c", axis).alias(w) for w, axis in zip(names, axes, strict=True)]), "whitened")

    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    seen = white.agg(F.sum("square").alias("square"), *[F.covar_pop(a, b).alias(f"{a}_{b}") for a, b in pairs]).first()
    error = max((abs(seen[f"{a}_{b}"] - (a == b)) for a, b in pairs), default=0.0)
    trace = (seen["square"] or 0.0) / max(n, 1) ** 3
    part = [F.struct(F.lit(k + 1).alias("component"), F.col(w).alias("whitened"), F.lit(e / trace).alias("explained")) for k, (w, e) in enumerate(zip(names, values, strict=True))]
    if not part:
        part = [F.struct(F.lit(0).alias("component"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"))]
        white = white.limit(0)
    out = white.select("id", "deviation", F.inline(F.array(*part)))
    return out.select(
        F.col("id").alias(id_col), F.col("component").alias(name[0]), F.lit(n).cast("long").alias(name[1]), F.col("deviation").alias(name[2]),
        F.col("whitened").alias(name[3]), F.col("explained").alias(name[4]), F.lit(float(error)).alias(name[5]),
    )


def any_variance(fit: DataFrame) -> bool:
    """Whether two rows differ."""
    low, high = fit.agg(F.min("x"), F.max("x")).first()
    return low != high


def decompose(rows: DataFrame, d: int, k: int) -> tuple[list[float], np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of rows(c), without values that rounding can't tell from zero."""
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("c").alias("c")), "c"))
    svd = matrix.computeSVD(min(k, d), computeU=False, rCond=2 * math.sqrt(d * np.finfo(float).eps))
    return [float(s) for s in svd.s.toArray()], svd.V.toArray()


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is long as the contract has it, and null in rows where it passes 64 bits; deviation_exact holds it there too."""
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("deviation_exact", F.col("deviation")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
