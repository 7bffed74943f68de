"""Dense vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a at length 1; a zero vector stays as it is. The length is taken once a row, not for each component."""
    n = norm(a)
    return F.when(n > 0, F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, m: x.cast("double") / m)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def padded(a: Column, size: int) -> Column:
    """Exactly `size` components: cut, or filled with zeros."""
    return F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), size)), 1, size)


_fold = "aggregate(zip_with({0}, {1}, (x, y) -> double(x) * double(y)), double(0), (s, x) -> s + x)"


def sql_of(name: str, a: str, b: str) -> str:
    """A vector function of two SQL expressions written out, which can stand anywhere, in ORDER BY too."""
    if name == "inner_product":
        return f"({_fold.format(a, b)})"
    if name == "l2_distance":
        return f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> pow(double(x) - double(y), 2)), double(0), (s, x) -> s + x))"
    return f"(1 - {_fold.format(a, b)} / nullif(sqrt({_fold.format(a, a)}) * sqrt({_fold.format(b, b)}), 0))"


def register_sql(spark: SparkSession) -> None:
    """SQL functions of vectors, for select lists and filters: inner_product, cosine_distance, l2_distance."""
    for name in ("inner_product", "cosine_distance", "l2_distance"):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {sql_of(name, 'a', 'b')}")
