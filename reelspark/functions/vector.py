"""Vector expressions in double precision and checks of vector tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, accumulated in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def finite(v: Column) -> Column:
    """True if the array and all its numbers are neither null, NaN nor infinite."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(ok, F.lit(False))


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; a non-finite or all-zero vector is an error."""
    length = norm(v)
    good = finite(v) & (length > 0)
    return F.when(good, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.raise_error(F.lit("vector is not finite or has length 0")).cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def vector_report(df: DataFrame, vector: str, dim: int | None = None, tolerance: float = 1e-3) -> DataFrame:
    """One row: counts of vectors, dimensions, NaN, infinite and zero vectors, and the range of norms.

    Norms are taken over finite vectors only. Null vectors count in ``n_null``.
    """
    v = F.col(vector)
    has_nan = F.coalesce(F.exists(v, lambda x: F.isnan(x)), F.lit(False))
    has_inf = F.coalesce(F.exists(v, lambda x: F.abs(x) == float("inf")), F.lit(False))
    good = finite(v)
    length = F.when(good, norm(v))
    count = lambda c: F.count(F.when(c, 1))
    return df.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        count(v.isNull()).alias("n_null"),
        F.min(F.size(v)).alias("min_dim"),
        F.max(F.size(v)).alias("max_dim"),
        count(F.size(v) != dim).alias("n_wrong_dim") if dim else F.lit(0).cast("bigint").alias("n_wrong_dim"),
        count(has_nan).alias("n_nan"),
        count(has_inf).alias("n_inf"),
        count(length == 0).alias("n_zero"),
        F.min(length).alias("min_norm"),
        F.max(length).alias("max_norm"),
        F.coalesce(F.min(F.when(length > 0, F.abs(length - 1) < tolerance)), F.lit(False)).alias("normalized"),
    )
