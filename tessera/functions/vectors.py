"""Vector arithmetic on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v) -> Column:
    """Stored single-precision vectors are widened before any arithmetic."""
    return F.transform(v, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, z: s + z)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def _once(value, then) -> Column:
    """``then`` of a value that is worked out once for a row: inside a function of components it would be for each of them."""
    return F.transform(F.array(value), then)[0]


def normalised(v) -> Column:
    """Unit vector; a zero vector is an error."""
    over = lambda v, n: F.when(n == 0, F.raise_error(F.lit("zero vector has no direction"))).otherwise(F.transform(v, lambda x: x / n))
    return _once(v, lambda v: _once(norm(v), lambda n: over(v, n)))


def unit_checked(v, dim: int, tolerance: float = 1e-4) -> Column:
    """Guard for stored unit vectors: right length, norm 1 within tolerance, then exactly renormalised."""
    bad = lambda v: (F.size(v) != dim) | (F.abs(norm(v) - 1) > tolerance)
    return _once(v, lambda v: F.when(bad(v), F.raise_error(F.lit(f"not a unit vector of {dim} components"))).otherwise(normalised(v)))


def cosine(a, b) -> Column:
    """Total cosine: 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), n))


def centred(v, mu) -> Column:
    return F.zip_with(v, mu, lambda x, m: x - m)


def signed_load(rho: Column, pole: Column, positive: str = "male") -> Column:
    return F.when(pole == positive, rho).otherwise(-rho)


def mean_vector(rows: DataFrame, vec: str, *by: str) -> DataFrame:
    """Element-wise mean of a vector column per group, as column ``mean``. Sums combine before the shuffle."""
    flat = rows.select(*by, F.posexplode(vec).alias("pos", "x"))
    return flat.groupBy(*by, "pos").agg(F.avg("x").alias("x")).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))


def axis(rows: DataFrame, vec: str, pole: Column) -> DataFrame:
    """One row, column ``axis``: the unit vector from the mean of the rows where ``pole`` is false to that where it is true."""
    m = mean_vector(rows.select(F.col(vec).alias("v"), pole.alias("pole")).where("pole is not null"), "v", "pole")
    both = m.agg(F.max(F.when(F.col("pole"), F.col("mean"))).alias("a"), F.max(F.when(~F.col("pole"), F.col("mean"))).alias("b"))
    return both.select(normalised(centred(F.col("a"), F.col("b"))).alias("axis"))
