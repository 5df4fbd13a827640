"""Vector functions as column expressions, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docketlake.functions.text import let


def _doubles(vector: Column | str) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    return column.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """The cosine of two vectors; 0 where one of them has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def unit(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays."""
    return let(F.greatest(norm(a), F.lit(1e-12)), lambda length: F.transform(_doubles(a), lambda x: x / length))


def mean_pool(rows: DataFrame, keys: list[str], vector: str, as_: str = "embedding") -> DataFrame:
    """For each key, the normalised mean of the normalised vectors.

    Adds up by position, so a key's vectors are never held together; hot keys
    are added up before they are shuffled.
    """
    each = rows.select(*keys, F.posexplode(unit(vector)).alias("_at", "_value"))
    means = each.groupBy(*keys, "_at").agg(F.avg("_value").alias("_mean"))
    pooled = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_mean"))).alias("_means"))
    return pooled.select(*keys, unit(F.transform("_means", lambda m: m["_mean"])).alias(as_))
