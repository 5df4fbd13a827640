"""More vectors like given ones, for measurements at sizes that no corpus at hand has."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from docketlake.operators import dense
from docketlake.session import checkpointed


def neighbours(seeds: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, partner, place, distance): the ``k`` nearest other seeds of each, with their distance, not squared."""
    asked = seeds.select(F.col(key).alias("query_id"), F.col(vector).alias("query_vector"))
    near = dense.exact(seeds, asked, k + 1, key, vector).where("query_id <> doc")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return near.select(F.col("query_id").alias(key), F.col("doc").alias("partner"), place.alias("place"), F.sqrt("distance").alias("distance")).where(F.col("place") <= k)


def mean_distance(near: DataFrame) -> DataFrame:
    """One row: mean_nn_distance of ``neighbours``."""
    return near.agg(F.round(F.avg("distance"), 6).alias("mean_nn_distance"))


def synthesize(seeds: DataFrame, n: int, noise: float = 0.5, k: int = 5, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(number, embedding): the seeds and new vectors, ``n`` together, each of them of length 1 if it is new.

    A new vector lies between a seed and one of its ``k`` nearest, at a random
    place, with noise of ``noise`` times the mean distance of neighbours. Every
    draw follows from the number of the vector and ``seed`` alone.
    """
    seeds = checkpointed(seeds.where(F.col(vector).isNotNull()).select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding")))
    count = seeds.count()
    if n <= count or not count:
        return seeds.orderBy("vec_id").limit(n).select("vec_id", "embedding").withColumnRenamed("vec_id", "number")
    near = checkpointed(neighbours(seeds, k))
    # rounded, as a sum depends on the order of its parts
    mean, dim = round(near.agg(F.avg("distance")).first()[0] or 0.0, 9), seeds.select(F.size("embedding")).first()[0]
    sigma = noise * mean / np.sqrt(dim)
    draw = lambda salt, below: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "number"), F.lit(below))
    last = seeds.agg(F.max("vec_id")).first()[0]
    # seeds by their place among all, so that a draw can name one
    placed = seeds.withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int"))
    sizes = {r["slot"]: r["count"] for r in placed.groupBy("slot").count().collect()}
    begins, total = {}, 0
    for slot in range(64):
        begins[slot] = total
        total += sizes.get(slot, 0)
    begin = F.element_at(F.array(*(F.lit(begins[slot]) for slot in range(64))), F.col("slot") + 1)
    placed = placed.withColumn("at", begin + F.row_number().over(Window.partitionBy("slot").orderBy("vec_id")) - 1).select("at", "vec_id", "embedding")
    new = seeds.sparkSession.range(last + 1, last + 1 + n - count).withColumnRenamed("id", "number")
    new = new.select("number", draw("seed", count).alias("at"), (draw("partner", k) + 1).cast("int").alias("place"), (draw("alpha", 1 << 30) / F.lit(1 << 30)).alias("alpha"))
    pairs = new.join(placed, "at").join(near, ["vec_id", "place"], "left")
    other = seeds.select(F.col("vec_id").alias("partner"), F.col("embedding").alias("other"))
    mixed = pairs.join(other, "partner", "left").select(
        "number", F.zip_with("embedding", F.coalesce("other", "embedding"), lambda a, b: (1 - F.col("alpha")) * a + F.col("alpha") * b).alias("v")
    )

    @F.pandas_udf("array<double>")
    def shaken(numbers: pd.Series, vectors: pd.Series) -> pd.Series:
        made = (np.asarray(v) + np.random.default_rng((seed, number)).normal(0.0, sigma, len(v)) for number, v in zip(numbers, vectors))
        return pd.Series([(v / max(np.linalg.norm(v), 1e-12)).tolist() for v in made])

    made = mixed.select("number", shaken("number", "v").alias("embedding"))
    return seeds.withColumnRenamed("vec_id", "number").unionByName(made)
