"""Reciprocal rank fusion of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RRF_K = 60


def pool_size(k: int, n_entries: int, asked: int | None = None) -> int:
    """How many candidates each ranking gives: the asked number or 4k, 50 at least, and no more than there are entries."""
    return min(asked or max(4 * k, 50), n_entries)


def fuse(dense: DataFrame, lexical: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, doc, rrf_score, dense_rank, bm25_rank, rank) of the ``k`` best by the sum of 1 / (rrf_k + rank).

    Input ranks count from 1, ``dense_rank`` and ``bm25_rank`` from 0; a
    document that one ranking lacks has a null there. Equal scores: by dense
    rank, then by lexical rank, those without last.
    """
    d = dense.select("query_id", "doc", (F.col("rank") - 1).cast("int").alias("dense_rank"))
    b = lexical.select("query_id", "doc", (F.col("rank") - 1).cast("int").alias("bm25_rank"))
    share = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(rrf_k + 1) + F.col(rank)), F.lit(0.0))
    both = d.join(b, ["query_id", "doc"], "full_outer").withColumn("rrf_score", F.round(share("dense_rank") + share("bm25_rank"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
