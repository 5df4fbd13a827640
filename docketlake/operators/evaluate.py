"""Measuring retrieval: recall, reciprocal rank, passage recall and the size of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docketlake.functions import text as T


def per_query(results: DataFrame, labelled: DataFrame) -> DataFrame:
    """(query_id, first_rank, passage_hit) of results (query_id, rank, file, text) and labelled queries.

    ``labelled`` has query_id, relevant_files and relevant_text. ``first_rank``
    is the rank of the first result of a relevant file, ``passage_hit`` whether
    a result's text holds the passage, white space aside; null without passage.
    """
    asked = labelled.select("query_id", "relevant_files", T.squeeze("relevant_text").alias("passage"))
    found = asked.join(results.select("query_id", "rank", "file", T.squeeze("text").alias("text")), "query_id", "left")
    relevant = F.array_contains("relevant_files", F.col("file"))
    hit = F.max(F.when(F.col("passage") != "", F.coalesce(F.contains("text", "passage"), F.lit(False))).cast("int"))
    return found.groupBy("query_id").agg(F.min(F.when(relevant, F.col("rank"))).alias("first_rank"), hit.alias("passage_hit"))


def metrics(results: DataFrame, labelled: DataFrame) -> DataFrame:
    """One row: recall_at_k, mrr, passage_recall_at_k (null without passages), avg_result_chars and n_queries."""
    each = per_query(results, labelled).agg(
        F.round(F.coalesce(F.avg(F.col("first_rank").isNotNull().cast("int")), F.lit(0.0)), 6).alias("recall_at_k"),
        F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.avg("passage_hit"), 6).alias("passage_recall_at_k"),
        F.count("*").alias("n_queries"),
    )
    known = results.join(labelled.select("query_id").distinct(), "query_id", "left_semi")
    size = known.agg(F.round(F.coalesce(F.avg(F.length("text")), F.lit(0.0)), 6).alias("avg_result_chars"))
    return each.join(F.broadcast(size)).select("recall_at_k", "mrr", "passage_recall_at_k", "avg_result_chars", "n_queries")


def keyword_share(results: DataFrame, keywords: list[str]) -> DataFrame:
    """(query_id, keyword_share): the mean share of the keywords that stand in a result's text, case aside."""
    if not keywords:
        return results.groupBy("query_id").agg(F.lit(0.0).alias("keyword_share"))
    inside = sum((F.contains(F.lower("text"), F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    return results.groupBy("query_id").agg(F.round(F.avg(inside / len(keywords)), 6).alias("keyword_share"))


def file_diversity(results: DataFrame) -> DataFrame:
    """(query_id, diversity): distinct files by results."""
    return results.groupBy("query_id").agg(F.round(F.count_distinct("file") / F.count("*"), 6).alias("diversity"))


def heuristic(results: DataFrame, value: str, keywords: list[str], seconds: float, hybrid: bool = False) -> DataFrame:
    """(query_id, heuristic_score): time, closeness, steadiness, diversity and keywords by fixed weights.

    ``value`` is the distance, or the fused score of a hybrid search.
    """
    stats = results.groupBy("query_id").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"), (F.count_distinct("file") / F.count("*")).alias("diversity"))
    share = keyword_share(results, keywords).withColumnRenamed("keyword_share", "share")
    close = F.col("mean") if hybrid else 1 / (1 + F.col("mean"))
    score = 0.1 / (1 + 10 * seconds) + 0.3 * close + 0.1 / (1 + F.col("spread")) + 0.3 * F.col("diversity") + 0.2 * F.col("share")
    return stats.join(share, "query_id").select("query_id", F.round(score, 6).alias("heuristic_score"))


def result_summary(compared: DataFrame) -> DataFrame:
    """(query_id, strategy, n, avg_distance, std_distance, avg_rrf) of results with strategy, distance and rrf_score."""
    return compared.groupBy("query_id", "strategy").agg(
        F.count("*").alias("n"),
        F.round(F.avg("distance"), 6).alias("avg_distance"),
        F.round(F.stddev_pop("distance"), 6).alias("std_distance"),
        F.round(F.avg("rrf_score"), 6).alias("avg_rrf"),
    )


def stratified(chunks: DataFrame, per_file: int, least_chars: int = 600, file: str = "file", key: str = "doc_index", text: str = "chunk_text") -> DataFrame:
    """(file, key, text) of ``per_file`` chunks of every file, of those with at least ``least_chars``, in a fixed random order."""
    order = Window.partitionBy(file).orderBy(F.col(key) * 7919 % 104729, key)
    usable = chunks.where(F.length(text) >= least_chars).select(file, key, text)
    return usable.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_file).drop("_r")


def passage_hits(results: DataFrame, labelled: DataFrame) -> DataFrame:
    """(query_id, rank, contained): whether a result's text holds the query's passage, white space aside; for queries with one."""
    passages = labelled.select("query_id", T.squeeze("relevant_text").alias("passage")).where("passage <> ''")
    return passages.join(results.select("query_id", "rank", "text"), "query_id").select("query_id", "rank", F.coalesce(F.contains(T.squeeze("text"), F.col("passage")), F.lit(False)).alias("contained"))


def strategy_summary(scores: DataFrame) -> DataFrame:
    """(strategy, mean_score, std_score, n) of (strategy, heuristic_score)."""
    return scores.groupBy("strategy").agg(F.round(F.avg("heuristic_score"), 6).alias("mean_score"), F.round(F.stddev_pop("heuristic_score"), 6).alias("std_score"), F.count("*").alias("n"))


def recall_against(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: recall and top_1, the shares of the true neighbours (query_id, doc, rank) and first ones that were found."""
    met = truth.select("query_id", "doc", F.col("rank").alias("true_rank")).join(found.select("query_id", "doc", "rank"), ["query_id", "doc"], "left")
    first = F.avg(F.when(F.col("true_rank") == 1, (F.coalesce("rank", F.lit(0)) == 1).cast("int")))
    return met.agg(F.round(F.avg(F.col("rank").isNotNull().cast("int")), 6).alias("recall"), F.round(first, 6).alias("top_1"))
