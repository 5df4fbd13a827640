"""Measurements of an index: labelled queries made from it, kinds of search compared, and their cost."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from docketlake.functions import text as T
from docketlake.operators import evaluate
from docketlake.plans.index import DocumentIndex
from docketlake.session import checkpointed

#: Fixed value: the form of a chat provider's answer.
QUESTION_SCHEMA = {"type": "object", "properties": {"question": {"type": "string"}}, "required": ["question"], "additionalProperties": False}


def labelled_from(chunks: DataFrame, chat, per_file: int = 3, least_chars: int = 600, words: tuple[int, int] = (4, 40), shown: int = 3000) -> DataFrame:
    """(query_id, query, relevant_files, relevant_text): questions that a chat provider asks about some chunks of every file.

    Chunks are (file, doc_index, chunk_text). A question that fails, has too
    few or too many words, or is copied from its chunk is left out.
    """
    sampled = evaluate.stratified(chunks, per_file, least_chars)

    @F.pandas_udf("string")
    def asked(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                prompt = f"Write one question, in the language of the excerpt, that the excerpt answers.\n\nExcerpt:\n{text[:shown]}"
                return chat.complete_structured(prompt, QUESTION_SCHEMA)["question"].strip()
            except Exception:  # a question less
                return None

        return texts.map(one)

    # written once, as a provider may answer otherwise the next time
    made = checkpointed(sampled.withColumn("query", asked("chunk_text")))
    count = F.size(T.words("query"))
    good = made.where(F.col("query").isNotNull() & (count >= words[0]) & (count <= words[1]) & ~T.looks_copied("query", "chunk_text"))
    return good.select(F.col("doc_index").alias("query_id"), "query", F.array("file").alias("relevant_files"), T.middle_passage("chunk_text").alias("relevant_text"))


def _measured(index: DocumentIndex, labelled: DataFrame, document_type: str, strategies: list[str], k: int, variants: dict[tuple, dict], names: tuple[str, ...]) -> DataFrame:
    """A row for each strategy and variant, named by ``names``: the quality and the seconds that a query of the batch took."""
    labelled = checkpointed(labelled)
    count, made = max(1, labelled.count()), None
    for values, options in variants.items():
        for strategy in strategies:
            began = time.perf_counter()
            part = checkpointed(index.evaluate(labelled, document_type, [strategy], k, **options))
            part = part.withColumn("seconds_per_query", F.lit((time.perf_counter() - began) / count))
            for name, value in zip(names, values):
                part = part.withColumn(name, F.lit(value))
            made = part if made is None else made.unionByName(part)
    return made


def dense_and_hybrid(index: DocumentIndex, labelled: DataFrame, document_type: str, strategies: list[str], k: int = 5) -> DataFrame:
    """The quality of dense and of fused search in each strategy."""
    return _measured(index, labelled, document_type, strategies, k, {(mode,): {"use_hybrid": mode == "hybrid"} for mode in ("dense", "hybrid")}, ("mode",))


def with_and_without_rerank(index: DocumentIndex, labelled: DataFrame, document_type: str, strategies: list[str], k: int = 5) -> DataFrame:
    """The quality and the time of fused search with and without reranking."""
    return _measured(index, labelled, document_type, strategies, k, {(use,): {"use_hybrid": True, "use_rerank": use} for use in (False, True)}, ("rerank",))


def rerank_sweep(index: DocumentIndex, labelled: DataFrame, document_type: str, strategies: list[str], pools: tuple[int, ...] = (10, 20, 40), passages: tuple[int, ...] = (2, 4, 8), k: int = 5) -> DataFrame:
    """The quality and the time of reranking for numbers of candidates and of passages of each."""
    variants = {(pool, most): {"use_hybrid": True, "use_rerank": True, "pool": pool, "passages": most} for pool in pools for most in passages}
    return _measured(index, labelled, document_type, strategies, k, variants, ("pool", "passages"))


def cross_evaluated(indexes: dict[str, DocumentIndex], query_sets: dict[str, DataFrame], document_type: str, strategies: list[str], k: int = 5) -> DataFrame:
    """The quality of every index for every set of labelled queries, such as of texts read by different recognisers."""
    made = None
    for index_name, index in indexes.items():
        for set_name, labelled in query_sets.items():
            part = checkpointed(index.evaluate(labelled, document_type, strategies, k, use_hybrid=True))
            part = part.withColumn("index", F.lit(index_name)).withColumn("query_set", F.lit(set_name))
            made = part if made is None else made.unionByName(part)
    return made


def cross_table(crossed: DataFrame, value: str = "recall_at_k") -> DataFrame:
    """``cross_evaluated`` with a column for each set of queries."""
    return crossed.groupBy("index", "strategy").pivot("query_set").agg(F.first(value))


def seconds_per_query(search: Callable[[DataFrame], DataFrame], queries: DataFrame, most: int = 20) -> float:
    """The mean time of a search with one query, over at most ``most`` of them: a Spark job each."""
    rows = queries.limit(most).collect()
    began = time.perf_counter()
    for row in rows:
        search(queries.sparkSession.createDataFrame([row], queries.schema)).write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) / max(1, len(rows))
