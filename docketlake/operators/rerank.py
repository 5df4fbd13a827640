"""Reranking by the best passage of each candidate."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from docketlake.functions import text as T
from docketlake.operators import lexical

PASSAGES = 4


def _best_windows(windows: list[list[str]], asked: list[str], most: int) -> list[int]:
    """The places of the ``most`` windows (tokens of each) that BM25 among them ranks best for the query's tokens, ascending."""
    counts = [Counter(w) for w in windows]
    df = Counter(t for c in counts for t in c)
    n, average = len(windows), sum(map(len, windows)) / max(1, len(windows))
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    low = lexical.EPSILON * math.fsum(raw.values()) / max(1, len(raw))
    # windows without a term of the query score 0, which a negative one does not reach
    scores = [0.0] * n
    times = sorted((t, x) for t, x in Counter(asked).items() if t in df)
    for i, c in enumerate(counts):
        for t, x in times:
            if t in c:
                scores[i] += x * (low if raw[t] < 0 else raw[t]) * c[t] * (lexical.K1 + 1) / (c[t] + lexical.K1 * (1 - lexical.B + lexical.B * len(windows[i]) / average))
    return sorted(sorted(range(n), key=lambda i: (-round(scores[i], 6), i))[:most])


def _windows(candidates: DataFrame, size: int) -> DataFrame:
    """``candidates`` with ``_shown``, the windows of the text; a text without words is its own passage."""
    windows = T.word_windows("text", size)
    return candidates.withColumn("_shown", windows).withColumn("_shown", F.when(F.size("_shown") > 0, F.col("_shown")).otherwise(F.array(F.coalesce("text", F.lit("")))))


def _picked(candidates: DataFrame, size: int, most: int) -> DataFrame:
    """``candidates`` with ``picked`` (passage_no, passage) instead of the text; a row's windows are ranked where they are, without a shuffle."""

    many = F.size("_shown") > most
    # tokens only where there is a choice
    ranked = _windows(candidates, size).drop("text").withColumn("_tokens", F.when(many, F.transform("_shown", lambda w: T.search_tokens(w)))).withColumn("_asked", F.when(many, T.search_tokens("query")))
    kept = [c for c in ranked.columns if c not in ("_tokens", "_asked")]

    def placed(batches):
        for batch in batches:
            shown = pc.list_value_length(batch.column("_shown")).to_pylist()
            each = zip(shown, batch.column("_tokens").to_pylist(), batch.column("_asked").to_pylist())
            places = [list(range(n)) if tokens is None else _best_windows(tokens, asked or [], most) for n, tokens, asked in each]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(places, pa.list_(pa.int32()))], [*kept, "_places"])

    ranked = ranked.mapInArrow(placed, StructType([*(ranked.schema[c] for c in kept), StructField("_places", ArrayType(IntegerType()))]))
    picked = F.transform("_places", lambda i: F.struct(i.alias("passage_no"), F.get("_shown", i).alias("passage")))
    return ranked.withColumn("picked", picked).drop("_shown", "_places")


def passages(candidates: DataFrame, size: int = T.PASSAGE_WORDS, most: int = PASSAGES) -> DataFrame:
    """(query_id, doc, passage_no, passage) of candidates (query_id, query, doc, text), in reading order.

    At most ``most`` of a candidate's windows: those that BM25, among the
    candidate's own windows, ranks best for the query. Where nothing can be
    ranked, the first ones. A text without words is its own passage.
    """
    picked = _picked(candidates.select("query_id", "query", "doc", "text"), size, most)
    return picked.select("query_id", "doc", F.explode("picked").alias("x")).select("query_id", "doc", "x.passage_no", "x.passage")


def passage_counts(candidates: DataFrame, size: int = T.PASSAGE_WORDS, most: int = PASSAGES) -> DataFrame:
    """(query_id, doc, n_passages): how many passages of each candidate ``passages`` gives, which needs no ranking."""
    counted = _windows(candidates.select("query_id", "doc", "text"), size).select("query_id", "doc", F.least(F.size("_shown"), F.lit(most)).cast("long").alias("n"))
    return counted.groupBy("query_id", "doc").agg(F.max("n").alias("n_passages"))


def rerank(candidates: DataFrame, provider, k: int | None = None, size: int = T.PASSAGE_WORDS, most: int = PASSAGES) -> DataFrame:
    """(query_id, doc, rerank_score, input_rank, rank) of candidates (query_id, query, doc, text, rank).

    ``provider.rerank(query, passages)`` is called once for each query, with
    the passages of all its candidates. The best passage's score counts; equal
    ones keep their order.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if provider is None:
        raise ValueError("reranking needs a provider")
    shown = _picked(candidates.select("query_id", "query", "doc", "text", F.col("rank").cast("int").alias("rank")), size, most)
    # a query's candidates are bounded by the retrieval that found them
    whole = shown.groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", "doc", "picked"))).alias("x"))
    whole = whole.select("query_id", "query", F.col("x.rank").alias("ranks"), F.col("x.doc").alias("docs"), F.transform("x", lambda c: F.transform(c["picked"], lambda p: p["passage"])).alias("passages"))
    kinds = [candidates.schema[c].dataType for c in ("query_id", "doc")]
    id_type, doc_type = map(to_arrow_type, kinds)

    def score(batches):
        for batch in batches:
            ids, docs, ranks, best = [], [], [], []
            for query_id, query, of, found, each in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4))):
                given = iter([float(x) for x in provider.rerank(query, [p for some in each for p in some])])
                ids += [query_id] * len(found)
                docs += found
                ranks += of
                best += [max(next(given) for _ in some) for some in each]
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(docs, doc_type), pa.array(ranks, pa.int32()), pa.array(best, pa.float64())], ["query_id", "doc", "rank", "score"])

    best = whole.mapInArrow(score, f"query_id {kinds[0].simpleString()}, doc {kinds[1].simpleString()}, rank int, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "input_rank")
    ranked = best.select("query_id", "doc", F.col("score").alias("rerank_score"), F.col("rank").alias("input_rank")).withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


class OverlapReranker:
    """Scores a passage by the share of the query's distinct words that it holds; needs no model."""

    def rerank(self, query: str, candidates: list[str]) -> list[float]:
        asked = set(query.lower().split())
        return [len(asked & set(c.lower().split())) / max(1, len(asked)) for c in candidates]
