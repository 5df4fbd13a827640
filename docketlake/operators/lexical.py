"""Okapi BM25 over tokenised texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from docketlake.functions import text as T
from docketlake.operators import blocks
from docketlake.session import checkpointed

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms of queries that one task holds, occurrences of them in texts that it scores at a time, and results that it gives at a time.
QUERY_TERMS, SCORES, GIVEN = 1_000_000, 8_000_000, 200_000
#: Texts that a task scores, where there are more tasks than cores.
TASK_TEXTS = 100_000
#: Between terms of a stored text; white space, so that no token has it.
BETWEEN = "\x1f"


@dataclass(frozen=True)
class Bm25Index:
    """Tokenised texts (doc, tokens) and term statistics (term, df, idf) of a corpus.

    ``corpus`` has one row: n_docs and avg_len. All three stay distributed.
    """

    texts: DataFrame
    terms: DataFrame
    corpus: DataFrame


def frequencies(texts: DataFrame) -> DataFrame:
    """(term, df): in how many of the texts (doc, tokens) a term stands; added up in each task before it is shuffled."""
    return texts.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def build(entries: DataFrame, doc: str, text: str, tokens=T.search_tokens) -> Bm25Index:
    """The index of the texts (doc, text). A null or empty text is a document without terms."""
    # kept, as the statistics and every search read it
    # each as one string with the separator before every token, a third of an array's size
    stored = checkpointed(entries.select(F.col(doc).alias("doc"), F.coalesce(F.array_join(F.transform(tokens(text), lambda t: F.concat(F.lit(BETWEEN), t)), ""), F.lit("")).alias("x")))
    texts = stored.select("doc", F.slice(F.split("x", BETWEEN), 2, 2**31 - 1).alias("tokens"))
    corpus = texts.agg(F.count("*").alias("n_docs"), (F.coalesce(F.sum(F.size("tokens")), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_len"))
    raw = frequencies(texts).join(F.broadcast(corpus)).select("term", "df", (F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    # a negative weight becomes a share of the mean over the vocabulary
    mean = raw.agg(F.avg("raw").alias("mean_raw"))
    terms = raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(texts, terms, corpus)


def _postings(lines: np.ndarray, terms: np.ndarray, lengths: np.ndarray, n_terms: int, average: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each term the texts that have it, ascending, and its share of their scores; and where a term's begin."""
    pair, tf = np.unique(terms * len(lengths) + lines, return_counts=True)
    term, line = np.divmod(pair, len(lengths))
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[line] / average))
    return line, part, np.searchsorted(term, np.arange(n_terms + 1))


def _best(terms: list, weights: list, k: int, line: np.ndarray, part: np.ndarray, first: np.ndarray, most: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of the ``k`` best positive scores of one query, with all that equal the last of them, and the scores.

    Terms are taken by the most that they can add. Once the k-th best of what
    is added up exceeds what all the terms left can add, a text with none of
    the terms so far cannot be among the best, nor can one that falls short by
    more than that. ``score`` has a zero for each text, and has again at the end.
    """
    kept = [(t, w) for t, w in zip(terms, weights) if first[t] < first[t + 1]]
    tops = [w * most[t] for t, w in kept]
    by_top = sorted(range(len(kept)), key=lambda i: -tops[i])
    # a negative weight takes away: no bound then
    bounded, left = all(w > 0 for _, w in kept), sum(tops)
    seen, enough, added = [], 0.0, 0
    for i in by_top:
        t, w = kept[i]
        texts = line[first[t] : first[t + 1]]
        score[texts] += w * part[first[t] : first[t + 1]]
        seen.append(texts)
        left -= tops[i]
        added += 1
        if bounded and added < len(kept) and len(texts) >= k:
            now = score[texts]
            enough = max(enough, float(np.partition(now, len(now) - k)[len(now) - k]))
            if left < enough - 2e-6:
                break
    # each text once: what was read is zero for the terms after it
    values = []
    for texts in seen:
        values.append(score[texts])
        score[texts] = 0.0
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0)
    texts, value = np.concatenate(seen), np.concatenate(values)
    whole = added == len(kept)
    good = value != 0
    if len(value) > k:
        enough = float(np.partition(value, len(value) - k)[len(value) - k])
        good &= value >= enough - (0.0 if whole else max(0.0, left)) - 2e-6
    texts, value = texts[good], value[good]
    if not whole or len(kept) > 1:
        # again in the order of the terms, so that the sum does not depend on the bounds
        texts = np.sort(texts)
        value = np.zeros(len(texts))
        for t, w in kept:
            mine = line[first[t] : first[t + 1]]
            at = np.minimum(np.searchsorted(mine, texts), len(mine) - 1)
            value += np.where(mine[at] == texts, w * part[first[t] + at], 0.0)
    value = np.round(value, 6)
    good = np.flatnonzero(value > 0)
    if len(good) > k:
        good = good[value[good] >= np.partition(value[good], len(good) - k)[len(good) - k]]
    return texts[good], value[good]


def _scorer(k: int, average: float, doc_type: pa.DataType):
    """A kernel of ``blocks.meet``: the k best texts (doc, tokens) of each query (query_id, terms, weights), as lists."""

    def score(asked: pa.Table, batches):
        terms = asked.column("terms").combine_chunks()
        words = terms.flatten()
        vocabulary = pc.unique(words).sort()
        of = pc.index_in(words, value_set=vocabulary).to_pylist()
        weight = asked.column("weights").combine_chunks().flatten().to_pylist()
        starts = np.r_[0, np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))].tolist()
        numbers = asked.column("query_id").combine_chunks()

        def give(lines, found, names, lengths):
            n_texts = sum(map(len, lengths))
            line, part, first = _postings(np.concatenate(lines), np.concatenate(found), np.concatenate(lengths), len(vocabulary), average)
            most = np.maximum.reduceat(np.r_[part, 0.0], np.minimum(first[:-1], len(part))) if len(vocabulary) else part
            names, totals = np.concatenate(names), np.zeros(n_texts)
            held, rows, counts, given = [], [], [], 0
            for i in range(len(numbers)):
                texts, value = _best(of[starts[i] : starts[i + 1]], weight[starts[i] : starts[i + 1]], k, line, part, first, most, totals)
                if len(texts):
                    name = names[texts]
                    order = np.lexsort((name, -value))[:k]
                    held.append((-value[order], name[order]))
                    rows.append(i)
                    counts.append(len(order))
                    given += len(order)
                if held and (given >= GIVEN or i == len(numbers) - 1):
                    value, name = (np.concatenate(c) for c in zip(*held))
                    yield blocks.lists(numbers.take(pa.array(rows)), counts, [pa.array(value), pa.array(name.tolist(), doc_type)], ["value", "doc"])
                    held, rows, counts, given = [], [], [], 0
            if held:
                value, name = (np.concatenate(c) for c in zip(*held))
                yield blocks.lists(numbers.take(pa.array(rows)), counts, [pa.array(value), pa.array(name.tolist(), doc_type)], ["value", "doc"])

        lines, found, names, lengths, held, n = [], [], [], [], 0, 0
        for batch in batches:
            docs, tokens = batch.column(0), batch.column(1)
            if not len(docs):
                continue
            length = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
            at = pc.index_in(tokens.flatten(), value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
            lines.append(np.repeat(np.arange(n, n + len(docs)), length)[at >= 0])
            found.append(at[at >= 0].astype(np.int64))
            names.append(docs.to_numpy(zero_copy_only=False) if pa.types.is_integer(docs.type) else np.array(docs.to_pylist()))
            lengths.append(length)
            n, held = n + len(docs), held + len(found[-1])
            if held >= SCORES:
                yield from give(lines, found, names, lengths)
                lines, found, names, lengths, held, n = [], [], [], [], 0, 0
        if n:
            yield from give(lines, found, names, lengths)

    return score


def top(index: Bm25Index, queries: DataFrame, k: int, tokens=T.search_tokens) -> DataFrame:
    """(query_id, doc, score, rank): of the positive scores the ``k`` best; equal ones by the smaller document.

    A term that a query repeats counts as often. The texts are scored where
    they are, against all queries at once; a task keeps the k best of each
    query, so that only those are shuffled, however frequent a term is.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    asked = queries.where("query_id is not null").select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighted = asked.join(index.terms, "term").select("query_id", F.struct("term", (F.col("times") * F.col("idf")).alias("weight")).alias("x"))
    packed = weighted.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    once, asked = blocks.distinct(packed.select("query_id", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights")), ["terms", "weights"])
    count = once.agg(F.sum(F.size("terms"))).first()[0] or 0
    corpus = index.corpus.first()
    average = corpus["avg_len"] or 1.0
    doc_kind = index.texts.schema["doc"].dataType
    schema = f"query_id long, found array<struct<value:double,doc:{doc_kind.simpleString()}>>"
    # few tasks, as each gives k results of each query
    texts = index.texts.select("doc", "tokens").where("doc is not null").coalesce(max(queries.sparkSession.sparkContext.defaultParallelism, -(-corpus["n_docs"] // TASK_TEXTS)))
    found = blocks.meet(texts, once, -(-count // QUERY_TERMS), _scorer(k, average, to_arrow_type(doc_kind)), schema, "doc", 65_536)
    return blocks.merged(found, asked, k).select("query_id", "x.doc", (-F.col("x.value")).alias("score"), "rank")
