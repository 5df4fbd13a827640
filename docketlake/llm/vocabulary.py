"""Counts of the corpus's words, added up in each task before they are shuffled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Distinct words that a task holds before it hands its counts on.
MOST_HELD = 200_000


def counted(words_of: Callable[[str], Iterable[str]], batches):
    """Record batches (word, n) of all words of the first column's texts."""
    held: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(words_of(text))
        if len(held) > MOST_HELD:
            yield count_batch(held)
            held = Counter()
    yield count_batch(held)


def count_batch(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def word_counts(texts: DataFrame, column: str, pattern: str) -> DataFrame:
    """(word, n): how often each match of ``pattern`` occurs in the texts. Null texts have no words."""
    find = re.compile(pattern).findall
    parts = texts.where(F.col(column).isNotNull()).select(column).mapInArrow(lambda batches: counted(find, batches), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))
