"""Blocks of queries that meet all entries, with bounded memory in each task, and the best rows of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docketlake.session import checkpointed

Kernel = Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def meet(entries: DataFrame, queries: DataFrame, blocks: int, kernel: Kernel, schema: str, spread: str, group_rows: int) -> DataFrame:
    """What ``kernel`` makes of the queries and the entries; ``blocks`` is how many parts of the queries a task can hold one of.

    Queries of one block are broadcast, as their size is bounded by what a
    block may have; each task meets its entries as they come, without a
    shuffle. More queries are dealt into blocks, entries by a hash of
    ``spread`` into groups of about ``group_rows``, and each block meets each
    group in a task of its own: neither side is ever held whole.
    """
    if blocks <= 1:
        shared = queries.sparkSession.sparkContext.broadcast(queries.toArrow())
        return entries.mapInArrow(lambda batches: kernel(shared.value, batches), schema)
    groups = max(1, -(-entries.count() // group_rows))
    left = entries.withColumn("_group", F.pmod(F.xxhash64(spread), F.lit(groups))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    keep, asked = entries.columns, queries.columns

    def both(some: pa.Table, block: pa.Table) -> pa.Table:
        made = list(kernel(block.select(asked), iter(some.select(keep).to_batches())))
        return pa.Table.from_batches(made) if made else _none(schema)

    return left.groupBy("_block", "_group").cogroup(right.groupBy("_block", "_group")).applyInArrow(both, schema)


def _none(schema: str) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema)).empty_table()


def distinct(queries: DataFrame, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(query_id, *content) of the distinct contents under numbers of their own, and (query_id, _number) of all queries (query_id, *content)."""
    queries = checkpointed(queries)
    once = checkpointed(queries.select(*content).distinct().withColumn("_number", F.monotonically_increasing_id()))
    return once.select(F.col("_number").alias("query_id"), *content), queries.join(once, content).select("query_id", "_number")


def lists(numbers: pa.Array, counts: list[int], columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """(query_id, found) of rows that lie query by query, ``counts`` of each: one row and one list of structs for a query."""
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    return pa.RecordBatch.from_arrays([numbers, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names))], ["query_id", "found"])


def merged(found: DataFrame, asked: DataFrame, k: int, unique: bool = True) -> DataFrame:
    """(query_id, x, rank): the ``k`` least structs of what tasks found of the numbered contents, for all the queries that ask them.

    A query_id that stands in several rows of ``asked`` is ranked over all of them; ``unique`` says that none does.
    """
    whole = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    each = asked.join(whole.withColumnRenamed("query_id", "_number"), "_number").select("query_id", F.posexplode("found").alias("rank", "x")).withColumn("rank", F.col("rank") + 1)
    if unique:
        return each
    order = Window.partitionBy("query_id").orderBy("x")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Best:
    """For each of ``n`` queries its ``k`` rows of the smallest value; of equal ones those with the smaller name."""

    def __init__(self, n: int, k: int):
        self.k = k
        #: The value that a row has to reach; infinite until a query has ``k`` rows.
        self.limit = np.full(n, np.inf)
        self._held: list[tuple[np.ndarray, ...]] = []
        self._pending = self._kept = 0

    def add(self, rows: np.ndarray, values: np.ndarray, names: np.ndarray, *others: np.ndarray) -> None:
        """Rows of the queries ``rows``; ``others`` travel with them."""
        if not len(rows):
            return
        self._held.append((rows, values, names, *others))
        self._pending += len(rows)
        if self._pending > max(100_000, 2 * self._kept):
            self._compact()

    def settle(self) -> np.ndarray:
        """``limit`` after all rows so far."""
        if self._held:
            self._compact()
        return self.limit

    def _compact(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self._held)]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        columns = [c[order] for c in columns]
        rows = columns[0]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        last = place == self.k - 1
        self.limit[rows[last]] = columns[1][last]
        self._held = [tuple(c[place < self.k] for c in columns)]
        self._pending, self._kept = 0, len(self._held[0][0])

    def result(self) -> tuple[np.ndarray, ...] | None:
        """rows, values, names and the others, by query and value; none without any row."""
        if not self._held:
            return None
        self._compact()
        return self._held[0]


def kth_smallest(values: np.ndarray, k: int) -> np.ndarray:
    """Of each line the k-th smallest value; infinite where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), np.inf)
    return np.partition(values, k - 1, axis=1)[:, k - 1]
