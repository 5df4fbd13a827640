"""Nearest neighbours by squared distance, exact and in clusters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docketlake.functions import vectors as V
from docketlake.operators import blocks
from docketlake.session import checkpointed

#: Index kinds by size, and the fewest vectors that train them.
FLAT_UP_TO, IVF_FLAT_UP_TO = 100_000, 250_000
POINTS_PER_LIST, SQ8_LEAST = 30, 1000
#: Query vectors that one task holds, pairs that it multiplies at a time, and vectors of a block of a cluster, in elements.
QUERY_BLOCK, TILE, BLOCK_ELEMENTS = 4_000_000, 4_000_000, 524_288
#: Of an exact search, elements of entries that a task holds at a time, entries that lie together, and queries that look at them together, in few dimensions and in more than FEW.
HELD, LEAF, TOGETHER, FEW = 8_000_000, 128, (128, 1024), 16
#: The share of the true neighbours that a search by clusters or codes has to find, and the vectors it is measured with.
LEAST_RECALL, MEASURED_WITH = 0.9, 500


def choose_kind(n: int, asked: str = "auto", pq_bits: int = 8, thresholds: tuple[int, int] = (FLAT_UP_TO, IVF_FLAT_UP_TO)) -> str:
    """The kind of index for ``n`` vectors: flat, ivf_flat, ivf_sq8 or ivf_pq."""
    if asked not in ("auto", "flat", "ivf_flat", "ivf_sq8", "ivf_pq"):
        raise ValueError(f"unknown kind of index: {asked}")
    kind = asked
    if asked == "auto":
        kind = "flat" if n <= thresholds[0] else "ivf_flat" if n <= thresholds[1] else "ivf_sq8"
    if kind == "ivf_pq" and n < 2**pq_bits or kind == "ivf_sq8" and n < SQ8_LEAST:
        return "ivf_flat"
    return kind


def list_count(n: int, asked: int | None = None) -> int:
    """How many clusters ``n`` vectors get: the asked number or the root of n, with enough points for each."""
    return max(1, min(asked or max(1, math.isqrt(n)), max(1, n // POINTS_PER_LIST)))


def _ranked(found: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query_id, doc, distance, similarity, rank) of what tasks found, rounded."""
    rounded = found.select("query_id", "doc", F.round("distance", digits).alias("distance"), F.round("similarity", digits).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy("distance", "doc")
    return rounded.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(vectors: pa.Array | pa.ChunkedArray, dim: int, kind=np.float64) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind, copy=False)


def _names(docs: pa.Array) -> np.ndarray:
    return docs.to_numpy(zero_copy_only=False) if pa.types.is_integer(docs.type) else np.array(docs.to_pylist())


def _look(best: blocks.Best, q: np.ndarray, x: np.ndarray, names: np.ndarray, digits: int) -> None:
    """Offers the entries ``x`` to the queries ``q``, a bounded tile of pairs at a time.

    Single precision finds the pairs that could be among the best; their
    distances and cosines are then computed in double precision.
    """
    lines = max(16, TILE // max(1, len(x)))
    x32, halves = x.astype(np.float32), 0.5 * (x.astype(np.float64) ** 2).sum(1)
    lengths_x = np.sqrt(2 * halves)
    # the largest error of a product in single precision, as a share of the lengths
    error = 6e-8 * (x.shape[1] + 8)
    for top in range(0, len(q), lines):
        asked = q[top : top + lines]
        squares = (asked**2).sum(1)
        doubt = error * (halves + np.sqrt(squares.max()) * lengths_x)
        gain = asked.astype(np.float32) @ x32.T - (halves - doubt).astype(np.float32)
        limit = best.limit[top : top + lines].copy()
        least = 0.5 * (squares - limit)
        new = np.isinf(limit)
        if new.any():
            least[new] = -blocks.kth_smallest(2 * doubt[None, :] - gain[new], best.k)
        # what single precision cannot tell from the k-th best is computed exactly, as is what rounds to it
        least -= 10.0**-digits
        rows, columns = np.nonzero(gain >= least[:, None])
        for start in range(0, len(rows), 200_000):
            r, c = rows[start : start + 200_000], columns[start : start + 200_000]
            near = x[c].astype(np.float64)
            d = ((asked[r] - near) ** 2).sum(1)
            lengths = np.sqrt(squares[r] * (near**2).sum(1))
            s = np.divide(np.einsum("ij,ij->i", asked[r], near), lengths, out=np.zeros_like(d), where=lengths > 0)
            value = np.round(d, digits)
            good = value <= limit[r]
            best.add(top + r[good], value[good], names[c[good]], d[good], s[good])


def _leaves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the vectors in which near ones lie together, and where its leaves of at most ``size`` begin and end: halved by the widest dimension."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        part = todo.pop()
        if len(part) <= size:
            done.append(part)
            continue
        some = x[part]
        widest = int(np.argmax(some.max(0) - some.min(0)))
        half = len(part) // 2
        part = part[np.argpartition(some[:, widest], half)]
        todo += [part[half:], part[:half]]
    return np.concatenate(done), np.cumsum([0, *map(len, done)])


def _nearest(x: np.ndarray, names: np.ndarray, q: np.ndarray, k: int, digits: int):
    """(lines of ``q``, Best) by groups of near queries, over all entries ``x``.

    A group first looks at the nearest boxes of entries that hold enough, then
    at those that are no farther than the k-th best found there: the others
    cannot have an entry as near.
    """
    order, cuts = _leaves(x, LEAF)
    x, names = x[order], names[order]
    low, high = np.minimum.reduceat(x, cuts[:-1]).astype(np.float64), np.maximum.reduceat(x, cuts[:-1]).astype(np.float64)
    sizes = np.diff(cuts)
    lines, parts = _leaves(q, TOGETHER[x.shape[1] > FEW])
    for a, b in zip(parts[:-1], parts[1:]):
        mine = lines[a:b]
        asked, best = q[mine], blocks.Best(b - a, k)
        gap = (np.maximum(0.0, np.maximum(low - asked.max(0), asked.min(0) - high)) ** 2).sum(1)
        near = np.argsort(gap, kind="stable")
        first = int(np.searchsorted(np.cumsum(sizes[near]), max(2 * k, 8 * LEAF))) + 1
        _offer(best, asked, x, names, np.sort(near[:first]), cuts, digits)
        # rounding moves a distance by half a unit of the last digit at most
        reach = best.settle().max() * (1 + 1e-9) + 10.0**-digits
        rest = near[first:]
        _offer(best, asked, x, names, np.sort(rest[gap[rest] <= reach]), cuts, digits)
        yield mine, best


def _offer(best: blocks.Best, asked: np.ndarray, x: np.ndarray, names: np.ndarray, leaves: np.ndarray, cuts: np.ndarray, digits: int) -> None:
    """``_look`` at the entries of some leaves, a bounded number at a time."""
    step = max(1, TILE // (16 * LEAF))
    for start in range(0, len(leaves), step):
        some = leaves[start : start + step]
        rows = np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in some])
        _look(best, asked, x[rows], names[rows], digits)


def _found(best: blocks.Best, ids: pa.Array, doc_type: pa.DataType):
    """The best rows as a batch (query_id, doc, distance, similarity)."""
    found = best.result()
    if found:
        columns = [ids.take(pa.array(found[0])), pa.array(found[2].tolist(), doc_type), pa.array(found[3]), pa.array(found[4])]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc", "distance", "similarity"])


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def exact(entries: DataFrame, queries: DataFrame, k: int, doc: str = "doc", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """(query_id, doc, distance, similarity, rank): the ``k`` nearest entries of each query (query_id, query_vector).

    A task keeps the k best entries of each query of a block over all the
    entries it sees, so that only those are shuffled. Distances are squared
    and rounded to ``digits``; equal ones are ordered by the smaller document.
    Entries and queries without vectors, or of another dimension than the
    longest query's, are left out.
    """
    asked = queries.where("query_id is not null and query_vector is not null").select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    asked = checkpointed(asked)
    dim, rows, ids = asked.agg(F.max(F.size("query_vector")), F.count("*"), F.count_distinct("query_id")).first()
    dim = dim or 1
    once, asked = blocks.distinct(asked.where(F.size("query_vector") == dim), ["query_vector"])
    count = once.count()
    usable = entries.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(vector).cast("array<float>").alias("v"))
    doc_kind = usable.schema["doc"].dataType
    doc_type = to_arrow_type(doc_kind)

    def look(table: pa.Table, q: np.ndarray, x: list, names: list):
        numbers = _column(table, "query_id")
        for mine, best in _nearest(np.concatenate(x), np.concatenate(names), q, k, digits):
            found = best.result()
            if found:
                lines, counts = np.unique(found[0], return_counts=True)
                columns = [pa.array(found[3]), pa.array(found[2].tolist(), doc_type), pa.array(found[4])]
                yield blocks.lists(numbers.take(pa.array(mine[lines])), counts, columns, ["distance", "doc", "similarity"])

    def near(table: pa.Table, batches):
        q, x, names, held = _matrix(table.column("query_vector"), dim), [], [], 0
        if not len(q):
            return
        for batch in batches:
            # here, as a filter of the plan would compute the vectors twice
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False))
            if batch.num_rows:
                x.append(_matrix(batch.column(1), dim, np.float32).copy())
                names.append(_names(batch.column(0)).copy())
                held += batch.num_rows * dim
            if held >= HELD:
                yield from look(table, q, x, names)
                x, names, held = [], [], 0
        if x:
            yield from look(table, q, x, names)

    schema = f"query_id long, found array<struct<distance:double,doc:{doc_kind.simpleString()},similarity:double>>"
    parts = max(-(-count * dim // QUERY_BLOCK), -(-count * k // (4 * QUERY_BLOCK)))
    found = blocks.meet(usable, once, parts, near, schema, "doc", max(1024, QUERY_BLOCK // dim))
    rounded = F.transform("found", lambda x: F.struct(F.round(x["distance"], digits).alias("distance"), x["doc"].alias("doc"), x["similarity"].alias("similarity")))
    best = blocks.merged(found.withColumn("found", rounded), asked, k, ids == rows)
    return best.select("query_id", "x.doc", "x.distance", F.round("x.similarity", digits).alias("similarity"), "rank")


def distance_stats(hits: DataFrame) -> DataFrame:
    """(query_id, avg_distance, std_distance, n) of the returned distances."""
    return hits.groupBy("query_id").agg(
        F.round(F.avg("distance"), 6).alias("avg_distance"), F.round(F.stddev_pop("distance"), 6).alias("std_distance"), F.count("*").alias("n")
    )


def train_clusters(entries: DataFrame, vector: str, lists: int, seed: int = 7, sample: int = 200_000) -> list[list[float]]:
    """Cluster centres of at most ``sample`` vectors by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = entries.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    n = usable.count()
    if n > sample:
        usable = usable.sample(fraction=min(1.0, 1.1 * sample / n), seed=seed).limit(sample)
    drawn = checkpointed(usable.select(array_to_vector("v").alias("features")))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(drawn)
    return [[float(x) for x in centre] for centre in model.clusterCenters()]


def _ranked_clusters(rows: DataFrame, vector: str, centres: list[list[float]], probes: int, as_: str) -> DataFrame:
    """``rows`` with the ids of the nearest ``probes`` clusters, nearest first; the centres are few and travel as a broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(centres, np.float64))
    probes = min(probes, len(centres))

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        c = shared.value
        x = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
        gain = x @ c.T - 0.5 * (c**2).sum(1)
        return pd.Series(list(np.argsort(-gain, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return rows.withColumn(as_, nearest(F.col(vector)))


@dataclass(frozen=True)
class Cells:
    """An inverted file: blocks (cluster_id, salt, salts, ids, payload) of the vectors of each cluster.

    A block has at most about BLOCK_ELEMENTS elements; a large cluster has many
    blocks. ``kind`` says what a payload holds of each vector: single precision
    (ivf_flat), a byte for each dimension (ivf_sq8), or a byte for each slice
    (ivf_pq), the last two of what the cluster's centre leaves over.
    """

    blocks: DataFrame
    centres: list[list[float]]
    kind: str
    #: Of ivf_sq8 the smallest and largest values by dimension, of ivf_pq the books by slice.
    table: np.ndarray | None = None


def _encoded(left: np.ndarray, kind: str, table: np.ndarray | None) -> bytes:
    """The payload of what the centre left over."""
    if kind == "ivf_sq8":
        low, high = table
        scale = np.divide(255.0, high - low, out=np.zeros_like(low), where=high > low)
        return np.clip(np.floor((left - low) * scale + 0.5), 0, 255).astype(np.uint8).tobytes()
    parts = left.reshape(len(left), len(table), -1)
    return np.stack([np.argmax(parts[:, i] @ book.T - 0.5 * (book**2).sum(1), 1) for i, book in enumerate(table)], 1).astype(np.uint8).tobytes()


def _decoded(payload: bytes, count: int, centre: np.ndarray, kind: str, table: np.ndarray | None) -> np.ndarray:
    """The vectors that a payload stands for."""
    if kind == "ivf_flat":
        return np.frombuffer(payload, np.float32).reshape(count, -1)
    codes = np.frombuffer(payload, np.uint8).reshape(count, -1)
    if kind == "ivf_sq8":
        low, high = table
        return centre + low + codes * ((high - low) / 255.0)
    return centre + np.concatenate([book[codes[:, i]] for i, book in enumerate(table)], 1)


def build_cells(entries: DataFrame, centres: list[list[float]], kind: str = "ivf_flat", m: int = 8, bits: int = 8, doc: str = "doc", vector: str = "embedding") -> Cells:
    """The inverted file of the entries, written to the shared folder."""
    dim, shared = len(centres[0]), entries.sparkSession.sparkContext.broadcast(np.array(centres, np.float64))
    usable = entries.where(F.col(doc).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == dim)).select(F.col(doc).alias("doc"), F.col(vector).cast("array<float>").alias("v"))
    assigned = checkpointed(_ranked_clusters(usable, "v", centres, 1, "_c").withColumn("cluster_id", F.element_at("_c", 1)).drop("_c"))
    table = None
    if kind != "ivf_flat":

        @F.pandas_udf("array<float>")
        def left_over(vectors: pd.Series, clusters: pd.Series) -> pd.Series:
            return pd.Series(list((np.array(vectors.tolist(), np.float64) - shared.value[clusters]).astype(np.float32)))

        left = assigned.select(left_over("v", "cluster_id").alias("v"))
        if kind == "ivf_sq8":
            rows = sq8_ranges(left, "v").orderBy("at").collect()
            table = np.array([[r["low"] for r in rows], [r["high"] for r in rows]])
        else:
            table = np.array(train_pq(left, "v", dim, m, bits))
    books = entries.sparkSession.sparkContext.broadcast(table)
    rows = max(256, BLOCK_ELEMENTS // dim)
    sizes = assigned.groupBy("cluster_id").agg(F.ceil(F.count("*") / rows).cast("int").alias("salts"))
    salted = assigned.join(sizes, "cluster_id").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int"))
    doc_kind = salted.schema["doc"].dataType

    def pack(block: pa.Table) -> pa.Table:
        cluster = block.column("cluster_id")[0].as_py()
        x = _matrix(block.column("v"), dim, np.float32)
        payload = x.tobytes() if kind == "ivf_flat" else _encoded(x - shared.value[cluster], kind, books.value)
        ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), _column(block, "doc"))
        columns = [block.column("cluster_id").slice(0, 1), block.column("salt").slice(0, 1), block.column("salts").slice(0, 1), ids, pa.array([payload], pa.binary())]
        return pa.Table.from_arrays(columns, ["cluster_id", "salt", "salts", "ids", "payload"])

    packed = salted.groupBy("cluster_id", "salt").applyInArrow(pack, f"cluster_id int, salt int, salts int, ids array<{doc_kind.simpleString()}>, payload binary")
    return Cells(checkpointed(packed), centres, kind, table)


def search_cells(cells: Cells, queries: DataFrame, k: int, probes: int, digits: int = 6) -> DataFrame:
    """The ``k`` nearest of the vectors that each query's ``probes`` nearest clusters stand for; with all clusters of ivf_flat probed, as ``exact``.

    Queries that probe the same cluster meet each of its blocks together.
    """
    dim = len(cells.centres[0])
    usable = queries.where("query_id is not null and query_vector is not null").select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
    usable = usable.where(F.size("query_vector") == dim)
    parts = max(1, -(-usable.count() * dim // BLOCK_ELEMENTS))
    asked = _ranked_clusters(usable, "query_vector", cells.centres, probes, "_c").select("query_id", "query_vector", F.explode("_c").alias("cluster_id"))
    asked = asked.groupBy("cluster_id", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("_part")).agg(F.collect_list(F.struct("query_id", "query_vector")).alias("asked"))
    # a large cluster's blocks are met in tasks of their own
    asked = asked.join(cells.blocks.select("cluster_id", "salts").distinct(), "cluster_id")
    asked = asked.select("cluster_id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("asked.query_id").alias("query_ids"), F.flatten("asked.query_vector").alias("vectors"))
    met = cells.blocks.drop("salts").join(asked, ["cluster_id", "salt"])
    id_kind, doc_kind = usable.schema["query_id"].dataType, cells.blocks.schema["ids"].dataType.elementType
    doc_type, centres, kind, table = to_arrow_type(doc_kind), np.array(cells.centres), cells.kind, cells.table
    shared = queries.sparkSession.sparkContext.broadcast((centres, table))

    def near(batches):
        centres, table = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                cluster, ids, payload, query_ids, vectors = (batch.column(i).slice(at, 1) for i in range(5))
                docs, asking = ids.flatten(), query_ids.flatten()
                x = _decoded(payload[0].as_py(), len(docs), centres[cluster[0].as_py()], kind, table)
                best = blocks.Best(len(asking), k)
                _look(best, _matrix(vectors, dim), x, _names(docs), digits)
                yield from _found(best, asking, doc_type)

    schema = f"query_id {id_kind.simpleString()}, doc {doc_kind.simpleString()}, distance double, similarity double"
    return _ranked(met.select("cluster_id", "ids", "payload", "query_ids", "vectors").mapInArrow(near, schema), k, digits)


def bytes_per_vector(kind: str, dim: int, m: int = 8, bits: int = 8) -> int:
    """How many bytes an index of the kind keeps of each vector: a flat one the vector only, the others an id of 8 bytes too."""
    sizes = {"flat": 4 * dim, "ivf_flat": 4 * dim + 8, "ivf_sq8": dim + 8, "ivf_pq": -(-m * bits // 8) + 8}
    if kind not in sizes:
        raise ValueError(f"unknown kind of index: {kind}")
    return sizes[kind]


def reranked(candidates: DataFrame, entries: DataFrame, queries: DataFrame, k: int, doc: str = "doc", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest of the candidates (query_id, doc) by the distance to their stored vectors, as ``exact`` gives them."""
    met = candidates.select("query_id", "doc").join(entries.select(F.col(doc).alias("doc"), F.col(vector).alias("v")), "doc").join(queries.select("query_id", "query_vector"), "query_id")
    scored = met.select("query_id", "doc", F.round(V.squared_distance("query_vector", "v"), 6).alias("distance"), F.round(V.cosine("query_vector", "v"), 6).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy("distance", "doc")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def deep_enough(search, entries: DataFrame, k: int, depths, doc: str = "doc", vector: str = "embedding", least: float = LEAST_RECALL) -> tuple:
    """The first of ``depths`` at which search(queries, k, depth) finds ``least`` of the ``k`` nearest others of some entries, and its recall.

    It is measured against ``exact``, with at most MEASURED_WITH entries in a
    fixed random order; the last depth has to be a whole search.
    """
    some = entries.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(doc), doc).limit(MEASURED_WITH)
    asked = checkpointed(some.select(F.col(doc).alias("query_id"), F.col(vector).alias("query_vector")))
    truth = checkpointed(exact(entries, asked, k + 1, doc, vector).where("query_id <> doc").select("query_id", "doc"))
    wanted, depth, recall = truth.count(), None, 1.0
    for depth in depths:
        recall = truth.join(search(asked, k + 1, depth), ["query_id", "doc"]).count() / wanted if wanted else 1.0
        if recall >= least:
            break
    return depth, recall


def doubled(first: int, last: int) -> list[int]:
    """``first``, its doubles below ``last``, and ``last``."""
    return [first << i for i in range(64) if first << i < last] + [last]


def sq8_ranges(entries: DataFrame, vector: str) -> DataFrame:
    """(at, low, high): each dimension's range."""
    each = entries.where(F.col(vector).isNotNull()).select(F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x"))
    return each.groupBy("at").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def sq8(entries: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """``keep`` with codes (a byte for each dimension, as shorts) and decoded, the vector that the codes stand for.

    The ranges are one row of as many numbers as a vector has dimensions.
    """
    ranges = sq8_ranges(entries, vector).agg(F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("ranges"))
    both = entries.where(F.col(vector).isNotNull()).join(F.broadcast(ranges))
    codes = F.zip_with(F.col(vector).cast("array<double>"), F.col("ranges"), lambda x, r: F.when(r["high"] > r["low"], F.floor(255 * (x - r["low"]) / (r["high"] - r["low"]) + 0.5)).otherwise(F.lit(0)).cast("short"))
    coded = both.select(*keep, "ranges", codes.alias("codes"))
    decoded = F.zip_with("codes", "ranges", lambda c, r: r["low"] + c * (r["high"] - r["low"]) / 255)
    return coded.select(*keep, "codes", decoded.alias("decoded"))


def train_pq(entries: DataFrame, vector: str, dim: int, m: int = 8, bits: int = 8, seed: int = 7, sample: int = 50_000) -> list[list[list[float]]]:
    """Codebooks of product quantisation: for each of ``m`` slices, the centres of its parts."""
    part = dim // m
    if dim % m:
        raise ValueError("the dimension must be a multiple of m")
    sliced = entries.select(*(F.slice(F.col(vector), i * part + 1, part).alias(f"s{i}") for i in range(m)))
    return [train_clusters(sliced, f"s{i}", 2**bits, seed, sample) for i in range(m)]
