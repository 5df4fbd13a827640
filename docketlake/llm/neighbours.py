"""The k most similar vectors of every vector, by additive quantisation.

Vectors are normalised, so their cosine is their dot product. A bounded sample
trains ``stages`` codebooks of 256 full-dimensional vectors, each on what the
ones before it leave over. Every vector is encoded as one entry of each
codebook by a beam search, and its code is stored with the norm of what the
code leaves over.

Vectors with the same keys form a group, in which each looks for its
neighbours. A group is dealt by hash into blocks, and every two blocks of a
group, and each block with itself, meet in one task. There the codes are
scored: a table of some vectors' products with the codebooks is looked up by
the others' codes, and divided by the codes' norms. The score stands for the
similarity of both to each other, so every pair is scored once for both. A pair
whose score comes within ``margin`` standard errors of the k-th best similarity
of one of the two is reranked by the exact product. The standard error is that of
a random direction of the stored residual norm, so ``margin`` sets the loss.

A block meets itself first, with the k best among some of its vectors to start from; the k-th best similarity that a vector has there
is what it brings along when its block meets others, which then only report
what is better. What the blocks' meetings found is merged for each block.

A task holds two blocks. A block has ``block`` vectors at most in a group of
some hundred thousand, and grows with the root of larger ones up to ``largest``,
so that the copies of a block that are shuffled, one for each other block,
grow with the root of the group and not with the group. The meetings of a hot
group are dealt over the tasks in turn. Work in a group is quadratic in codes
(a few bytes read for each pair of vectors), because vectors that are spread
evenly, as normalised text embeddings often are within a subject, offer no cells to skip.

Null vectors, all-zero vectors, vectors with a null, infinite or NaN element
or another dimension than ``dim``, and rows with a null id or key neither ask
nor are found. Similarities are rounded to six decimals; equal ones go to the smaller id. Groups of at most k
vectors give all their pairs. Of rows repeated with their id in a group one counts, the first
by its bytes; an id should be in one group only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docketlake.session import checkpointed

ENTRIES = 256


def train(sample: np.ndarray, stages: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Codebooks (stages, 256, dim), each by k-means on the residuals of the ones before it."""
    random = np.random.default_rng(seed)
    left = sample.astype(np.float32).copy()
    books = np.zeros((stages, ENTRIES, sample.shape[1]), np.float32)
    for book in books:
        if not len(left):
            break
        book[:] = left[random.choice(len(left), ENTRIES, replace=len(left) < ENTRIES)]
        for _ in range(rounds):
            nearest = np.argmax(left @ book.T - 0.5 * (book**2).sum(1), 1)
            order = np.argsort(nearest, kind="stable")
            found, starts, counts = np.unique(nearest[order], return_index=True, return_counts=True)
            book[found] = np.add.reduceat(left[order], starts) / counts[:, None]
        left -= book[np.argmax(left @ book.T - 0.5 * (book**2).sum(1), 1)]
    return books


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = 2, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, stages) and residual norms (n): of each stage's extensions, the ``beam`` nearest sums survive."""
    stages, _, dim = books.shape
    codes = np.zeros((len(vectors), stages), np.uint8)
    left = np.zeros(len(vectors), np.float32)
    for start in range(0, len(vectors), chunk):
        rest = vectors[start : start + chunk][:, None, :]
        n = len(rest)
        lines = np.arange(n)
        paths = np.zeros((n, 1, stages), np.uint8)
        squares = np.einsum("nwd,nwd->nw", rest, rest)
        for stage, book in enumerate(books):
            # how near each path comes with each entry: the negative square of what would be left
            near = (rest.reshape(-1, dim) @ (2 * book.T) - (book**2).sum(1)).reshape(n, -1, ENTRIES) - squares[:, :, None]
            near = near.reshape(n, -1)
            keep = beam if stage < stages - 1 else 1
            best = np.empty((n, keep), np.int64)
            squares = np.empty((n, keep), np.float32)
            for k in range(keep):
                best[:, k] = near.argmax(1)
                squares[:, k] = -near[lines, best[:, k]]
                near[lines, best[:, k]] = -np.inf
            parents, entries = np.divmod(best, ENTRIES)
            paths = paths[lines[:, None], parents]
            paths[:, :, stage] = entries
            rest = rest[lines[:, None], parents] - book[entries]
        codes[start : start + n] = paths[:, 0]
        left[start : start + n] = np.sqrt(np.maximum(squares[:, 0], 0))
    return codes, left


def _true_places(mask: np.ndarray) -> np.ndarray:
    """Where a mask with few true places is true, in the flat array; eight places are looked at as one byte."""
    packed = np.packbits(mask)
    some = np.flatnonzero(packed)
    return ((some << 3)[:, None] + _BITS)[np.unpackbits(packed[some]).reshape(-1, 8).view(bool)]


_BITS = np.arange(8)


class _Side:
    """A block of unit vectors and the k best neighbours of each so far.

    ``floor`` is a similarity that the k-th best is known to reach. The
    vectors come in the order of their codes' norms.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, left: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.vectors, self.left, self.k = ids, vectors, left, k
        self.picks = np.ascontiguousarray(codes.T.astype(np.intp))
        self.norms = np.sqrt(np.maximum(1 - left.astype(np.float64) ** 2, 1e-6))
        self.best = np.full((len(ids), k), -np.inf, np.float32)
        self.who = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floor = np.full(len(ids), -np.inf, np.float32) if floor is None else floor

    def least(self, part: slice) -> np.ndarray:
        """What a similarity to the vectors of ``part`` must reach."""
        return np.maximum(self.floor[part], self.best[part, -1])

    def keep(self, rows: np.ndarray, similarities: np.ndarray, ids: np.ndarray) -> None:
        """Merges found neighbours of the vectors ``rows`` into the k best."""
        better = similarities >= np.maximum(self.floor[rows], self.best[rows, -1])
        if not better.any():
            return
        rows, similarities, ids = rows[better], similarities[better], ids[better]
        order = np.argsort(rows, kind="stable")
        rows, similarities, ids = rows[order], similarities[order], ids[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        counts = np.diff(np.r_[first, len(rows)])
        mine, width = rows[first], counts.max()
        at = np.arange(len(rows)) - np.repeat(first, counts)
        line = np.repeat(np.arange(len(mine)), counts)
        wide = np.full((len(mine), self.k + width), -np.inf, np.float32)
        names = np.full((len(mine), self.k + width), np.iinfo(np.int64).max)
        wide[:, : self.k], names[:, : self.k] = self.best[mine], self.who[mine]
        wide[line, self.k + at], names[line, self.k + at] = similarities, ids
        order = np.lexsort((names, -wide), axis=1)[:, : self.k]
        self.best[mine], self.who[mine] = np.take_along_axis(wide, order, 1), np.take_along_axis(names, order, 1)


SCALE = 8192  # of the 16-bit tables; sums of them stay below 2^15


def _sample_best(side: _Side, some: int = 1024, lines: int = 1024) -> tuple[np.ndarray, np.ndarray] | None:
    """The k best of each vector among some of its block, and their places, by exact similarity; the k-th becomes its floor.

    Of a block of fewer than twice as many, all are compared and kept, and nothing is left to look for.
    """
    step = max(1, len(side.ids) // some)
    sample = side.vectors[::step]
    best, places = np.full(side.best.shape, -np.inf, np.float32), np.zeros(side.best.shape, np.int64)
    if len(sample) > side.k:
        for top in range(0, len(side.ids), lines):
            near = side.vectors[top : top + lines] @ sample.T
            rows = np.arange(top, top + len(near))
            # a vector is no neighbour of its own
            own = rows % step == 0
            near[own, rows[own] // step] = -np.inf
            if step == 1:
                # the sample is the block: these are the neighbours
                least = np.partition(near, len(sample) - side.k, axis=1)[:, len(sample) - side.k] - 2e-6
                found, columns = np.nonzero(near >= least[:, None])
                side.keep(found + top, np.round(near[found, columns], 6), side.ids[columns])
                continue
            places[rows] = np.argpartition(-near, side.k - 1, axis=1)[:, : side.k]
            best[rows] = np.round(np.take_along_axis(near, places[rows], 1), 6)
        if step == 1:
            return None
        side.floor[:] = best.min(1) - 1e-5
    return best, places * step


def _fill(side: _Side, best: np.ndarray, places: np.ndarray) -> None:
    """Gives vectors that found fewer than k the ones of ``_sample_best``, so that what the codes missed costs a place at most."""
    for row in np.flatnonzero(np.isinf(side.best[:, -1]) & np.isfinite(best).all(1)):
        found = dict(zip(side.ids[places[row]].tolist(), best[row].tolist()))
        found |= {who: value for who, value in zip(side.who[row].tolist(), side.best[row].tolist()) if value > -np.inf}
        kept = sorted(found.items(), key=lambda x: (-x[1], x[0]))[: side.k]
        side.who[row], side.best[row] = [who for who, _ in kept], [value for _, value in kept]


def meet(one: _Side, other: _Side, books: np.ndarray, margin: float, lines: int = 256, wide: int = 1024) -> None:
    """Looks for neighbours of either side among the other, or within one block.

    A similarity is estimated by the looked-up product over the code's
    norm, as for unit vectors what a code leaves over is nearly at right
    angles to it. A tile's vectors have nearly the same norm.
    """
    stages, _, dim = books.shape
    flat, margin, same = books.reshape(-1, dim), margin / np.sqrt(dim - 1), one is other
    for top in range(0, len(one.ids), lines):
        mine = slice(top, top + lines)
        asked = one.vectors[mine]
        tables = np.rint(flat @ asked.T * SCALE).clip(-SCALE, SCALE).astype(np.int16).reshape(stages, ENTRIES, -1)
        score, added = np.empty((2, wide, len(asked)), np.int16)
        for low in range(top // wide * wide if same else 0, len(other.ids), wide):
            part = slice(low, low + wide)
            n = len(other.ids[part])
            np.take(tables[0], other.picks[0, part], 0, out=score[:n], mode="clip")
            for stage in range(1, stages):
                np.take(tables[stage], other.picks[stage, part], 0, out=added[:n], mode="clip")
                np.add(score[:n], added[:n], out=score[:n])
            norm, slack = other.norms[part].mean() * SCALE, margin * other.left[part].mean()
            ask, answer = (np.floor(np.maximum((x - slack) * norm, -32000)).astype(np.int16) for x in (one.least(mine), other.least(part)))
            mask = (score[:n] >= ask[None, :]) | (score[:n] >= answer[:, None])
            count = np.count_nonzero(mask)
            if not count:
                continue
            near = None
            if 100 * count > mask.size:
                # so many that one product of the tile costs less than gathering each pair
                near = other.vectors[part] @ asked.T
                mask &= (near >= one.least(mine)[None, :] - 1e-6) | (near >= other.least(part)[:, None] - 1e-6)
            hits = _true_places(mask)
            columns, rows = np.divmod(hits, len(asked))
            if same:
                # every pair once
                once = columns + low > rows + top
                columns, rows, hits = columns[once], rows[once], hits[once]
            if not len(hits):
                continue
            similarities = np.einsum("ij,ij->i", asked[rows], other.vectors[part][columns]) if near is None else near.ravel()[hits]
            similarities = np.round(similarities, 6)
            rows, columns = rows + top, columns + low
            one.keep(rows, similarities, other.ids[columns])
            other.keep(columns, similarities, one.ids[rows])


def _usable(vectors: DataFrame, key: str, vector: str, groups: tuple[str, ...], dim: int) -> DataFrame:
    """(group, id, v) of the rows without nulls; vectors of zero length still among them."""
    usable = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) == dim))
    for name in groups:
        usable = usable.where(F.col(name).isNotNull())
    group = F.xxhash64(*groups) if groups else F.lit(0).cast("long")
    return usable.select(group.alias("group"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))


def _units(usable: DataFrame, dim: int) -> DataFrame:
    """(group, id, unit): unit vectors as float32 blobs."""

    def scan(batches):
        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                norms = np.sqrt((flat * flat).sum(1))
                good = np.isfinite(norms) & (norms > 0)
                unit = (flat / norms[:, None]).astype(np.float32)
            blobs = pa.array([unit[i].tobytes() for i in np.flatnonzero(good)], pa.binary())
            kept = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), blobs], ["group", "id", "unit"])

    return usable.mapInArrow(scan, "group long, id long, unit binary")


def nearest(
    vectors: DataFrame,
    key: str,
    vector: str,
    groups: tuple[str, ...] = (),
    k: int = 10,
    dim: int = 64,
    stages: int = 12,
    beam: int = 2,
    margin: float = 3.25,
    block: int = 16384,
    largest: int = 131072,
    sample: int = 16384,
) -> DataFrame:
    """(id, rank, neighbour, similarity): the ``k`` most similar vectors of every vector within its group.

    Blocks have at most about ``block`` vectors, more in large groups, ``largest`` at most. ``sample`` bounds the
    vectors that train the codebooks; all vectors are encoded and searched.
    """
    spark = vectors.sparkSession
    usable = _usable(vectors, key, vector, groups, dim)
    sizes = usable.groupBy("group").agg(F.count("*").alias("n"))
    total = usable.count()
    share = int(min(1.0, sample / max(1, total)) * (1 << 30))
    drawn = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).orderBy("id").limit(sample)
    drawn = [bytes(r.unit) for r in _units(drawn, dim).select("unit").collect()]
    books = spark.sparkContext.broadcast(train(np.frombuffer(b"".join(drawn), np.float32).reshape(-1, dim), stages))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // block)

    # a group's number of blocks follows from its size; ids are spread over the blocks by hash
    of_block = F.least(F.lit(largest), F.greatest(F.lit(block), 48 * F.sqrt("n")))
    sizes = sizes.select("group", F.ceil(F.col("n") / of_block).cast("int").alias("blocks"))
    blocked = _units(usable, dim).join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))

    def blocks_of(batches):
        """A partition's blocks, encoded, in the order of their codes' norms, with the best neighbours inside."""
        held: dict[tuple[int, int, int], list[tuple[int, bytes]]] = {}
        for batch in batches:
            for group, id_, unit, blocks, own in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault((group, blocks, own), []).append((id_, unit))
        while held:
            (group, blocks, own), rows = held.popitem()
            rows.sort()
            rows = [row for at, row in enumerate(rows) if not at or row[0] != rows[at - 1][0]]
            ids = np.array([i for i, _ in rows], np.int64)
            units = np.frombuffer(b"".join(u for _, u in rows), np.float32).reshape(-1, dim)
            codes, left = encode(units, books.value, beam)
            order = np.argsort(left, kind="stable")
            side = _Side(ids[order], units[order], codes[order], left[order], k)
            some = _sample_best(side)
            if some:
                meet(side, side, books.value, margin)
                _fill(side, *some)
            parts = [side.ids, side.vectors, codes[order], side.left, side.best, side.who]
            place = [pa.array([group]), pa.array([blocks], pa.int32()), pa.array([own], pa.int32())]
            if blocks == 1:
                # nothing else will be met
                parts[1:4] = [np.zeros(0, np.uint8)] * 3
            yield pa.RecordBatch.from_arrays(place + [pa.array([x.tobytes()], pa.binary()) for x in parts], ["group", "blocks", "own", *_PARTS])

    # the blocks of a group go to the tasks in turn
    turn = F.pmod(F.col("group") + F.col("own"), F.lit(parts)).cast("int")
    blobs = blocked.repartitionById(parts, turn).mapInArrow(blocks_of, "group long, blocks int, own int, " + ", ".join(f"{x} binary" for x in _PARTS))
    blobs = checkpointed(blobs)
    several = blobs.where("blocks > 1").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("`with` <> own")
    several = several.select("group", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), *_PARTS)
    # a group's meetings are numbered in turn, and go to the tasks in turn
    number = F.expr("high * (high - 1) div 2 + low")
    meetings = blobs.agg(F.sum(F.when(F.col("own") == 0, F.expr("blocks * (blocks - 1) div 2")))).first()[0] or 0
    tasks = max(1, min(4 * meetings, 4 * parts))
    met = several.repartitionById(tasks, F.pmod(F.col("group") + number, F.lit(tasks)).cast("int")).sortWithinPartitions("group", "low", "high")

    def meetings_of(batches):
        """What two blocks find in one another, for each of them."""
        waiting: dict[tuple[int, int, int], _Side] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                group, low, high, *parts = (column[at].as_py() for column in batch.columns)
                ids, units, codes, left, best, _ = (np.frombuffer(x, kind) for x, kind in zip(parts, _KINDS))
                side = _Side(ids, units.reshape(-1, dim), codes.reshape(-1, stages), left, k, best.reshape(-1, k)[:, -1].copy())
                other = waiting.pop((group, low, high), None)
                if other is None:
                    waiting[group, low, high] = side
                    continue
                meet(other, side, books.value, margin)
                for one in (other, side):
                    rows, places = np.nonzero(np.isfinite(one.best))
                    found = [one.ids[rows], one.best[rows, places], one.who[rows, places]]
                    yield pa.RecordBatch.from_arrays([pa.array([group]), *(pa.array([x.tobytes()], pa.binary()) for x in found)], ["group", "ids", "best", "who"])

    def merged(batches):
        """The k best of what was found for the ids of a partition."""
        held: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for kept, column, kind in zip(held, batch.columns, (np.int64, np.float32, np.int64)):
                kept += [np.frombuffer(x, kind) for x in column.to_pylist()]
        if not held[0]:
            return
        ids, best, who = (np.concatenate(x) for x in held)
        order = np.lexsort((who, -best, ids))
        ids, best, who = ids[order], best[order], who[order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        rank = 1 + np.arange(len(ids)) - np.repeat(starts, np.diff(np.r_[starts, len(ids)]))
        some = rank <= k
        yield _rows(ids[some], rank[some], who[some], best[some])

    def alone(batches):
        for batch in batches:
            for ids, best, who in zip(*(c.to_pylist() for c in batch.columns)):
                ids, best, who = np.frombuffer(ids, np.int64), np.frombuffer(best, np.float32).reshape(-1, k), np.frombuffer(who, np.int64).reshape(-1, k)
                rows, ranks = np.nonzero(np.isfinite(best))
                yield _rows(ids[rows], ranks + 1, who[rows, ranks], best[rows, ranks])

    schema = "id long, rank int, neighbour long, similarity float"
    single = blobs.where("blocks = 1").select("ids", "best", "who").mapInArrow(alone, schema)
    if not meetings:
        return single
    # ids are cut into slices by hash, so that a merging task holds what a slice's ids found
    slices = max(parts, total // 65536)

    def sliced(batches):
        """Found neighbours by slice of the ids that they are of."""
        for batch in batches:
            for ids, best, who in zip(*(c.to_pylist() for c in batch.columns)):
                ids, best, who = np.frombuffer(ids, np.int64), np.frombuffer(best, np.float32).ravel(), np.frombuffer(who, np.int64).ravel()
                if len(best) > len(ids):
                    ids = np.repeat(ids, k)
                good = np.isfinite(best)
                ids, best, who = ids[good], best[good], who[good]
                slice_ = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % slices
                order = np.argsort(slice_, kind="stable")
                bounds = np.flatnonzero(np.r_[True, np.diff(slice_[order]) != 0, True]) if len(order) else np.zeros(1, int)
                for a, b in zip(bounds[:-1], bounds[1:]):
                    here = order[a:b]
                    values = [pa.array([x[here].tobytes()], pa.binary()) for x in (ids, best, who)]
                    yield pa.RecordBatch.from_arrays([pa.array([slice_[here[0]]], pa.int32()), *values], ["slice", "ids", "best", "who"])

    inside = blobs.where("blocks > 1").select("ids", "best", "who")
    across = met.mapInArrow(meetings_of, "group long, ids binary, best binary, who binary").select("ids", "best", "who")
    found = inside.unionAll(across).mapInArrow(sliced, "slice int, ids binary, best binary, who binary")
    return single.unionAll(found.repartitionById(slices, "slice").select("ids", "best", "who").mapInArrow(merged, schema))


_PARTS = ("ids", "units", "codes", "lefts", "best", "who")
_KINDS = (np.int64, np.float32, np.uint8, np.float32, np.float32, np.int64)


def _rows(ids: np.ndarray, ranks: np.ndarray, who: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ranks.astype(np.int32)), pa.array(who), pa.array(best)], ["id", "rank", "neighbour", "similarity"])
