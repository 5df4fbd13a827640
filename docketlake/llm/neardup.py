"""Near-duplicate texts by min-max hashing.

Each permutation of the shingle hashes keeps both its smallest and its largest
value, so ``bands * rows / 2`` permutations give ``bands * rows`` signature
values, each of which agrees between two texts with a probability equal to
their Jaccard similarity. Texts that agree in all values of a band are
candidates; every candidate is then verified on the exact shingle sets.
Candidates are verified in units, to each of which a text is sent once,
however many candidates it has there: classes with the same smallest
candidate form blocks, and a unit is a pair of blocks.

With ``rows`` values in each of ``bands`` bands, a pair of similarity s is a
candidate with probability 1 - (1 - s^rows)^bands: at the defaults 99.8 % at
0.6, 99.995 % at 0.65 and 99.9999 % at 0.7.

Texts with the same set of shingles form a class that is represented by its
smallest id. Only representatives are hashed and compared, so a mass of copies
costs one comparison; the copies come back when pairs or groups are written
out.

Band keys travel as binary blobs, one for each bucket of keys and batch of
texts, not as rows: a task sorts the keys of its buckets and finds equal ones.
A key shared by more than ``most`` representatives is handed on in blocks,
whose pairs other tasks compare, so no task expands a large bucket alone.

Nulls: a null id or text is left out, as are texts with fewer than
``min_words`` words. A row repeated with its id counts once; an id should not
have several texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from docketlake.operators.components import connected_components
from docketlake.session import checkpointed

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ALNUM: list[np.ndarray] = []
#: Texts whose characters are held as numbers at a time.
CHUNK = 500


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(count: int) -> np.ndarray:
    """1, p, p^2, ... of an odd p."""
    powers = np.full(count, np.uint64(0xD1342543DE82EF95))
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts, and where each text's words begin, with the end.

    Words are maximal runs of letters and digits. All texts are hashed at
    once, as arrays of code points.
    """
    if not _ALNUM:
        _ALNUM.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = _ALNUM[0][codes]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in lowered)])
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    letters = codes[inside[1:-1]].astype(np.uint64) * _ODD
    letters ^= letters >> np.uint64(29)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    letters *= _powers(int(lengths.max()))[place]
    return _mixed(np.add.reduceat(letters, first)), bounds


def shingle_sets(texts: list[str], width: int, min_words: int) -> list[np.ndarray | None]:
    """For each text, the sorted distinct hashes of its ``width``-word sequences; none where it is too short."""
    sets: list[np.ndarray | None] = []
    for start in range(0, len(texts), CHUNK):
        words, bounds = word_hashes(texts[start : start + CHUNK])
        total = words[: max(0, len(words) - width + 1)].copy()
        for k in range(1, width):
            total = _mixed(total * _ODD + words[k : len(total) + k])
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            if b - a < max(min_words, width):
                sets.append(None)
                continue
            mine = np.sort(total[a : b - width + 1])
            sets.append(mine[np.r_[True, mine[1:] != mine[:-1]]])
    return sets


def signature(sets: np.ndarray, permutations: np.ndarray) -> np.ndarray:
    """Smallest, then largest values of the set under each permutation of the 32-bit numbers.

    A permutation multiplies by an odd number and adds another; the shingles enter it with their high halves.
    """
    values = (sets >> np.uint64(32)).astype(np.uint32)[:, None] * permutations[0]
    values += permutations[1]
    return np.concatenate([values.min(0), values.max(0)])


def _permutations(count: int, seed: int) -> np.ndarray:
    random = np.random.default_rng(seed)
    return np.stack([random.integers(0, 2**31, count, np.uint32) * np.uint32(2) + np.uint32(1), random.integers(0, 2**32, count, np.uint32)])


def _usable(items: DataFrame, key: str, text: str) -> DataFrame:
    return items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("content"))


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]])


def _apart(ids: np.ndarray) -> bytes:
    apart = np.diff(ids, prepend=0)
    small = np.abs(apart).max(initial=0) < 1 << 31
    return apart.astype(np.int32 if small else np.int64).tobytes()


def _blobs(bucket: np.ndarray, keys: np.ndarray, ids: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: 4 bytes of each key, differences of the ascending ids in 4 bytes if they fit or 8, each name."""
    sort = np.argsort(bucket, kind="stable")
    bucket, keys, ids, names = bucket[sort], keys[sort].astype(np.uint32), ids[sort], names[sort]
    starts = _starts(bucket)
    ends = np.r_[starts[1:], len(bucket)]
    columns = [
        pa.array(bucket[starts].astype(np.int64)),
        pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        pa.array([_apart(ids[a:b]) for a, b in zip(starts, ends)], pa.binary()),
        pa.array([names[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "ids", "names"])


def _band_blobs(texts: DataFrame, width: int, min_words: int, bands: int, rows: int, buckets: int, seed: int) -> DataFrame:
    """(bucket, keys, ids, names): the entries of a batch of texts that fall into a bucket.

    Buckets from ``buckets`` on hold one entry for each text, whose key and
    name are the hash of its shingle set: they meet its copies. The others
    hold ``bands`` entries for each distinct set of the batch, under the
    smallest id that has it.
    """
    if bands * rows % 2:
        raise ValueError("bands * rows must be even")

    def scan(batches):
        permutations = _permutations(bands * rows // 2, seed)
        salts = _mixed(np.arange(1, bands + 1, dtype=np.uint64) * _ODD)
        # a band mixes smallest and largest values of different permutations
        order = np.random.default_rng(seed + 1).permutation(bands * rows)
        for batch in batches:
            ids, names, signatures, heads = [], [], [], {}
            entries = sorted(set(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            for (row_id, _), found in zip(entries, shingle_sets([text for _, text in entries], width, min_words)):
                if found is None:
                    continue
                name = xxhash.xxh3_64_intdigest(found.tobytes())
                ids.append(row_id)
                names.append(name)
                if name not in heads:
                    heads[name] = row_id
                    signatures.append(signature(found, permutations))
            if not ids:
                continue
            ids, names = np.array(ids, np.int64), np.array(names, np.uint64)
            yield _blobs(np.uint64(buckets) + (names >> np.uint64(32)) % np.uint64(max(1, buckets // 16)), names, ids, names)
            values = np.stack(signatures)[:, order].reshape(len(signatures), bands, rows).astype(np.uint64)
            keys = np.broadcast_to(salts, (len(signatures), bands)).copy()
            for k in range(rows):
                keys = _mixed(keys * _ODD + values[:, :, k])
            keys = keys.ravel()
            ids = np.repeat(np.fromiter(heads.values(), np.int64, len(heads)), bands)
            names = np.repeat(np.fromiter(heads.keys(), np.uint64, len(heads)), bands)
            yield _blobs((keys >> np.uint64(32)) % np.uint64(buckets), keys, ids, names)

    return texts.mapInArrow(scan, "bucket long, keys binary, ids binary, names binary")


def _met(texts: DataFrame, width: int, min_words: int, bands: int, rows: int, most: int, seed: int) -> DataFrame:
    """(a, b, same, left, right): copies (same), candidates, and pairs of blocks of ids that share a key."""
    spark = texts.sparkSession
    buckets = max(64, texts.count() * bands // 250_000)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 2)
    blobs = _band_blobs(texts, width, min_words, bands, rows, buckets, seed)

    def meet(batches):
        held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        for batch in batches:
            for bucket, *blob in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(bucket, []).append(blob)
        while held:
            bucket, blobs = held.popitem()
            keys = np.frombuffer(b"".join(x[0] for x in blobs), np.uint32).astype(np.uint64)
            ids = np.concatenate([np.cumsum(np.frombuffer(x[1], np.int32 if len(x[1]) == len(x[0]) else np.int64), dtype=np.int64) for x in blobs])
            names = np.frombuffer(b"".join(x[2] for x in blobs), np.uint64)
            if bucket >= buckets:
                keys = names
            sort = np.lexsort((ids, keys))
            keys, ids, names = keys[sort], ids[sort], names[sort]
            starts = _starts(keys)
            sizes = np.diff(np.r_[starts, len(keys)])
            if bucket >= buckets:
                copies = np.ones(len(ids), bool)
                copies[starts] = False
                if copies.any():
                    yield _met_batch(np.repeat(ids[starts], sizes)[copies], ids[copies], True)
                continue
            found: list[np.ndarray] = []
            for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                # of each shingle set, the smallest id
                here = np.sort(ids[start : start + size][np.unique(names[start : start + size], return_index=True)[1]])
                if len(here) > most:
                    blocks = [here[k : k + most].tobytes() for k in range(0, len(here), most)]
                    for i, left in enumerate(blocks):
                        rest = len(blocks) - i
                        yield _met_batch(np.zeros(rest, np.int64), np.zeros(rest, np.int64), False, [left] * rest, blocks[i:])
                elif len(here) == 2:
                    found.append(here)
                elif len(here) > 2:
                    found.append(np.stack([here[k] for k in np.triu_indices(len(here), 1)], 1).ravel())
            if found:
                pairs = np.unique(np.concatenate(found).reshape(-1, 2), axis=0)
                yield _met_batch(pairs[:, 0], pairs[:, 1], False)

    return blobs.repartition(parts, "bucket").mapInArrow(meet, "a long, b long, same boolean, left binary, right binary")


def _met_batch(a: np.ndarray, b: np.ndarray, same: bool, left: list | None = None, right: list | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.binary())
    blocks = [none if x is None else pa.array(x, pa.binary()) for x in (left, right)]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), same)), *blocks], ["a", "b", "same", "left", "right"])


def _expand(batches):
    """The pairs of the ids of two blocks."""
    for batch in batches:
        for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            left, right = np.frombuffer(left, np.int64), np.frombuffer(right, np.int64)
            for a in left.tolist():
                partners = right[right > a]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(partners), a)), pa.array(partners)], ["a", "b"])


def similar_classes(items: DataFrame, key: str, text: str, threshold: float = 0.8, width: int = 5, min_words: int = 20, bands: int = 80, rows: int = 5, most: int = 2000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Copies, and the pairs of classes that are similar.

    The first result is (id, class_id): the texts that have the shingle set of
    a smaller id, the class's; every other text is its own class. The second
    is (class_a, class_b, similarity), class_a < class_b, with similarity, the
    exact Jaccard similarity of the shingle sets, of at least ``threshold``.
    """
    texts = _usable(items, key, text)
    met = checkpointed(_met(texts, width, min_words, bands, rows, most, seed))
    copies = met.where("same and a <> b").select(F.col("b").alias("id"), F.col("a").alias("class_id")).distinct()
    blocks = met.where("left is not null").select("left", "right").repartition("left", "right").mapInArrow(_expand, "a long, b long")
    near = met.where("not same and left is null").select("a", "b").unionAll(blocks)
    near = (
        near.join(copies.select(F.col("id").alias("a"), F.col("class_id").alias("head_a")), "a", "left")
        .join(copies.select(F.col("id").alias("b"), F.col("class_id").alias("head_b")), "b", "left")
        .select(F.coalesce("head_a", "a").alias("a"), F.coalesce("head_b", "b").alias("b"))
        .where("a <> b")
        .select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"))
        .distinct()
    )
    pairs = _verified(checkpointed(near), texts, threshold, width, min_words)
    return copies, checkpointed(pairs)


def _verified(near: DataFrame, texts: DataFrame, threshold: float, width: int, min_words: int, block: int = 256) -> DataFrame:
    """(class_a, class_b, similarity) of the candidates (class_a, class_b) whose exact similarity reaches the threshold.

    A candidate's unit is the smallest candidate of class_a, and the blocks to
    which hashes assign both classes among those with the same smallest one.
    """
    ends = near.select(F.col("class_a").alias("class"), F.col("class_a").alias("least")).unionAll(near.select(F.col("class_b").alias("class"), F.col("class_a").alias("least")))
    heads = ends.groupBy("class").agg(F.min("least").alias("head"))
    sizes = heads.groupBy("head").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    place = lambda name: F.pmod(F.xxhash64(name), "blocks")
    placed = near.join(heads.join(sizes, "head").withColumnRenamed("class", "class_a"), "class_a")
    placed = placed.select("class_a", "class_b", F.xxhash64("head", place("class_a"), place("class_b")).alias("unit"))
    asked = placed.select("unit", F.col("class_a").alias("id")).unionAll(placed.select("unit", F.col("class_b").alias("id"))).distinct()
    # texts first, then the pairs
    rows = asked.join(texts, "id").select("unit", F.lit(0).alias("step"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "content")
    rows = rows.unionAll(placed.select("unit", F.lit(1), "class_a", "class_b", F.lit(None).cast("string")))
    parts = max(int(near.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartition(parts, "unit").sortWithinPartitions("unit", "step")

    def verify(batches):
        now, held = None, {}
        for batch in batches:
            units, steps, left, right, contents = (c.to_pylist() for c in batch.columns)
            contents_of = {a: content for step, a, content in zip(steps, left, contents) if step == 0}
            sets = dict(zip(contents_of, shingle_sets(list(contents_of.values()), width, min_words)))
            found: list[tuple[int, int, float]] = []
            for unit, step, a, b in zip(units, steps, left, right):
                if unit != now:
                    now, held = unit, {}
                if step == 0:
                    held[a] = sets[a]
                    continue
                one, other = held[a], held[b]
                if one is None or other is None:
                    continue
                # a smaller set cannot hold enough of a larger one
                if min(len(one), len(other)) < threshold * max(len(one), len(other)):
                    continue
                both = _shared(one, other)
                similarity = both / (len(one) + len(other) - both)
                if similarity >= threshold:
                    found.append((a, b, similarity))
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["class_a", "class_b", "similarity"])

    return rows.mapInArrow(verify, "class_a long, class_b long, similarity double")


def _shared(one: np.ndarray, other: np.ndarray) -> int:
    """How many numbers two ascending arrays without repetitions share."""
    if len(one) > len(other):
        one, other = other, one
    at = np.searchsorted(other, one)
    at[at == len(other)] = 0
    return int((other[at] == one).sum())


def similar_pairs(items: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows with similar texts, copies written out."""
    copies, pairs = similar_classes(items, key, text, **options)
    crowd = copies.unionAll(copies.select(F.col("class_id").alias("id"), "class_id").distinct())
    # a crowd's pairs are written by as many tasks as it has slices
    slices = crowd.groupBy("class_id").agg(F.ceil(F.count("*") / 1024).cast("int").alias("slices"))
    sliced = crowd.join(slices, "class_id")
    mine = sliced.select("class_id", F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"), F.col("id").alias("id_a"))
    all_others = sliced.select("class_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("id").alias("id_b"))
    same = mine.join(all_others, ["class_id", "slice"]).where("id_a < id_b").select("id_a", "id_b")
    across = (
        pairs.join(crowd.select(F.col("class_id").alias("class_a"), F.col("id").alias("copy_a")), "class_a", "left")
        .join(crowd.select(F.col("class_id").alias("class_b"), F.col("id").alias("copy_b")), "class_b", "left")
        .select(F.coalesce("copy_a", "class_a").alias("a"), F.coalesce("copy_b", "class_b").alias("b"))
        .select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    )
    return across.unionAll(same)


def similar_groups(items: DataFrame, key: str, text: str, **options) -> DataFrame:
    """One row for each text of a group: id, class_id, group_id (the group's smallest id) and links.

    ``links`` counts the other classes to which the text's class is similar.
    Texts without copies and links are groups of their own and are left out.
    """
    copies, pairs = similar_classes(items, key, text, **options)
    ends = pairs.select(F.col("class_a").alias("class_id")).unionAll(pairs.select("class_b"))
    links = ends.groupBy("class_id").agg(F.count("*").alias("links"))
    groups = connected_components(pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    heads = links.select("class_id").unionAll(copies.select("class_id")).distinct().select(F.col("class_id").alias("id"), "class_id")
    return (
        copies.unionAll(heads)
        .join(links, "class_id", "left")
        .join(groups.select(F.col("node").alias("class_id"), F.col("component").alias("group_id")), "class_id", "left")
        .select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
