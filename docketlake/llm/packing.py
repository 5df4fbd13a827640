"""Filling fixed-capacity containers with texts, by minimum bin slack.

A container opens with the longest item that is left. Which sums the other
lengths can make within the rest is found by a subset-sum over a bitset, the
lengths from the longest to the shortest; the fullest combination is taken out
of the stock and the next container opens.

Items of equal length are interchangeable, so the stock is a count for each
length: what a container costs depends on the capacity, not on the number of
items. Items are dealt by hash into blocks of about ``block`` items that are
packed apart from one another, at the cost of one loose container in each.

An item larger than a container is cut into pieces of a full container each
and a rest; the rest is packed like any item. Null and empty texts have no
tokens and get no container. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docketlake.session import checkpointed

#: Fixed value: how the public byte-level tokenizers cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODINGS: dict[str, object] = {}


def tokenizer(path: str, pattern: str = PATTERN):
    """The tiktoken encoding of a file of ranks; loaded once in a worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(items: DataFrame, key: str, text: str, path: str, pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens) by the public tokenizer at ``path``, which every worker can read."""

    def count(batches):
        encode = tokenizer(path, pattern).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["id", "n_tokens"])

    usable = items.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("long").alias("id"), text)
    return usable.mapInArrow(count, "id long, n_tokens long")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """The lengths, each used at most as often as counted, whose sum is the largest that fits into ``room``.

    ``lengths`` are the counted lengths from the longest to the shortest.
    Bit s of a bitset says that the sum s can be made. The bitset before each
    length is kept to find the way back from the best sum.
    """
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    reach, trail = 1, []
    for length in lengths:
        if length > room:
            continue
        before, times, step = reach, min(counts[length], room // length), 1
        # binary splitting: 1, 2, 4, ... times the length
        left = times
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & mask
            left -= step
            step *= 2
        if reach != before:
            trail.append((length, times, before))
            if reach & full:
                break
    rest, taken = reach.bit_length() - 1, []
    for length, times, before in reversed(trail):
        used = 0
        while not before >> rest & 1:
            rest -= length
            used += 1
        taken += [length] * used
        if used > times:
            raise AssertionError("a length was used more often than counted")
    return taken


def pack(lengths: list[int], capacity: int) -> list[int]:
    """The container of each item, for lengths of at most ``capacity``."""
    stock: dict[int, list[int]] = {}
    for item, length in enumerate(lengths):
        stock.setdefault(length, []).append(item)
    counts = {length: len(items) for length, items in stock.items()}
    order = sorted(counts, reverse=True)
    places, container = [0] * len(lengths), 0
    while order:
        first = order[0]
        chosen = [first]
        counts[first] -= 1
        if capacity > first:
            chosen += fullest(counts, [x for x in order if counts[x]], capacity - first)
            for length in chosen[1:]:
                counts[length] -= 1
        for length in chosen:
            places[stock[length].pop()] = container
        container += 1
        if any(not counts[length] for length in chosen):
            order = [length for length in order if counts[length]]
    return places


def containers(sizes: DataFrame, capacity: int = 2048, block: int = 16384) -> DataFrame:
    """(id, piece, n_tokens, container) for the items (id, n_tokens).

    ``container`` is unique over all blocks. Pieces count from 0; only items
    larger than ``capacity`` have more than one.
    """
    sizes = checkpointed(sizes)
    total = sizes.count()
    blocks = max(1, round(total / block))
    whole = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    pieces = (
        sizes.where("n_tokens > 0")
        .select("id", "n_tokens", F.explode(F.sequence(F.lit(0), whole)).alias("piece"))
        .select("id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).alias("n_tokens"))
    )
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.lit(blocks)))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("piece", "ascending")])
        places = pack(table.column("n_tokens").to_pylist(), capacity)
        number = table.column("block")[0].as_py()
        return table.drop_columns(["block"]).append_column("container", pa.array([number + place * blocks for place in places], pa.int64()))

    return dealt.groupBy("block").applyInArrow(fill, "id long, piece int, n_tokens long, container long")
