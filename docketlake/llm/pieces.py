"""Splitting oversized texts at natural boundaries, with balanced targets.

The fewest pieces that can hold the text are computed, equal-length targets
are placed, and each is moved to the strongest boundary near it. If a piece
then breaks the limit, the text is cut again into one piece more.

Each piece but the first starts ``overlap`` characters before the end of the
piece before it, so the text is the first piece followed by every other piece
without its first ``overlap`` characters.

Null, blank and short texts give no rows. Rows are independent of one
another: repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Boundaries from the strongest to the weakest; a cut falls at the match's start, after the text it closes.
BOUNDARIES = [
    re.compile(r"(?<=\S)(?=[^\S\n]*\r?\n[^\S\n]*\r?\n)"),
    re.compile(r"(?<=[.!?…][\"”»')\]])(?=\s*\r?\n)|(?<=[.!?…])(?=\s*\r?\n)"),
    re.compile(r"(?<=[.!?…][\"”»')\]])(?=\s)|(?<=[.!?…])(?=\s)"),
    re.compile(r"(?<=\S)(?=[^\S\n]*\r?\n)"),
    re.compile(r"(?<=[;:])(?=\s)"),
    re.compile(r"(?<=[,)–—])(?=\s)"),
    re.compile(r"(?<=\S)(?=\s)"),
]


def _apart(text: str, at: int) -> bool:
    """Whether a cut before ``at`` keeps a letter with its marks and a line end whole."""
    return not unicodedata.combining(text[at]) and text[at] not in "‍︎️" and text[at - 1 : at + 1] != "\r\n" and text[at - 1] != "‍"


def _snap(text: str, target: int, low: int, high: int) -> int:
    """The strongest boundary in [low, high], of equal ones the nearest to ``target``; without any, a cut near ``target``."""
    for boundary in BOUNDARIES:
        places = [m.start() for m in boundary.finditer(text, low, high + 1) if low <= m.start() <= high]
        if places:
            return min(places, key=lambda p: (abs(p - target), p))
    for at in range(min(target, high), low - 1, -1):
        if _apart(text, at):
            return at
    return min(target, high)


def cuts(text: str, limit: int, overlap: int, slack: float = 0.25) -> list[tuple[int, int]]:
    """Start and end of the pieces of ``text``, all at most ``limit`` long.

    ``slack`` is the part of a piece's length by which a target may move.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    size, step = len(text), limit - overlap
    if size <= limit:
        return [(0, size)] if size else []
    count = -(-(size - overlap) // step)
    while True:
        advance = (size - overlap) / count
        # cuts may move until another piece is needed; from the double on, every cut has room for a boundary
        reach = max(1, int(advance * slack))
        found, start = [], 0
        for k in range(1, count):
            target = round(overlap + advance * k)
            high = min(target + reach, start + limit, size - 1)
            low = max(target - reach, start + overlap + 1, size - (count - k) * step - overlap)
            if low > high:
                found = []
                break
            end = _snap(text, min(max(target, low), high), low, high)
            found.append((start, end))
            start = end - overlap
        if found and size - start <= limit:
            return [*found, (start, size)]
        count += 1


def split_oversized(items: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), limit: int = 8000, overlap: int = 200) -> DataFrame:
    """The pieces of every text with more than ``limit`` characters, white space at both ends removed.

    Columns: ``key``, those of ``keep``, piece (from 0), n_pieces, start and
    stop in the stripped text, and piece_text. Only oversized texts leave the JVM.
    """
    kept = [items.schema[name] for name in (key, *keep)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", piece int, n_pieces int, start int, stop int, piece_text string"

    def split(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            rows, pieces = [], []
            for row, whole in enumerate(texts):
                whole = whole.strip()
                if len(whole) > limit:
                    places = cuts(whole, limit, overlap)
                    rows += [row] * len(places)
                    pieces += [(i, len(places), a, b, whole[a:b]) for i, (a, b) in enumerate(places)]
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = [taken.column(i) for i in range(batch.num_columns - 1)]
            made = list(zip(*pieces)) or [()] * 5
            made = [pa.array(c, k) for c, k in zip(made, [pa.int32()] * 4 + [pa.string()])]
            yield pa.RecordBatch.from_arrays(columns + made, [*batch.schema.names[:-1], "piece", "n_pieces", "start", "stop", "piece_text"])

    long_enough = items.where(F.length(text) > limit).select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text}`").alias("_text"))
    return long_enough.mapInArrow(split, schema)
