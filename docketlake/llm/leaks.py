"""Evaluation text inside documents, by a generalised suffix automaton.

The words of all evaluation items form one automaton, whose alphabet is the
set of their distinct words. A document streams through it once: the state
holds the longest run of words that ends here and occurs in some item. Runs
of ``min_run`` words and more are leaks; their spans can be cut out.

Items are dealt by hash into shards of about ``shard_words`` words, whose
number follows from their total. Each shard is a pass of its own over the
documents: its items are broadcast, and a worker holds the one automaton of
the pass that it works for. A hash deals an item to one shard only, so no item is cut.

Nulls: a null text or id of a document gives no row in ``leaks`` and is
handed on unchanged by ``without_leaks``; null items are ignored. Documents
and items shorter than ``min_run`` words never match. Repeated items each
give their own row, repeated documents likewise.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docketlake.session import checkpointed

WORD = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f])*")


def folded(word: str) -> str:
    """``word`` without case and accents."""
    if word.isascii():
        return word.lower()
    decomposed = unicodedata.normalize("NFD", word.casefold())
    return "".join(c for c in decomposed if not unicodedata.combining(c))


class Automaton:
    """Generalised suffix automaton over word numbers.

    ``steps[s]`` maps a word number to the next state, ``up[s]`` is the suffix
    link and ``longest[s]`` the longest run of the state. ``owners[s]`` has,
    for the states that can end a run of ``min_run`` words, the items that
    contain the last ``min_run`` words read.
    """

    def __init__(self, items: list[tuple[int, str]], min_run: int):
        self.min_run = min_run
        self.words: dict[str, int] = {}
        self.steps: list[dict[int, int]] = [{}]
        self.up, self.longest = [-1], [0]
        self._seen: list[set[int]] = [set()]
        for item_id, text in items:
            last = 0
            for word in WORD.findall(text):
                last = self._extend(last, self.words.setdefault(folded(word), len(self.words)))
                self._seen[last].add(item_id)
        for state in sorted(range(1, len(self.up)), key=self.longest.__getitem__, reverse=True):
            self._seen[self.up[state]] |= self._seen[state]
        self.owners: list[frozenset[int] | None] = [None] * len(self.up)
        for state in sorted(range(1, len(self.up)), key=self.longest.__getitem__):
            if self.longest[state] >= min_run:
                above = self.up[state]
                whole = self.longest[above] >= min_run
                self.owners[state] = self.owners[above] if whole else frozenset(self._seen[state])
        del self._seen

    def _new(self, longest: int, steps: dict[int, int], up: int) -> int:
        self.steps.append(steps)
        self.up.append(up)
        self.longest.append(longest)
        self._seen.append(set())
        return len(self.up) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` whose longest run ends ``state``'s run with ``word``."""
        copy = self._new(self.longest[state] + 1, dict(self.steps[target]), self.up[target])
        self.up[target] = copy
        while state >= 0 and self.steps[state].get(word) == target:
            self.steps[state][word] = copy
            state = self.up[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.steps[last].get(word)
        if target is not None:
            exact = self.longest[target] == self.longest[last] + 1
            return target if exact else self._split(last, word, target)
        new = self._new(self.longest[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.steps[state]:
            self.steps[state][word] = new
            state = self.up[state]
        if state >= 0:
            target = self.steps[state][word]
            exact = self.longest[target] == self.longest[state] + 1
            self.up[new] = target if exact else self._split(state, word, target)
        return new

    def runs(self, numbers: list[int]) -> Iterator[tuple[int, int, frozenset[int]]]:
        """Position of the last word, length and items of each longest run of at least ``min_run`` words."""
        steps, up, longest, owners, least = self.steps, self.up, self.longest, self.owners, self.min_run
        state = length = 0
        for at, word in enumerate(numbers):
            if word < 0:
                state = length = 0
                continue
            target = steps[state].get(word)
            while target is None and state:
                state = up[state]
                length = longest[state]
                target = steps[state].get(word)
            if target is None:
                length = 0
                continue
            state = target
            length += 1
            if length >= least:
                top = state
                while longest[up[top]] >= length:
                    top = up[top]
                yield at, length, owners[top]


_BUILT: dict[str, Automaton] = {}


def _automaton(shared, min_run: int, key: str) -> Automaton:
    """The automaton of a pass; built once in a worker process, in the place of another pass's."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(shared.value, min_run)
    return _BUILT[key]


class _Numbers(dict):
    """Word to its number in an automaton, -1 for other words; forgets when it has grown large."""

    def __init__(self, words: dict[str, int], most: int = 500_000):
        self._words, self._most = words, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self._most:
            self.clear()
        number = self[word] = self._words.get(folded(word), -1)
        return number


def item_shards(items: DataFrame, shard_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items of one shard after the other, each of about ``shard_words`` words."""
    usable = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    words = usable.agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    for shard in range(shards):
        # bounded: what the hash deals to one shard
        yield [(r["item_id"], r["text"]) for r in usable.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard).orderBy("item_id", "text").collect()]


def leaks(documents: DataFrame, items: DataFrame, min_run: int = 15, shard_words: int = 250_000) -> DataFrame:
    """(doc_id, item_id) of documents and items that share ``min_run`` consecutive words, without case and accents."""
    usable = documents.where("doc_id is not null and text is not null").select("doc_id", "text")

    def one_pass(shard: list[tuple[int, str]]) -> DataFrame:
        shared, key = documents.sparkSession.sparkContext.broadcast(shard), uuid.uuid4().hex

        def scan(batches):
            automaton = _automaton(shared, min_run, key)
            number = _Numbers(automaton.words)
            for batch in batches:
                docs, found = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    hit: set[int] = set()
                    for _, _, owners in automaton.runs([number[w] for w in WORD.findall(text)]):
                        hit |= owners
                    docs += [doc_id] * len(hit)
                    found += sorted(hit)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

        return usable.mapInArrow(scan, "doc_id long, item_id long")

    found = None
    for shard in item_shards(items, shard_words):
        of_shard = one_pass(shard)
        found = of_shard if found is None else found.unionAll(of_shard)
    return found.distinct()


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """The spans (first word, last word) with overlapping and neighbouring ones joined."""
    merged: list[list[int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    return merged


def without_leaks(documents: DataFrame, items: DataFrame, min_run: int = 15, max_coverage: float = 0.5, shard_words: int = 250_000) -> DataFrame:
    """Every document with its leaked spans cut out.

    Columns: doc_id, n_spans, leaked_words, n_words, coverage, dropped and
    clean_text. Overlapping spans are merged. A document of which more than
    ``max_coverage`` is leaked is dropped: its ``clean_text`` is null. A null
    text gives zeros and a null ``clean_text``. With several shards, the spans
    of a pass are written with the documents before the next one.
    """
    schema = "doc_id long, n_spans int, leaked_words int, n_words int, coverage double, dropped boolean, clean_text string"
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.string()]

    def one_pass(known: DataFrame, shard: list[tuple[int, str]]) -> DataFrame:
        """(doc_id, text, spans) with the shard's spans, as flat pairs of word numbers, joined to the known ones."""
        shared, key = documents.sparkSession.sparkContext.broadcast(shard), uuid.uuid4().hex

        def scan(batches):
            automaton = _automaton(shared, min_run, key)
            number = _Numbers(automaton.words)
            for batch in batches:
                made = []
                for text, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    spans = list(zip(flat[::2], flat[1::2]))
                    spans += [(at - length + 1, at) for at, length, _ in automaton.runs([number[w] for w in WORD.findall(text or "")])]
                    made.append([x for span in _merged(spans) for x in span])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.int32()))], ["doc_id", "text", "spans"])

        return known.mapInArrow(scan, "doc_id long, text string, spans array<int>")

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text, flat in zip(*(c.to_pylist() for c in batch.columns)):
                places = [m.span() for m in WORD.finditer(text or "")]
                merged = list(zip(flat[::2], flat[1::2]))
                leaked = sum(last - first + 1 for first, last in merged)
                coverage = leaked / len(places) if places else 0.0
                dropped = coverage > max_coverage
                clean = text
                if dropped:
                    clean = None
                elif merged:
                    kept, start = [], 0
                    for first, last in merged:
                        kept.append(text[start : places[first][0]])
                        start = places[last][1]
                    clean = "".join([*kept, text[start:]])
                rows.append((doc_id, len(merged), leaked, len(places), coverage, dropped, clean))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    spans = None
    for shard in item_shards(items, shard_words):
        known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array().cast("array<int>").alias("spans")) if spans is None else checkpointed(spans)
        spans = one_pass(known, shard)
    return spans.mapInArrow(cut, schema)
