"""Text that was decoded with a wrong character encoding.

Every distinct clean word of the corpus is garbled under all chains of
encodings: written in one encoding and read in another, once or twice. The
garbled forms are hash-joined with the tokens of the texts. A form that no
clean text has, such as UTF-8 read as single bytes, is a case however many
texts have it. Other forms are cases if the corpus knows the word far better, or
if another token of the text comes from the same chain. Chains that lose characters are covered like the
others, because the table is built forwards.

Text read two bytes at a time (UTF-16) has no words; there, every window of
three characters is looked up among the windows that clean words give, those
in ASCII letters only as well as the others.

A token of a text is a run of ASCII letters and non-ASCII characters with at
least one of the latter. Tokens of ordinary letters in ordinary case are
*plain*. Only plain tokens are taken for clean words, and only other tokens
are looked up.

Nulls and empty texts give no rows. Ids should be unique; rows repeated with
their id count once. The table of forms grows with the vocabulary, not with
the texts, and is joined, never broadcast; forms that no text can have are left
out of the join by a bit filter of the texts' tokens, of at most 16 MB.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docketlake.llm.lookalikes import TO_LATIN
from docketlake.llm.vocabulary import MOST_HELD
from docketlake.session import checkpointed

TOKEN = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
_LOWER = "a-záàâãäéèêëíìîïóòôõöúùûüçñ"
_UPPER = "A-ZÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ"
PLAIN = re.compile(f"[{_UPPER}]?[{_LOWER}]+[ºª]?|[{_UPPER}]{{2,}}|[{_UPPER}]|[ºª§]")
#: Outer punctuation that clean text has beside words.
EDGES = "“”‘’«»–—…"
#: Characters of text that was read two bytes at a time.
_WIDE = re.compile(r"[‐-⁯⺀-鿿가-]")

#: The encodings that are confused with one another.
SINGLE = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251")
WINDOW = 3


def _read(data: bytes, encoding: str) -> str:
    """``data`` in the encoding; bytes that it leaves undefined are read as control characters, as programs do."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return "".join(_byte(b, encoding) for b in data)


def _byte(b: int, encoding: str) -> str:
    try:
        return bytes((b,)).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def _write(text: str, encoding: str) -> bytes | None:
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding != "cp1252":
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) < 0xA0:
                return None
            out.append(ord(c))
    return bytes(out)


def chains() -> list[tuple[str, ...]]:
    """All chains: (written, read) once, and UTF-8 read wrongly twice."""
    found = [("utf-8", read) for read in SINGLE]
    found += [(written, read) for written in SINGLE for read in SINGLE if written != read and {written, read} != {"cp1252", "latin-1"}]
    found += [(written, "utf-8") for written in ("latin-1", "mac_roman", "cp850")]
    found += [("utf-8", a, "utf-8", b) for a in ("cp1252", "latin-1", "mac_roman", "cp850", "cp437") for b in ("cp1252", "latin-1", "mac_roman", "cp850", "cp437")]
    return found


def garbled(word: str, chain: tuple[str, ...]) -> str | None:
    """``word`` after the chain; none where an encoding cannot write it."""
    for written, read in zip(chain[::2], chain[1::2]):
        data = _write(word, written)
        if data is None:
            return None
        word = data.decode("utf-8", "replace") if read == "utf-8" else _read(data, read)
    return word


def restored(token: str, chain: tuple[str, ...]) -> str | None:
    """The original of ``token`` under the chain; none where it loses or cannot have made it."""
    for written, read in reversed(list(zip(chain[::2], chain[1::2]))):
        data = _write(token, read)
        if data is None:
            return None
        try:
            token = data.decode(written)
        except UnicodeDecodeError:
            return None
    return token


class _Letters(dict):
    """Each character after a chain that garbles it alone: all but those that read bytes as UTF-8 at last."""

    def __init__(self, chain: tuple[str, ...]):
        self._chain = chain

    def __missing__(self, code: int) -> str:
        made = garbled(chr(code), self._chain)
        # a NUL says that an encoding cannot write the character
        self[code] = made = "\0" if made is None else made
        return made


def _garblers():
    """A function for each chain that gives a word after it, or none."""

    def alone(chain):
        letters = _Letters(chain)

        def garble(word: str) -> str | None:
            made = word.translate(letters)
            return None if "\0" in made else made

        return garble

    return [alone(chain) if chain[-1] != "utf-8" else (lambda word, chain=chain: garbled(word, chain)) for chain in chains()]


def wide_windows(word: str) -> dict[str, str]:
    """The windows of three characters that ``word`` gives when its bytes are read in pairs, either byte first, each with its piece of the word."""
    padded = f" {word} "
    data = _write(padded, "cp1252")
    if data is None:
        return {}
    found = {}
    for pairs in ([a | b << 8 for a, b in zip(data, data[1:])], [a << 8 | b for a, b in zip(data, data[1:])]):
        # no surrogates, which no decoder gives, and no letters of European alphabets
        letters = ["" if code <= 0x3FF or 0xD800 <= code < 0xE000 else chr(code) for code in pairs]
        for at, (a, b, c) in enumerate(zip(letters, letters[2:], letters[4:])):
            if a and b and c:
                found[a + b + c] = padded[at : at + 2 * WINDOW].strip()
    return found


def tokens_of(text: str) -> list[str]:
    """The runs of letters and non-ASCII characters with one of the latter, without outer punctuation."""
    return [stripped for token in TOKEN.findall(text) if not token.isascii() and (stripped := token.strip(EDGES))]


def _is_wide(token: str) -> bool:
    return len(token) >= 2 * WINDOW and 2 * len(_WIDE.findall(token)) > len(token)


def sightings(texts: DataFrame) -> DataFrame:
    """(token, id, n) of the texts (id, content), in one scan.

    Rows with a null id count plain tokens, added up in each task; with an
    ``n`` of 0 they are what stands between white space, in ASCII letters only.
    The others say that the text has the token, which is not plain; tokens of text read
    in pairs of bytes appear as windows.
    """

    def scan(batches):
        plain: Counter[str] = Counter()
        parts: set[str] = set()
        ordinary: dict[str, bool] = {}
        for batch in batches:
            if len(ordinary) > MOST_HELD:
                ordinary.clear()
            seen, ids = [], []
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.update(text.split())
                if text.isascii():
                    continue
                odd = set()
                for token in tokens_of(text):
                    usual = ordinary.get(token)
                    if usual is None:
                        usual = ordinary[token] = bool(PLAIN.fullmatch(token))
                    if usual:
                        plain[token] += 1
                    elif _is_wide(token):
                        odd.update(token[k : k + WINDOW] for k in range(len(token) - WINDOW + 1))
                    else:
                        odd.add(token)
                seen += odd
                ids += [row_id] * len(odd)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array(ids, pa.int64()), pa.array([1] * len(ids), pa.int64())], ["token", "id", "n"])
            if len(plain) > MOST_HELD:
                yield _plain_batch(plain)
                plain = Counter()
            if len(parts) > MOST_HELD:
                yield _plain_batch(_ascii_words(parts))
                parts = set()
        yield _plain_batch(plain)
        yield _plain_batch(_ascii_words(parts))

    return texts.mapInArrow(scan, "token string, id long, n long")


def _ascii_words(parts: set[str]) -> Counter[str]:
    """The parts that are words in ASCII letters, outer punctuation aside, none of them counted."""
    words = Counter()
    for part in parts:
        if part.isascii() and (word := part.strip(".,;:!?()[]{}'\"-/")).isalpha():
            words[word] = 0
    return words


def _plain_batch(plain: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(plain.keys(), pa.string()), pa.nulls(len(plain), pa.int64()), pa.array(plain.values(), pa.int64())], ["token", "id", "n"])


def distinctive(form: str, chain: tuple[str, ...]) -> bool:
    """Whether clean text cannot hold the form: it has a lost or control character, or letters of UTF-8 as several ones."""
    if any(c == "�" or "\x80" <= c < "\xa0" for c in form):
        return True
    odd = [c for c in form if not c.isascii()]
    # a word wholly in another alphabet may be one
    return chain[0] == "utf-8" and len(odd) > 1 and not (form.isalpha() and len(odd) == len(form) and any(c > "\u036f" for c in form))


#: The most bits of the filter.
MOST_BITS = 1 << 27


def filter_of(tokens: DataFrame) -> bytes:
    """A bit for each remainder of a token's (token) checksum; at most MOST_BITS."""
    size = min(MOST_BITS, 1 << (16 * tokens.count() + 64).bit_length())
    place = F.crc32(F.col("token").cast("binary")).cast("long") % size
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    found = tokens.select(F.floor(place / 64).cast("int").alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return bits.tobytes()


def may_hold(bits: bytes, token: str) -> bool:
    place = zlib.crc32(token.encode("utf-8", "surrogatepass")) & 8 * len(bits) - 1
    return bool(bits[place >> 3] >> (place & 7) & 1)


def forms(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, word, n, chain, steps, sure, chains): the garbled forms of the clean words (word, n) that are among the tokens (token), and few others.

    ``chain`` is the first of the ``chains`` that give the form; ``sure`` says that the form is distinctive.
    Of words in ASCII letters only the windows of pairs of bytes are forms.
    """
    all_chains = chains()
    shared = words.sparkSession.sparkContext.broadcast(filter_of(tokens))

    def garble(batches):
        garblers, bits = _garblers(), shared.value
        for batch in batches:
            # a few words at a time, as each has many forms
            for start in range(0, batch.num_rows, 1000):
                yield _forms_batch(batch.slice(start, 1000), garblers, all_chains, bits)

    return words.mapInArrow(garble, "token string, word string, n long, chain int, steps int, sure boolean, chains array<int>")


#: Forms of letters that only look alike, which need another repair.
_ALIKE = re.compile(f"[\\x00-\\x7f{''.join(TO_LATIN)}]*")


def _forms_batch(batch: pa.RecordBatch, garblers: list, all_chains: list[tuple[str, ...]], bits: bytes) -> pa.RecordBatch:
    rows = []
    # a window is told once for all the words that give it, with a piece of one of them
    windows: dict[str, str] = {}
    for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        made: dict[str, list[int]] = {}
        for number, garble in enumerate(() if word.isascii() else garblers):
            form = garble(word)
            # one character for one is too little evidence: an ellipsis is also a garbled letter
            if not form or form == word or len(form) < 2:
                continue
            made.setdefault(form, []).append(number)
        kept: dict[str, list[int]] = {}
        for form, numbers in made.items():
            stripped = form.strip(EDGES)
            token = stripped if len(stripped) > 1 else form
            if may_hold(bits, token) and not PLAIN.fullmatch(form) and not _ALIKE.fullmatch(form):
                kept.setdefault(token, []).extend(numbers)
        for form, numbers in kept.items():
            first = all_chains[min(numbers)]
            rows.append((form, word, n, min(numbers), len(first) // 2, distinctive(form, first), sorted(numbers)))
        windows.update((window, piece) for window, piece in wide_windows(word).items() if may_hold(bits, window))
    rows += [(window, piece, 1, -1, 1, True, [-1]) for window, piece in windows.items()]
    columns = list(zip(*rows)) or [()] * 7
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["token", "word", "n", "chain", "steps", "sure", "chains"])


def _usable(items: DataFrame, key: str, text: str) -> DataFrame:
    return items.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("long").alias("id"), F.col(text).alias("content"))


def matches(items: DataFrame, key: str, text: str, least: int = 1, ratio: int = 3) -> DataFrame:
    """(id, token, word, chain): the garbled tokens of each text and their originals.

    Every clean word counts that occurs ``least`` times. Unless the form is
    distinctive, it must also occur ``ratio`` times as often as texts have the
    garbled token, or another token of the text must come from the same chain.
    Of several originals the one with the fewest steps, then the most frequent,
    then the first by its letters counts.
    """
    seen = checkpointed(sightings(_usable(items, key, text)))
    words = seen.where("id is null").groupBy("token").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("n") == 0))
    odd = seen.where("id is not null").select("token", "id").distinct()
    known = checkpointed(odd.groupBy("token").agg(F.count("*").alias("texts")))
    possible = checkpointed(
        forms(words.select(F.col("token").alias("word"), "n"), known)
        .join(known, "token")
        .withColumn("sure", F.col("sure") | (F.col("n") >= F.lit(ratio) * F.col("texts")))
    )
    best = Window.partitionBy("token").orderBy("steps", F.desc("n"), "word")
    originals = possible.where("sure").withColumn("place", F.row_number().over(best)).where("place = 1").select("token", "word", "chain")
    found = odd.join(originals, "token").select("id", "token", "word", "chain")
    # the other forms' tokens: each chain's best original, in the texts where the chain has made two tokens at least
    doubtful = possible.where("not sure").join(originals, "token", "left_anti").select("token").distinct()
    if doubtful.isEmpty():
        return found
    of_chain = possible.select("token", "word", "n", "steps", F.explode("chains").alias("chain"))
    best_of_chain = Window.partitionBy("token", "chain").orderBy(F.desc("n"), "word")
    of_chain = of_chain.withColumn("place", F.row_number().over(best_of_chain)).where("place = 1").drop("place")
    near = odd.join(odd.join(doubtful, "token", "left_semi").select("id").distinct(), "id", "left_semi")
    met = near.join(of_chain, "token")
    confirmed = met.groupBy("id", "chain").agg(F.count("*").alias("tokens")).where("tokens > 1")
    best_here = Window.partitionBy("id", "token").orderBy(F.desc("tokens"), "steps", F.desc("n"), "chain")
    also = met.join(doubtful, "token", "left_semi").join(confirmed, ["id", "chain"]).withColumn("place", F.row_number().over(best_here)).where("place = 1")
    return found.unionByName(also.select("id", "token", "word", "chain"))


def affected(items: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(id): the texts with at least one garbled token."""
    return matches(items, key, text, **options).select("id").distinct()


def repaired(items: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(id, n_tokens, n_restored, restored_text) of the affected texts.

    Matched tokens become their originals. Other tokens that are not plain are
    read back by the chain of most of the text's matched tokens, if that gives
    a plain token; what cannot be told stays as it is. ``n_restored`` counts
    the replaced tokens, ``n_tokens`` all tokens that are not plain.
    """
    found = matches(items, key, text, **options)
    per_text = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", F.struct("word", "chain")))).alias("originals"))
    affected_texts = _usable(items, key, text).join(per_text, "id")
    all_chains = chains()

    def restore(batches):
        for batch in batches:
            rows = []
            for row_id, content, originals in zip(*(c.to_pylist() for c in batch.columns)):
                originals = {token: (x["word"], x["chain"]) for token, x in originals}
                usual = Counter(chain for _, chain in originals.values()).most_common(1)[0][0]
                counts = [0, 0]
                rows.append((row_id, *_restored_text(content, originals, all_chains, usual, counts)))
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "n_tokens", "n_restored", "restored_text"])

    return affected_texts.mapInArrow(restore, "id long, n_tokens int, n_restored int, restored_text string")


def _pairs(token: str, order: str) -> str:
    """The text whose bytes were read in pairs."""
    return _read(token.encode(order, "surrogatepass"), "cp1252")


def _restored_text(content: str, originals: dict, all_chains: list, usual: int, counts: list[int]) -> tuple[int, int, str]:
    def replace(match: re.Match) -> str:
        whole = match.group()
        token = whole.strip(EDGES)
        if token.isascii() or PLAIN.fullmatch(token):
            return whole
        counts[0] += 1
        if _is_wide(token):
            windows = [token[k : k + WINDOW] for k in range(len(token) - WINDOW + 1)]
            known = [(window, originals[window][0]) for window in windows if window in originals]
            # the order of bytes in which most known windows are the pieces of words that they stand for
            agree = {order: sum(_pairs(window, order).strip() == piece for window, piece in known) for order in ("utf-16-le", "utf-16-be")}
            order = max(agree, key=agree.get)
            if agree[order]:
                counts[1] += 1
                return whole.replace(token, _pairs(token, order))
            return whole
        original = originals[token][0] if token in originals else None
        if original is None and usual >= 0:
            for chain in (all_chains[usual], *(c for c in all_chains if c[0] == all_chains[usual][0])):
                original = restored(whole, chain)
                if original is not None and all(PLAIN.fullmatch(t.strip(EDGES)) for t in TOKEN.findall(original) if t.strip(EDGES)):
                    counts[1] += 1
                    return original
            original = None
        if original is None:
            return whole
        counts[1] += 1
        return whole.replace(token, original)

    text = TOKEN.sub(replace, content)
    return counts[0], counts[1], text
