"""Noise in text from scanned pages: cut words, misread letters, running headers, page numbers.

One scan of the texts gives, for each task, the counts of its words and what
stands at its line ends; everything that needs the corpus is joined in SQL.

*Misread letters* are found by anagram hashes. The hash of a word is the sum
of the fifth powers of its code points, so exchanging one string of letters
for another changes it by a difference that depends on the two strings only.
Sums are taken modulo a prime below 2^61. Words that are rare enough beside
the most frequent one are moved by the differences of all confusions that they could
hold and joined on the hash with the frequent words; a candidate that one
confusion really turns into the frequent word counts, the most frequent first.
A word that is cut over a line end is looked up as it is once joined.

*Cut words* end a line with a hyphen or not sign. The corpus decides: a word
that it knows better with the hyphen breaks at its own.

*Headers and page numbers* are edge lines. A line is foreign where the text
before it does not end a sentence and the line itself, unlike wrapped text,
was left with room for the next word. What is foreign there for certain, as a
line with its digits levelled, is foreign elsewhere in the same file; a form of
line, its names masked, that is certain in several files is foreign elsewhere
in all. Numbers beside such lines or in the usual forms are page numbers, unless they stand in
a list of figures. A lone number at a text's edge may be the rest of such a list: it is
none if what follows it follows lists of figures elsewhere.

A word is rare in a window, the texts of one batch, if it occurs at most
``RARE`` times in it; the scan keeps the ids of its texts. A misread word may
be more frequent in a window, such as one of a header on every page: once the
misread words are known, the texts of those windows are read again for it.
Nulls and empty texts give no rows; texts of one line have no line ends. Rows
repeated with their id count as often as they occur in counts and once in results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from docketlake.operators.units import bit_filter
from docketlake.session import checkpointed

#: What is read, and what was printed.
CONFUSIONS = "0 o|0 O|1 l|1 i|1 I|5 s|5 S|6 b|6 G|8 B|9 g|2 z|@ a|( c|c e|f t|ii u|u n|rn m|cl d|d cl|b h|h li|n ri|g q|ä ã|ö õ|vv w|iii m"
PAIRS = [tuple(pair.split()) for pair in CONFUSIONS.split("|")]
RARE = 50
#: Places of the filter by which the second reading leaves words out.
PLACES = 1 << 20

_WORD = re.compile(r"[\w@](?:[\w@(-]*[\w@])?")
_TAIL = re.compile(r"[\w@(]+$")
_NUMBER = re.compile(r"\d{1,4}|[ivxlcdm]{1,9}")
_PAGE = re.compile(
    r"(?:[-–—]\s*\d{1,4}\s*[-–—]|\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)"
    r"|(?:p|pp|p[áa]gs?|p[áa]gina|page|folhas?|fls?|f|[Pp]\wgina)\.?\s*\d{1,4}\s*[vV]?(?:\s*(?:de|/|of)\s*\d{1,4})?"
    r"|\d{1,3}\s*/\s*\d{1,3})",
    re.IGNORECASE,
)
_ENDED = re.compile(r"[.!?:…][\"”»')\]]*$")
_SENTENCE = re.compile(r"[;:!?]\s|(?:\d|[^\W\d_]{3})[.]\s")
_APART = re.compile(r"(?: {3,}|\t+) *")
_LEVEL = str.maketrans({"0": "o", "@": "a", "1": "l", "5": "s", "9": "g", "6": "b", "ä": "ã"})


def is_page(text: str) -> bool:
    """Whether a whole line is a page or folio number in a usual form; a bare number is none yet."""
    match = _PAGE.fullmatch(text)
    if match and "/" in text and text[:1].isdigit():
        first, last = (int(x) for x in re.findall(r"\d+", text)[:2])
        return first <= last
    return bool(match)


def levelled(line: str) -> str:
    """A line as it is compared with others: digits level, misreadings and case folded."""
    words = []
    for word in line.split():
        letters = sum(c.isalpha() for c in word)
        words.append(word.translate(_LEVEL).lower() if letters > 1 else re.sub(r"\d", "9", word))
    text = " ".join(words)
    for read, meant in (("rn", "m"), ("cl", "d"), ("ii", "u"), ("ri", "n"), ("li", "h")):
        text = text.replace(read, meant)
    return text.replace("i", "l").replace("e", "c").replace("t", "f").replace("q", "g").replace("u", "n").replace("b", "h")


def shape(line: str) -> str:
    """A line with its names and numbers masked; headers of one form differ in little else."""
    words = []
    for word in line.split():
        core = word.translate(_LEVEL) if sum(c.isalpha() for c in word) > 1 else word
        if core[0].isupper() and not core.isupper():
            words.append("N" + ("," if word.endswith(",") else ""))
        else:
            words.append(re.sub(r"\d+", "9", word if core is word else core.lower()))
    return re.sub(r"N(?: (?:d[aeo]s? )?N)+", "N", " ".join(words))


class Layout:
    """The lines of a text, told apart.

    ``heads`` and ``pages`` are the numbers of foreign lines that are certain,
    ``doubtful`` those of lines that other places may show to be headers, and
    ``cuts`` (left, gap, mark, right, line, next line) the words cut at line ends.
    ``lone`` has the numbers at the text's edge, each with the words after it, and
    ``followers`` the words after lists of figures.
    """

    def __init__(self, text: str):
        self.lines = re.split(r"\r?\n", text)
        self.heads: dict[int, str] = {}
        self.pages: set[int] = set()
        self.lone: dict[int, str] = {}
        self.followers: set[str] = set()
        self.doubtful: dict[int, str] = {}
        self.cuts: list[tuple[str, str, str, str, int, int]] = []
        stripped = [line.strip() for line in self.lines]
        self.stripped = stripped
        if len(stripped) < 2:
            return
        width = self._width(stripped)
        kinds = self._kinds(stripped, width)
        start = 0
        while start < len(stripped):
            if kinds[start] == "text":
                start += 1
                continue
            end = start
            while end < len(stripped) and kinds[end] != "text":
                end += 1
            self._block(start, end, kinds)
            start = end
        body = [at for at, kind in enumerate(kinds) if kind == "text"]
        for before, at, after in zip(body, body[1:], body[2:]):
            # a header as long as the text's lines
            if self._stands_alone(stripped[at]) and not _ENDED.search(stripped[before]) and stripped[after][:1].islower():
                self.doubtful[at] = levelled(stripped[at])
        self._find_cuts(kinds)

    @staticmethod
    def _width(stripped: list[str]) -> int:
        """The width to which the text is wrapped: what most of its longer lines reach."""
        sizes = sorted((len(line) for line in stripped if len(line) > 20), reverse=True)
        return sizes[len(sizes) // 4] if len(sizes) > 3 else 0

    @staticmethod
    def _beside(line: str) -> str | None:
        """What stands far beside a page number in the same line."""
        if len(line) > 160 or "   " not in line and "\t" not in line:
            return None
        parts = _APART.split(line)
        for number, head in ((parts[-1], parts[0]), (parts[0], parts[-1])):
            if len(parts) == 2 and (is_page(number) or _NUMBER.fullmatch(number)):
                return head
        return None

    @staticmethod
    def _stands_alone(line: str) -> bool:
        """Whether a line could be a header by itself: it begins like one and ends no sentence, nor holds an end."""
        begins = line[0].isupper() or line[0].isdigit()
        return len(line) <= 80 and begins and line[-1] not in ",;-¬" and not _ENDED.search(line) and not _SENTENCE.search(line)

    def _kinds(self, stripped: list[str], width: int) -> list[str]:
        kinds = []
        for at, line in enumerate(stripped):
            beside = self._beside(line)
            if not line:
                kinds.append("blank")
            elif is_page(line):
                kinds.append("page")
            elif _NUMBER.fullmatch(line):
                kinds.append("number")
            elif beside:
                kinds.append("beside")
            else:
                following = next((x for x in stripped[at + 1 :] if x), "")
                room = width - len(line) - 1 - len(following.split(" ")[0])
                kinds.append("short" if self._stands_alone(line) and (not following or room >= 4) else "text")
        return kinds

    def _block(self, start: int, end: int, kinds: list[str]) -> None:
        """Tells the lines between two lines of text apart."""
        before, after = self.stripped[start - 1] if start else "", self.stripped[end] if end < len(kinds) else ""
        interrupts = bool(before and after) and not _ENDED.search(before)
        found = range(start, end)
        numbers = [i for i in found if kinds[i] == "number"]
        marked = any(kinds[i] in ("page", "beside") for i in found)
        for i in found:
            if kinds[i] == "page":
                self.pages.add(i)
            elif kinds[i] == "beside":
                self.pages.add(i)
                self.heads[i] = levelled(self._beside(self.stripped[i]))
            elif kinds[i] == "short":
                if interrupts or marked:
                    self.heads[i] = levelled(self.stripped[i])
                else:
                    self.doubtful[i] = levelled(self.stripped[i])
        figures = before.endswith(":") or len(numbers) > 2
        follower = " ".join(after.split()[:2]).lower()
        if figures and numbers and follower:
            self.followers.add(follower)
        values = [int(self.stripped[i]) for i in numbers if self.stripped[i].isdigit()]
        apart = len(values) == 2 and abs(values[0] - values[1]) != 1
        edge = not before or not after
        if numbers and not figures and not apart and not (edge and not marked and len(numbers) > 1):
            for i in numbers:
                if interrupts or not edge or marked or any(kinds[j] == "short" for j in found):
                    self.pages.add(i)
                elif len(self.stripped[i]) <= 3:
                    self.lone[i] = follower

    def _find_cuts(self, kinds: list[str]) -> None:
        for at, line in enumerate(self.stripped):
            if kinds[at] not in ("text", "short") or at in self.heads:
                continue
            mark = next((m for m in ("--", "-", "¬", "\u00ad") if line.endswith(m)), "")
            body = line[: -len(mark)] if mark else ""
            gap = " " if body.endswith(" ") else ""
            tail = _TAIL.search(body[-60:].rstrip(" ")) if body else None
            if not tail or body.endswith("  ") or not any(c.isalpha() for c in tail.group()):
                continue
            left = tail.group().lstrip("(")
            to = next((i for i in range(at + 1, len(kinds)) if kinds[i] == "text" or kinds[i] == "short" and i not in self.heads), None)
            if to is None:
                continue
            right = re.match(r"[\w@(]+", self.stripped[to])
            if right and (right.group()[0].islower() or right.group()[0] in "@(0123456789" or left.isupper()):
                self.cuts.append((left, gap, mark, right.group(), at, to))

    def words(self) -> list[str]:
        """All words but the parts of cut ones."""
        if not self.cuts:
            return _WORD.findall("\n".join(self.stripped))
        lines = list(self.stripped)
        for left, gap, mark, right, at, to in self.cuts:
            lines[at] = lines[at][: -len(left + gap + mark)] if lines[at].endswith(left + gap + mark) else lines[at]
            lines[to] = lines[to][len(right) :]
        return _WORD.findall("\n".join(lines))


_ROW = "kind string, key string, n long, ids array<long>, id long, file string, left string, right string, mark string"
_NAMES = [part.split()[0] for part in _ROW.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]


def _usable(items: DataFrame, key: str, text: str, file: str) -> DataFrame:
    return items.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).cast("long").alias("id"), F.col(text).alias("content"), F.col(file).alias("file"))


def _words_of(content: str) -> list[str]:
    return Layout(content).words() if "\n" in content else _WORD.findall(content)


def observed(texts: DataFrame) -> DataFrame:
    """What one scan of the texts (id, content, file) sees, as rows of ``kind``.

    'word': the word ``key`` occurs ``n`` times in a window, in the texts
    ``ids`` where it is rare there; else ``id`` names the window, of which
    'window' gives the ``ids`` of all texts. 'cut': ``left``, ``mark`` and ``right`` at
    a line end of ``id``. 'lone': a number at an edge of ``id`` before the words ``key``;
    'follower': words ``key`` after a list of figures. 'page', 'header' and 'doubtful': such a line, levelled
    as ``key`` and masked as ``left``, in ``id`` of ``file``.
    """

    def scan(batches):
        for batch in batches:
            counts: Counter[str] = Counter()
            where: dict[str, set[int]] = defaultdict(set)
            rows, said = [], []
            for row_id, content, file in zip(*(c.to_pylist() for c in batch.columns)):
                if "\n" in content:
                    layout = Layout(content)
                    words = layout.words()
                    rows += [("cut", None, 1, None, row_id, file, left, right, gap + mark) for left, gap, mark, right, _, _ in layout.cuts]
                    for kind, found in (("header", layout.heads), ("doubtful", layout.doubtful)):
                        rows += [(kind, line, 1, None, row_id, file, shape(layout.stripped[at]), None, None) for at, line in found.items()]
                    if layout.pages:
                        rows.append(("page", None, 1, None, row_id, file, None, None, None))
                    for kind, found in (("lone", layout.lone.values()), ("follower", layout.followers)):
                        rows += [(kind, key, 1, None, row_id, file, None, None, None) for key in set(found)]
                else:
                    words = _WORD.findall(content)
                counts.update(words)
                said.append((row_id, words))
            if not said:
                continue
            window = said[0][0]
            rare = {word for word, n in counts.items() if n <= RARE}
            for row_id, words in said:
                for word in rare.intersection(words):
                    where[word].add(row_id)
            rows += [("word", word, n, *((sorted(where[word]), None) if word in rare else (None, window)), None, None, None, None) for word, n in counts.items()]
            rows.append(("window", None, 1, sorted({row_id for row_id, _ in said}), window, None, None, None, None))
            columns = list(zip(*rows)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)

    return texts.mapInArrow(scan, _ROW)


#: The hashes' modulus, a prime; code points count modulo 2^11, so that no fifth power leaves 64 bits.
MODULUS = (1 << 61) - 1


def anagram_hash(word):
    """The sum of the fifth powers of a word's code points."""

    def fifth(c):
        code = F.pmod(F.ascii(c).cast("long"), F.lit(2048))
        return code * code * code * code * code

    return F.aggregate(F.transform(F.split(word, ""), fifth), F.lit(0).cast("long"), lambda total, x: F.pmod(total + x, F.lit(MODULUS)))


def _difference(read: str, meant: str) -> int:
    return sum(ord(c) ** 5 for c in meant) - sum(ord(c) ** 5 for c in read)


def corrections(words: DataFrame, ratio: int = 15, least: int = 5, others: DataFrame | None = None, certain_ratio: int = 3) -> DataFrame:
    """(word, meant) of the misread words among (word, n) and ``others``, which are only looked up.

    The frequent word must occur ``least`` times, and ``ratio`` times as often
    as the rare one, or ``certain_ratio`` times where only digits and signs
    inside a word of three letters were misread. One confusion or two turn the rare word into it.
    """
    looked_up = words if others is None else words.unionByName(others.join(words.select("word"), "word", "left_anti"))
    most = words.agg(F.max("n")).first()[0] or 0
    hashed = checkpointed(looked_up.withColumn("hash", anagram_hash("word")))
    known = hashed if others is None else hashed.join(words.select("word"), "word", "left_semi")
    frequent = known.where((F.col("n") >= least) & F.col("word").rlike(r"^\p{L}[\p{L}-]*\p{L}$")).select(F.col("word").alias("meant"), F.col("n").alias("often"), F.col("hash").alias("key"))
    # where a letter stands for another letter, a word of three letters is too short to tell
    rare = hashed.where((F.col("n") * certain_ratio <= most) & ((F.length("word") >= 4) | F.col("word").rlike(r"^(?=.*\p{L}.*)(?=.*[0-9@(ä]).{2,3}$")))
    pairs = F.array(*(F.struct(F.lit(read).alias("read"), F.lit(meant).alias("meant"), F.lit(_difference(read, meant)).alias("move")) for read, meant in PAIRS))
    move = lambda a, b: F.struct(a["read"].alias("read_a"), a["meant"].alias("meant_a"), b["read"].alias("read_b"), b["meant"].alias("meant_b"), (a["move"] + b["move"]).alias("move"))
    nothing = F.struct(F.lit("").alias("read"), F.lit("").alias("meant"), F.lit(0).cast("long").alias("move"))
    present = rare.withColumn("present", F.filter(pairs, lambda p: F.contains("word", p["read"])))
    double = F.flatten(F.transform("present", lambda a, i: F.transform(F.slice("present", i + 1, F.size("present")), lambda b: move(a, b))))
    moved = present.select("word", "n", "hash", F.explode(F.concat(F.transform("present", lambda a: move(a, nothing)), double)).alias("m")).select("word", "n", "hash", "m.*")
    met = moved.select("word", "n", "read_a", "meant_a", "read_b", "meant_b", F.pmod(F.col("hash") + F.col("move"), F.lit(MODULUS)).alias("key"))
    # few moved words have the hash of a frequent one: a filter of bounded size keeps the others from the shuffle
    frequent = checkpointed(frequent)
    bits, kept = bit_filter(frequent, "key")
    met = met.join(F.broadcast(bits), kept).drop("bits").join(frequent, "key")
    certain = F.col("read_a").rlike("^[0-9@(]$") & F.col("read_b").rlike("^[0-9@(]?$") & F.col("word").rlike(r"(\p{L}.*){3}")
    met = met.where((F.col("often") >= F.when(certain, certain_ratio).otherwise(ratio) * F.col("n")) & (F.col("word") != F.col("meant")))
    once = F.expr("exists(sequence(1, length(word)), i -> substr(word, i, length(read_a)) = read_a and concat(left(word, i - 1), meant_a, substr(word, i + length(read_a))) = meant)")
    twice = F.expr(
        "exists(sequence(1, length(word)), i -> substr(word, i, length(read_a)) = read_a and exists(sequence(1, length(word) + 1), j -> "
        "substr(concat(left(word, i - 1), meant_a, substr(word, i + length(read_a))), j, length(read_b)) = read_b and "
        "concat(left(concat(left(word, i - 1), meant_a, substr(word, i + length(read_a))), j - 1), meant_b, "
        "substr(concat(left(word, i - 1), meant_a, substr(word, i + length(read_a))), j + length(read_b))) = meant))"
    )
    ranked = Window.partitionBy("word").orderBy(F.length("read_b"), F.desc("often"), "meant")
    good = met.where(F.when(F.col("read_b") == "", once).otherwise(twice))
    return good.withColumn("place", F.row_number().over(ranked)).where("place = 1").select("word", "meant")


class Evidence:
    """What the corpus says about the scan noise of its texts, ready to be joined."""

    def __init__(self, items: DataFrame, key: str, text: str, file: str, ratio: int = 15):
        self.texts = _usable(items, key, text, file)
        seen = checkpointed(observed(self.texts))
        words = seen.where("kind = 'word'")
        self.counts = checkpointed(words.groupBy(F.col("key").alias("word")).agg(F.sum("n").alias("n")))
        self.cuts = checkpointed(self._cuts(seen.where("kind = 'cut'")))
        joined = self.cuts.select("id", F.concat("left", "right").alias("word")).distinct()
        self.corrections = checkpointed(corrections(self.counts, ratio, others=joined.groupBy("word").agg(F.count("*").alias("n"))))
        known = words.select(F.col("key").alias("word"), "ids", "id").join(self.corrections, "word")
        rare = known.where("ids is not null").select("word", "meant", F.explode("ids").alias("id"))
        crowded = checkpointed(known.where("ids is null").select("word", "meant", F.col("id").alias("window")).distinct())
        of_cuts = joined.join(self.corrections, "word").select("word", "meant", "id")
        self.misread = rare.unionAll(self._reread(crowded, seen.where("kind = 'window'"))).unionAll(of_cuts).distinct()
        followers = seen.where("kind = 'follower'").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        # (id, follower) of the lone numbers that no list of figures explains
        self.lone = seen.where("kind = 'lone'").select("id", "key").join(followers, "key", "left_anti").distinct()
        self.pages = seen.where("kind = 'page'").select("id").unionAll(self.lone.select("id")).distinct()
        lines = seen.select("kind", "id", "file", F.col("key").alias("line"), F.col("left").alias("shape"))
        certain, doubtful = (lines.where(F.col("kind") == kind).distinct() for kind in ("header", "doubtful"))
        known = certain.select("file", "line").distinct()
        # a form that certain headers of several files have, unless it is only names
        forms = certain.where(r"shape rlike '[^N ]'").groupBy("shape").agg(F.countDistinct("file").alias("files")).where("files >= 3")
        again = doubtful.join(known, ["file", "line"], "left_semi").unionByName(doubtful.join(forms, "shape", "left_semi"))
        self.headers = certain.unionByName(again).select("id", "line").distinct()

    def _reread(self, crowded: DataFrame, windows: DataFrame) -> DataFrame:
        """(word, meant, id) of all texts, in the windows of the misread words ``crowded`` (word, meant, window), that have such a word."""
        meant = crowded.select("word", "meant").distinct()
        # at most PLACES numbers come to the driver; the filter loses no word, and the join drops what it lets through
        places = {r[0] for r in meant.select(F.crc32(F.col("word").cast("binary")) % PLACES).distinct().collect()}
        if not places:
            return meant.withColumn("id", F.lit(None).cast("long")).limit(0)
        ids = windows.join(crowded.select(F.col("window").alias("id")).distinct(), "id", "left_semi").select(F.explode("ids").alias("id")).distinct()

        def scan(batches):
            for batch in batches:
                found, where = [], []
                for row_id, content in zip(*(c.to_pylist() for c in batch.columns)):
                    held = [word for word in set(_words_of(content)) if zlib.crc32(word.encode()) % PLACES in places]
                    found += held
                    where += [row_id] * len(held)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(where, pa.int64())], ["word", "id"])

        again = self.texts.join(ids, "id", "left_semi").select("id", "content").mapInArrow(scan, "word string, id long")
        return again.join(meant, "word").select("word", "meant", "id")

    def _cuts(self, cuts: DataFrame) -> DataFrame:
        """(id, left, right, mark) of the words that have no hyphen of their own."""
        cuts = cuts.select("id", "left", "right", "mark").withColumn("joined", F.concat("left", "right")).withColumn("hyphened", F.concat_ws("-", "left", "right"))
        counts = self.counts.select("word", "n")
        # how often compounds end in a part: 'se', 'feira'
        tails = counts.where("instr(word, '-') > 0").groupBy(F.substring_index("word", "-", -1).alias("right")).agg(F.sum("n").alias("tail_n"))
        judged = (
            cuts.join(counts.select(F.col("word").alias("joined"), F.col("n").alias("joined_n")), "joined", "left")
            .join(counts.select(F.col("word").alias("hyphened"), F.col("n").alias("hyphened_n")), "hyphened", "left")
            .join(tails, "right", "left")
        )
        joined, hyphened, tail = (F.coalesce(c, F.lit(0)) for c in ("joined_n", "hyphened_n", "tail_n"))
        own = F.when(joined + hyphened > 0, hyphened >= joined).otherwise(tail >= 20)
        return judged.where((F.col("mark") != "-") & (joined >= hyphened) | (F.col("mark") == "-") & ~own).select("id", "left", "right", "mark")

    def cases(self) -> DataFrame:
        """(id, kind), one row for each text and kind of noise in it."""
        found = (
            self.cuts.select("id", F.lit("hyphen").alias("kind"))
            .unionAll(self.misread.select("id", F.lit("misread").alias("kind")))
            .unionAll(self.headers.select("id", F.lit("header").alias("kind")))
            .unionAll(self.pages.select("id", F.lit("page_number").alias("kind")))
        )
        return found.distinct()


def repaired(items: DataFrame, key: str, text: str, file: str, ratio: int = 15) -> DataFrame:
    """(id, clean_text) of the texts with scan noise: foreign lines gone, cut words joined, misread ones corrected.

    Lines that end no paragraph are joined; paragraphs are parted by a blank line.
    """
    evidence = Evidence(items, key, text, file, ratio)
    of_text = {
        "fixes": evidence.misread.groupBy("id").agg(F.collect_list(F.struct("word", "meant")).alias("fixes")),
        "joins": evidence.cuts.groupBy("id").agg(F.collect_set(F.struct("left", "mark", "right")).alias("joins")),
        "foreign": evidence.headers.groupBy("id").agg(F.collect_set("line").alias("foreign")),
        "lone": evidence.lone.groupBy("id").agg(F.collect_set("key").alias("lone")),
    }
    noisy = evidence.texts.join(evidence.cases().select("id").distinct(), "id", "left_semi").select("id", "content")
    for found in of_text.values():
        noisy = noisy.join(found, "id", "left")

    def mend(batches):
        for batch in batches:
            ids, *texts = (c.to_pylist() for c in batch.columns)
            made = [mended(*row) for row in zip(*texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made, pa.string())], ["id", "clean_text"])

    return noisy.select("id", "content", *of_text).mapInArrow(mend, "id long, clean_text string")


def mended(content: str, fixes: list | None, joins: list | None, foreign: list | None, lone: list | None = None) -> str:
    layout = Layout(content)
    pages = layout.pages | {i for i, follower in layout.lone.items() if follower in set(lone or ())}
    heads = {i for i, line in {**layout.doubtful, **layout.heads}.items() if i in layout.heads or line in set(foreign or ())}
    lines = list(layout.stripped)
    known = {(j["left"], j["mark"], j["right"]) for j in joins or ()}
    glued = set()
    for left, gap, mark, right, at, to in layout.cuts:
        lines[at] = lines[at][: len(lines[at].rstrip()) - len(gap + mark)]
        if (left, gap + mark, right) not in known:
            lines[at] += "-"
        glued.add(at)
    paragraphs, now, glue, blank = [], "", False, False
    for at, line in enumerate(lines):
        if at in heads or at in pages:
            continue
        if not line:
            blank = True
            continue
        # a blank line parts paragraphs only where a sentence ended: others came with a page's edge
        if now and blank and _ENDED.search(now) and not glue:
            paragraphs.append(now)
            now = line
        else:
            now = now + line if glue or not now else f"{now} {line}"
        glue, blank = at in glued, False
    text = "\n\n".join([*paragraphs, now] if now else paragraphs)
    table = {f["word"]: f["meant"] for f in fixes or ()}
    return _WORD.sub(lambda m: table.get(m.group(), m.group()), text) if table else text
