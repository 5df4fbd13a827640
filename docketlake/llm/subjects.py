"""The subject areas of documents, by weighted terms and a multi-pattern automaton.

A few curated word stems of each subject, in the corpus's languages, are the
start. The words that stand beside them in sentences get weights: the share of
a word's sentences that belong to a subject, times the word's rarity. All
documents count towards the weights, each task adding up before it shuffles.

A document is then read by an Aho-Corasick automaton of all weighted terms.
A sentence's evidence for a subject is the sum of its terms' weights over the
square root of its number of words; the sentence is about the best subject if
its evidence reaches a threshold, which is calibrated on all hand labels. A
document treats every subject that enough of its sentences are about.

Learned terms must occur in at least ``least_share`` of all sentences, so the
table of terms that every worker holds has a bound that the corpus's size does
not move: at most words per sentence / least_share. The curated stems are
terms themselves, whatever their share or length; they weigh where no learned
term stands at the same word.

Subjects are the codes of a table. One without curated stems gets the words
of its own title and description that no other subject has.

Letters are compared without accents; letters that Latin-1 cannot write, once
composed and brought to their plain form, count as spaces. Null and blank texts have no subjects. Labels that are null or name no known
subject are ignored, of those left a document's majority counts. Rows repeated
with their id count as often as they occur in weights, and once in results.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docketlake.session import checkpointed

#: Curated word stems by subject, without accents; a trailing dot ends the word.
STEMS = {
    "health": "hospital cirurg medica medico. pacient patient anestes biops vacin vaccin quimioter oncolog farmac prontuario hemograma diagnos transfus enfermei internac surgery surgeon nurse",
    "labour": "empregad salari sindicat jornada insalubr assedio trabajador preaviso overtime wage. wages worker empleador rescisao. convencao union. turno despido employ",
    "family": "genitor divorc alimentic alimony paternidade heranca herencia inherit conjug conyug viuv viuda custod partilha curatela matrimon. crianca child testamento adocao adopcion adoption",
    "consumer": "fornecedor mercadoria reembols refund fatura. inadimpl enganos estorno garantia warranty loja tienda shop. compradora boleto seller proveedor vendedor",
    "tax": "imposto impuesto tax. taxes tribut fisco. fiscal. contribu autuacao isencao exencion exempt aliquota alicuota arbitramento levy rentas. debito.",
    "environment": "ambiental environment florest forest fauna. efluente effluent aterro. minera mineradora queimada desmat rejeito agrotoxic vegetac vegetation polluti nascente humedal wetland ciliar.",
    "traffic": "transito. veicul vehicul vehicle rodovia motorista conductor driver. pedagio peaje toll. ciclista cyclist colis collision caminhao camion truck onibus habilitac pedestre velocidad",
    "software": "software programador programmer repositor servidor server. firmware algoritm senha password criptograf aplicativ desenvolvedor developer autenticac usuarios informatic database licenciada",
    "sport": "jogador jugador player. goleiro arquero goalkeeper clube. club. atlet athlet campeon champion estadio. stadium treinador entrenador coach. torcida maratona marathon federacao antidopagem",
    "education": "aluno. alumn student. professor profesor teacher escola. escuela school universidad university matricula docente creche pedagogic bolsista beca. scholarship semestre. gabarito diploma",
}
_SENTENCE_END = re.compile(r"[.!?…\n][\"”»')\]]*\s+")
_INITIAL = re.compile(r"(?:^|[^\w])(?:[^\W\d_]|[Aa]rt|[Nn][º°o]?|fls?|[Ss]r|[Ss]ra|[Dd]r|[Dd]ra|inc)$")


def _fold_table() -> bytes:
    """For each Latin-1 character its lower-case letter without accents, for the others a space."""
    bases = (unicodedata.normalize("NFD", chr(code).lower())[:1] for code in range(256))
    return bytes(ord(base) if base.isalnum() and ord(base) < 256 else 32 for base in bases)


_FOLD_TABLE = _fold_table()


class _Plain(dict):
    """Code points beyond Latin-1 to their plain Latin-1 letter; others stay."""

    def __missing__(self, code: int) -> int:
        base = unicodedata.normalize("NFKD", chr(code))[:1]
        self[code] = plain = ord(base) if code > 255 and base.isalpha() and ord(base) < 256 else code
        return plain


_PLAIN = _Plain()


def prepared(text: str) -> str:
    """``text`` with its letters composed and brought to their plain form; texts in Latin-1 stay."""
    try:
        text.encode("latin-1")
        return text
    except UnicodeEncodeError:
        return unicodedata.normalize("NFC", text).translate(_PLAIN)


def folded(text: str) -> str:
    """Lower-case letters without accents, other characters as spaces; one character for one."""
    return text.encode("latin-1", "replace").translate(_FOLD_TABLE).decode("latin-1")


def _lower_word(raw: str) -> str:
    """A word of at least four letters in lower case, its punctuation and accents gone; '' for names, numbers and others."""
    word = raw.strip(".,;:!?…\"“”«»'()[]¿¡–—")
    return folded(word) if len(word) > 3 and word.isalpha() and word.islower() else ""


def sentence_starts(text: str) -> list[int]:
    """Where the sentences begin; an initial or a short abbreviation ends none."""
    starts, size = [0], len(text)
    for match in _SENTENCE_END.finditer(text):
        at, end = match.span()
        if text[at] == "\n":
            if "\n" in text[at + 1 : end]:
                starts.append(end)
        elif end < size and not text[end].islower() and (text[at] != "." or not _INITIAL.search(text, max(0, at - 6), at)):
            starts.append(end)
    return starts


#: Marks phrases of held-out text among the subjects.
HELD_OUT = "held out"
_BUILT: dict[str, object] = {}


def _built(key: str, make):
    """What ``make`` made in this worker process for the key."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]


def _automaton(terms: dict[str, object]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for term, value in terms.items():
        made.add_word(term, (len(term), value))
    made.make_automaton()
    return made


def stems_of(subjects: DataFrame | None) -> dict[str, str]:
    """' stem' to its subject; the leading space is a word's start, one at the end the word's.

    ``subjects`` (subject, title, description) names the subjects, which are
    few by nature: more than 10,000 are an error. Without it, all curated ones count.
    """
    if subjects is None:
        curated, described = STEMS, {}
    else:
        rows = subjects.where("subject is not null").select(F.lower(F.trim("subject")).alias("subject"), "title", "description").distinct().limit(10_001).collect()
        if len(rows) > 10_000:
            raise ValueError("more than 10000 subjects")
        named = {r["subject"] for r in rows}
        curated = {name: stems for name, stems in STEMS.items() if name in named}
        described = {}
        for r in rows:
            if r["subject"] not in STEMS:
                described.setdefault(r["subject"], set()).update(w for w in folded(prepared(f"{r['title'] or ''} {r['description'] or ''}")).split() if len(w) > 4)
    found = {f" {stem.replace('.', ' ')}": name for name, stems in curated.items() for stem in stems.split()}
    owners = Counter(word for words in described.values() for word in words)
    for name, words in sorted(described.items()):
        found |= {f" {word} ": name for word in words if owners[word] == 1 and f" {word} " not in found}
    return found


def _phrases(text: str) -> list[tuple[int, str]]:
    """The sequences of five words of a prepared text as they stand in its folded form, with where they begin."""
    plain = f" {folded(text)} "
    places = [m.span() for m in re.finditer(r"\S+", plain)]
    return [(a[0] - 1, plain[a[0] - 1 : b[1] + 1]) for a, b in zip(places, places[4:])]


def held_out_phrases(items: DataFrame, most: int) -> list[str] | None:
    """All sequences of five words of the held-out items; none if there are more than ``most``, repeated ones counted."""
    usable = items.where("text is not null").select("text")
    total = usable.agg(F.sum(F.greatest(F.size(F.split("text", r"[^\p{L}\p{N}]+")) - 4, F.lit(0)))).first()[0] or 0
    if total > most:
        return None
    return sorted({phrase for (text,) in usable.toLocalIterator() for _, phrase in _phrases(prepared(text))})


def held_out_sentences(texts: DataFrame, items: DataFrame) -> DataFrame:
    """``texts`` (id, content, blocked) with the numbers of the sentences that hold five words in a row of an item.

    For items of any number: their sequences are joined with those of the
    texts that a filter of bounded size lets pass.
    """
    from docketlake.llm.encodings import filter_of, may_hold

    def of_items(batches):
        for batch in batches:
            found = {phrase for text in batch.column(0).to_pylist() for _, phrase in _phrases(prepared(text))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["token"])

    wanted = checkpointed(items.where("text is not null").select("text").mapInArrow(of_items, "token string").distinct())
    shared = texts.sparkSession.sparkContext.broadcast(filter_of(wanted))

    def of_texts(batches):
        bits = shared.value
        for batch in batches:
            rows = []
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = prepared(text)
                starts = sentence_starts(text)
                rows += {(phrase, row_id, bisect_right(starts, max(0, at)) - 1) for at, phrase in _phrases(text) if may_hold(bits, phrase)}
            columns = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32()))], ["token", "id", "sentence"])

    met = texts.select("id", "content").mapInArrow(of_texts, "token string, id long, sentence int").join(wanted, "token")
    blocked = met.groupBy("id").agg(F.collect_set("sentence").alias("held"))
    return checkpointed(texts.join(blocked, "id", "left").select("id", "content", F.col("held").alias("blocked")))


def _usable(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(id, content, blocked): the texts, and the numbers of sentences that do not count, none yet."""
    usable = documents.where(F.col(key).isNotNull() & (F.length(text) > 0))
    return usable.select(F.col(key).cast("long").alias("id"), F.col(text).alias("content"), F.lit(None).cast("array<int>").alias("blocked"))


#: Marks the count of a stem among those of words.
STEM = "\0"


def word_subjects(texts: DataFrame, stems: dict[str, str], held_out: list[str] = ()) -> DataFrame:
    """(word, subject, n): in how many sentences of each subject, by the stems alone, a lower-case word stands.

    The subject is null for sentences without stems; sentences with stems of
    several subjects or held-out phrases are left out. The word '' counts the
    sentences, a stem after STEM those that have it.
    """
    shared, key = texts.sparkSession.sparkContext.broadcast((stems, list(held_out))), uuid.uuid4().hex

    def patterns() -> dict:
        stems, held_out = shared.value
        return {stem: (stem, subject) for stem, subject in stems.items()} | dict.fromkeys(held_out, (None, HELD_OUT))

    def scan(batches):
        automaton = _built(key, lambda: _automaton(patterns()))
        held: Counter[tuple[str, str | None]] = Counter()
        folds: dict[str, str] = {}
        for batch in batches:
            for text, blocked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = prepared(text)
                starts = sentence_starts(text)
                found: list[set[tuple]] = [set() for _ in starts]
                for at in blocked or ():
                    found[at].add((None, HELD_OUT))
                for end, (length, value) in automaton.iter(f" {folded(text)} "):
                    found[bisect_right(starts, max(0, end - length + 1)) - 1].add(value)
                for start, stop, values in zip(starts, [*starts[1:], len(text)], found):
                    subjects = {subject for _, subject in values}
                    if len(subjects) > 1 or HELD_OUT in subjects:
                        continue
                    subject = next(iter(subjects), None)
                    held["", subject] += 1
                    for stem, _ in values:
                        held[STEM + stem, subject] += 1
                    for raw in set(text[start:stop].split()):
                        word = folds.get(raw)
                        if word is None:
                            word = folds[raw] = _lower_word(raw)
                        if word:
                            held[word, subject] += 1
            if len(held) > 400_000:
                yield _count_rows(held)
                held = Counter()
                folds.clear()
        yield _count_rows(held)

    return texts.mapInArrow(scan, "word string, subject string, n long").groupBy("word", "subject").agg(F.sum("n").alias("n"))


def _count_rows(held: Counter) -> pa.RecordBatch:
    words, subjects = zip(*held) if held else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(subjects, pa.string()), pa.array(held.values(), pa.int64())], ["word", "subject", "n"])


def weighted_terms(texts: DataFrame, stems: dict[str, str], held_out: list[str] = (), least_share: float = 2e-5, least: int = 4, certainty: float = 0.5) -> tuple[dict[str, tuple[str, float]], dict[str, tuple[str, float]]]:
    """The subject and weight of each learned term and of each stem.

    A word is a term if it stands in ``least_share`` of all sentences, in
    ``least`` at least, and ``certainty`` of its sentences with one subject or none belong to one.
    """
    # read for the total and for the terms
    counts = checkpointed(word_subjects(texts, stems, held_out))
    total = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0
    floor = max(least, math.ceil(total * least_share))
    per_word = counts.where("word <> ''").groupBy("word").agg(
        F.sum("n").alias("sentences"), F.max(F.when(F.col("subject").isNotNull(), F.struct("n", "subject"))).alias("best")
    )
    stem = F.startswith("word", F.lit(STEM))
    strong = per_word.where(F.col("best").isNotNull() & (stem | (F.col("sentences") >= floor) & (F.col("best.n") >= certainty * F.col("sentences"))))
    # bounded: the occurrences of all words are at most words per sentence * total, each term has at least floor; the stems are given
    rows = strong.select("word", "sentences", "best.subject", F.col("best.n").alias("n")).collect()
    scale = math.log(max(total, 2))
    weights = {r["word"]: (r["subject"], r["n"] / r["sentences"] * math.log(max(total, 2) / r["sentences"]) / scale) for r in rows}
    return {w: x for w, x in weights.items() if not w.startswith(STEM)}, {w[len(STEM) :]: x for w, x in weights.items() if w.startswith(STEM)}


def sentence_subjects(texts: DataFrame, terms: tuple[dict, dict], held_out: list[str] = ()) -> DataFrame:
    """(id, subject, evidence): for each document, the evidences of the sentences whose best subject it is.

    Sentences with held-out phrases have none.
    """
    shared, key = texts.sparkSession.sparkContext.broadcast((terms, list(held_out))), uuid.uuid4().hex

    def patterns() -> dict:
        (words, stems), held_out = shared.value
        made = {stem: (*value, False) for stem, value in stems.items()}
        return made | {f" {word} ": (*value, True) for word, value in words.items()} | dict.fromkeys(held_out, (HELD_OUT, math.inf, False))

    def scan(batches):
        automaton = _built(key, lambda: _automaton(patterns()))
        for batch in batches:
            ids, subjects, evidences = [], [], []
            for row_id, text, blocked in zip(*(c.to_pylist() for c in batch.columns)):
                text = prepared(text)
                starts = sentence_starts(text)
                # where a word begins, the learned term that it is, else its longest stem
                at_word: dict[int, tuple] = {}
                sums: dict[int, dict[str, float]] = {at: {HELD_OUT: math.inf} for at in blocked or ()}
                for end, (length, value) in automaton.iter(f" {folded(text)} "):
                    at = max(0, end - length + 1)
                    if value[0] == HELD_OUT:
                        sums.setdefault(bisect_right(starts, at) - 1, {})[HELD_OUT] = math.inf
                    elif value[2] or at not in at_word or not at_word[at][2]:
                        at_word[at] = value
                for at, (subject, weight, _) in at_word.items():
                    of_sentence = sums.setdefault(bisect_right(starts, at) - 1, {})
                    of_sentence[subject] = of_sentence.get(subject, 0.0) + weight
                found: dict[str, list[float]] = {}
                for at, of_sentence in sums.items():
                    if HELD_OUT in of_sentence:
                        continue
                    subject = max(of_sentence, key=lambda s: (of_sentence[s], s))
                    words = 1 + text.count(" ", starts[at], starts[at + 1] if at + 1 < len(starts) else len(text))
                    found.setdefault(subject, []).append(of_sentence[subject] / math.sqrt(max(words, 4)))
                for subject, values in found.items():
                    ids.append(row_id)
                    subjects.append(subject)
                    evidences.append(sorted(values, reverse=True))
            kinds = [pa.array(ids, pa.int64()), pa.array(subjects, pa.string()), pa.array(evidences, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(kinds, ["id", "subject", "evidence"])

    return texts.mapInArrow(scan, "id long, subject string, evidence array<double>")


def majority_labels(labels: DataFrame, names: set[str]) -> DataFrame:
    """(id, subject) of all labelled documents: the labels that most of a document's labellers gave."""
    clean = labels.select(F.col("doc_id").cast("long").alias("id"), F.lower(F.trim("subject")).alias("subject"), "labeled_by").distinct()
    clean = clean.where(F.col("id").isNotNull() & F.col("subject").isin(*names))
    votes = clean.groupBy("id", "subject").agg(F.countDistinct("labeled_by").alias("votes"))
    voters = clean.groupBy("id").agg(F.countDistinct("labeled_by").alias("voters"))
    return votes.join(voters, "id").where("votes * 2 > voters").select("id", "subject")


def calibrated(found: DataFrame, truth: DataFrame, sentences: int) -> float:
    """The evidence threshold at which the subjects of all labelled documents agree best (F1) with their labels (id, subject).

    ``found`` (id, subject, evidence) holds the subjects of all documents that have ``sentences`` evidences at least.
    """
    grid = [k / 100 for k in range(2, 80)]
    found = found.join(truth.select("id").distinct(), "id", "left_semi").select("id", "subject", F.element_at("evidence", sentences).alias("reach"))
    pairs = found.distinct().join(truth.withColumn("right", F.lit(1)), ["id", "subject"], "full")
    # how many thresholds a pair reaches is all that counts, so the driver gets a bounded number of rows
    passed = F.size(F.filter(F.array(*map(F.lit, grid)), lambda least: least <= F.col("reach")))
    rows = pairs.groupBy(passed.alias("passed"), "right").agg(F.count("*").alias("n")).collect()
    right = sum(r["n"] for r in rows if r["right"])

    def quality(at: int) -> float:
        kept = [r for r in rows if r["passed"] > at]
        return 2 * sum(r["n"] for r in kept if r["right"]) / (sum(r["n"] for r in kept) + right) if kept else 0.0

    qualities = [quality(at) for at in range(len(grid))]
    # of thresholds that are nearly as good, the middle one
    good = [least for least, reached in zip(grid, qualities) if reached >= max(qualities) - 0.005]
    return good[len(good) // 2]


def assigned(documents: DataFrame, labels: DataFrame, items: DataFrame | None = None, subjects: DataFrame | None = None, key: str = "doc_id", text: str = "text", sentences: int = 3, default: float = 0.1, most_phrases: int = 2_000_000) -> DataFrame:
    """(id, subject, n_sentences) of every subject that at least ``sentences`` of a document's sentences are about.

    Sentences that hold five words in a row of the evaluation ``items`` do not
    count; up to ``most_phrases`` such sequences are looked for by the automaton,
    more by a join, with the same result. The threshold is calibrated on all labelled documents;
    without usable labels it is ``default``.
    """
    texts = _usable(documents, key, text)
    stems = stems_of(subjects)
    held_out = held_out_phrases(items, most_phrases) if items is not None else []
    if held_out is None:
        texts, held_out = held_out_sentences(texts, items), []
    terms = weighted_terms(texts, stems, held_out)
    found = sentence_subjects(texts, terms, held_out).where(F.size("evidence") >= sentences)
    truth = checkpointed(majority_labels(labels, set(stems.values())))
    threshold = default
    if not truth.isEmpty():
        # read for the threshold and for the result
        found = checkpointed(found)
        threshold = calibrated(found, truth, sentences)
    counted = F.size(F.filter("evidence", lambda e: e >= threshold))
    return found.select("id", "subject", counted.alias("n_sentences")).where(F.col("n_sentences") >= sentences).dropDuplicates(["id", "subject"])
