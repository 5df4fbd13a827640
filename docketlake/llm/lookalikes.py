"""Texts that look alike but are written with other characters.

Characters that only stand for others of the same look are brought to the
ordinary one: full-width and presentation forms, a letter and a combining mark
where one letter exists, unusual spaces, invisible characters. Ordinals,
fractions, symbols, curly quotes and dashes stay.

Look-alike letters of another alphabet are judged by word. A word's dominant
script is the one of most of its letters. Only in a word of mixed scripts are
the letters of the other scripts replaced by their look-alikes of the dominant
one, and only if the result is a word that the corpus knows, in any case, written in one
script. Words wholly in another alphabet stay as they are.

Null and empty texts give no rows. Rows do not influence one another except
through the vocabulary; rows repeated with their id count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from docketlake.llm.vocabulary import counted

#: Letters that look like a Latin one, beside it.
PAIRS = (
    "аa вb сc ԁd еe һh іi јj кk ӏl мm пn оo рp ԛq гr ѕs тt цu ѵv ԝw хx уy "
    "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ԚQ ЅS ТT ХX УY ԜW ҮY "
    "αa ϲc ɑa ɡg ɩi ɪi ʋu ιi κk νv οo ρp τt υu χx γy ηn ωw ϳj ɴn "
    "ΑA ΒB ϹC ΕE ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ΖZ Ϳ"
    "J օo ցg հh ոn սu ѡw ѳo ᴏo ᴄc ᴠv ᴡw ᴢz ꮃW ꭺA ʀR ʟL ƅb ƽs ǀl"
)
TO_LATIN = {pair[0]: pair[1] for pair in PAIRS.split()}
_FROM_LATIN = {
    "greek": {v: k for k, v in TO_LATIN.items() if "Ͱ" <= k <= "Ͽ"},
    "cyrillic": {v: k for k, v in TO_LATIN.items() if "Ѐ" <= k <= "ԯ"},
}
SPACES = "   -   　"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁥-⁯︀-️﻿\U000e0001-\U000e007f"
FORMS = "ﬀ-ﬆﬓ-ﬗיִ-ﭏﭐ-﷿︰-﹏ﹰ-ﻼ！-ￜ￠-￦\U0001d400-\U0001d7ff"
MARKS = "̀-ͯ"
_SPECIAL = re.compile(f"[{SPACES}{INVISIBLE}{FORMS}{MARKS}]")
_SPACE, _UNSEEN, _FORM = re.compile(f"[{SPACES}]"), re.compile(f"[{INVISIBLE}]"), re.compile(f"[{FORMS}]")
_FOREIGN = re.compile("[ɐ-ʯͰ-֏ᴀ-ᴿꭰ-ꮿƅƽǀ]")
_WORD = re.compile(r"[^\W\d_]+")
VOCABULARY = r"[^\W\d_]{2,}"


def script(letter: str) -> str:
    """The alphabet of a letter, as far as look-alikes need it."""
    code = ord(letter)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin" if letter not in TO_LATIN else "other"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    return "other"


def ordinary(text: str) -> tuple[str, list[str]]:
    """``text`` in ordinary characters, and the kinds of characters that were replaced."""
    kinds = []
    if not _SPECIAL.search(text):
        return text, kinds
    for kind, pattern, become in (("invisible", _UNSEEN, ""), ("space", _SPACE, " "), ("form", _FORM, lambda m: unicodedata.normalize("NFKC", m.group()))):
        text, n = pattern.subn(become, text)
        if n:
            kinds.append(kind)
    composed = unicodedata.normalize("NFC", text)
    if composed != text:
        kinds.append("combining")
    return composed, kinds


def one_script(word: str) -> str | None:
    """The word of mixed scripts in its dominant one; none if it is not mixed or a letter has no look-alike there."""
    scripts = Counter(script(c) for c in word)
    if len(scripts) < 2:
        return None
    dominant = max(scripts, key=lambda s: (scripts[s], s == "latin"))
    if dominant == "other":
        dominant = "latin"
    if dominant == "latin":
        made = "".join(c if script(c) == "latin" else TO_LATIN.get(c, "\0") for c in word)
    else:
        table = _FROM_LATIN[dominant]
        made = "".join(c if script(c) == dominant else table.get(TO_LATIN.get(c, c), "\0") for c in word)
    return None if "\0" in made else made


def mixed_words(text: str) -> dict[str, str]:
    """The words of mixed scripts that one script can write, each with the word it looks like."""
    if not _FOREIGN.search(text):
        return {}
    return {w: made for w in set(_WORD.findall(text)) if _FOREIGN.search(w) and (made := one_script(w))}


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word): the corpus's words in lower case, from the texts' column ``content`` as they stand."""
    find = re.compile(VOCABULARY).findall

    def scan(batches):
        yield from counted(find, batches)

    words = texts.select("content").mapInArrow(scan, "word string, n long")
    return words.select(F.lower("word").alias("word")).distinct()


def judged(texts: DataFrame) -> DataFrame:
    """(field, id, kinds, swaps) of the texts (field, id, content) that are not in ordinary form.

    ``kinds`` names the kinds of replaced characters, with 'letter' for
    look-alike letters; ``swaps`` maps each such word to the known word.
    """

    def scan(batches):
        for batch in batches:
            rows = []
            for field, row_id, content in zip(*(c.to_pylist() for c in batch.columns)):
                if content.isascii():
                    continue
                text, kinds = ordinary(content)
                words = mixed_words(text)
                if kinds or words:
                    rows.append((field, row_id, kinds, list(words), list(words.values())))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["field", "id", "kinds", "words", "looks"])

    found = texts.mapInArrow(scan, "field string, id long, kinds array<string>, words array<string>, looks array<string>")
    each = found.select("field", "id", "kinds", F.explode_outer(F.arrays_zip("words", "looks")).alias("pair"))
    each = each.select("field", "id", "kinds", F.col("pair.words").alias("mixed"), F.col("pair.looks").alias("word"))
    known = vocabulary(texts).select(F.col("word").alias("lowered"), F.lit(True).alias("known"))
    swap = F.when(F.col("known") & F.col("mixed").isNotNull(), F.struct("mixed", "word"))
    swapped = each.withColumn("lowered", F.lower("word")).join(known, "lowered", "left").groupBy("field", "id").agg(F.first("kinds").alias("kinds"), F.collect_set(swap).alias("swaps"))
    kinds = F.when(F.size("swaps") > 0, F.concat("kinds", F.array(F.lit("letter")))).otherwise(F.col("kinds"))
    return swapped.select("field", "id", kinds.alias("kinds"), "swaps").where(F.size("kinds") > 0)


def normalised(texts: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(field, id, kinds, normal_text) of the texts that are not in ordinary form."""
    found = judged(texts) if found is None else found

    def write(batches):
        for batch in batches:
            made = []
            for content, swaps in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                text, _ = ordinary(content)
                table = {s["mixed"]: s["word"] for s in swaps}
                made.append(_WORD.sub(lambda m: table.get(m.group(), m.group()), text) if table else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], ["field", "id", "kinds", "normal_text"])

    both = texts.join(found, ["field", "id"]).select("field", "id", "kinds", "content", "swaps")
    return both.mapInArrow(write, "field string, id long, kinds array<string>, normal_text string")
