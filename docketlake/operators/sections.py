"""Splitting texts into named sections by a schema of line patterns."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from docketlake.functions import text as T

#: The section before the first pattern, and the one that holds everything.
FIRST_SECTION, WHOLE = "cabecalho", "completo"


@dataclass(frozen=True)
class Section:
    name: str
    patterns: tuple[str, ...]


def parse_schema(raw: list[tuple[str, list[str]]]) -> list[Section]:
    """The sections of a raw schema, names and patterns brought to one form.

    A section without name or patterns is dropped; a repeated name keeps its
    first place and takes the later patterns.
    """
    found: dict[str, tuple[str, ...]] = {}
    for name, patterns in raw:
        name = (name or "").strip().lower().replace(" ", "_")
        patterns = tuple(p for p in ((p or "").strip().lower() for p in patterns or ()) if p)
        if name and patterns:
            found[name] = patterns
    return [Section(name, patterns) for name, patterns in found.items()]


def pattern(patterns: tuple[str, ...] | list[str]) -> str:
    """A regular expression that finds any of the literal patterns as whole words; it never matches without any."""
    word = r"[\p{L}\p{N}_]"
    parts = []
    for literal in patterns:
        quoted = re.sub(r"([^\w\s])", r"\\\1", literal)
        before = f"(?:^|(?<!{word}))" if re.match(r"\w", literal) else ""
        after = f"(?!{word})" if re.search(r"\w$", literal) else ""
        parts.append(f"{before}{quoted}{after}")
    return "|".join(parts) if parts else r"(?!)"


def matched_section(line: Column | str, schema: list[Section]) -> Column:
    """The first section of the schema of which a pattern stands in the line; null without any."""
    plain = T.strip(F.lower(line if isinstance(line, Column) else F.col(line)))
    matched = F.lit(None).cast("string")
    for section in reversed(schema):
        matched = F.when(plain.rlike(pattern(section.patterns)), F.lit(section.name)).otherwise(matched)
    return matched


def _opener(lines: Column, schema: list[Section]) -> Column:
    """(at, name) of the lines, counted from 1, that open a section; only those that hold a pattern's letters are looked at more closely."""
    literals = sorted({p for section in schema for p in section.patterns})

    def opens(line: Column, i: Column) -> Column:
        holds = T.let(F.lower(line), lambda lowered: functools.reduce(Column.__or__, (F.contains(lowered, F.lit(p)) for p in literals), F.lit(False)))
        return F.when(holds, F.struct((i + 1).alias("at"), matched_section(line, schema).alias("name")))

    return F.filter(F.transform(lines, opens), lambda x: x["name"].isNotNull())


def _parts(lines: Column, openers: Column) -> Column:
    """The sections (name, text) of a text's lines, in the order in which they open first."""

    def of_starts(starts: Column) -> Column:
        def segment(start: Column, i: Column) -> Column:
            after = F.coalesce(F.get(starts, i + 1)["at"], F.size(lines) + 1)
            return F.struct(start["name"].alias("name"), F.array_join(F.slice(lines, start["at"], after - start["at"]), "\n").alias("text"))

        return T.let(F.transform(starts, segment), lambda segments: F.transform(
            F.array_distinct(F.transform(segments, lambda s: s["name"])),
            lambda name: F.struct(name.alias("name"), T.strip(F.array_join(F.transform(F.filter(segments, lambda s: s["name"] == name), lambda s: s["text"]), "\n")).alias("text")),
        ))

    first = F.struct(F.lit(1).alias("at"), F.lit(FIRST_SECTION).alias("name"))
    headed = F.when(F.coalesce(F.get(openers, F.lit(0))["at"], F.lit(0)) == 1, openers).otherwise(F.concat(F.array(first), openers))
    return T.let(headed, of_starts)


def split(documents: DataFrame, keys: list[str], text: str, schema: list[Section]) -> DataFrame:
    """``keys`` with section_no, section_name and section_text, one row for each section that is not blank.

    A line that matches opens its section, to which it and the lines after it
    belong; a section that opens again goes on. The whole text comes as the
    section 'completo', with the number -1. All happens within a document's row.
    """
    usable = documents.where(F.col(text).isNotNull())
    made = T.let(F.split(F.col(text), "\n"), lambda lines: T.let(_opener(lines, schema), lambda openers: _parts(lines, openers)))
    parts = usable.select(*keys, F.posexplode(made).alias("section_no", "_part")).select(*keys, "section_no", F.col("_part.name").alias("section_name"), F.col("_part.text").alias("section_text"))
    whole = usable.select(*keys, F.lit(-1).alias("section_no"), F.lit(WHOLE).alias("section_name"), T.strip(text).alias("section_text"))
    return parts.unionByName(whole).where("section_text <> ''")


def _typed_openers(lines: Column, document_type: str, schemas: dict[str, list[Section]]) -> Column:
    none = F.array().cast("array<struct<at:int,name:string>>")
    found = none
    for kind, schema in schemas.items():
        found = F.when(F.col(document_type) == kind, _opener(lines, schema)).otherwise(found)
    return found


def split_by_type(documents: DataFrame, keys: list[str], text: str, document_type: str, schemas: dict[str, list[Section]]) -> DataFrame:
    """(keys, section_name, section_text) by each document type's own schema, in one plan; types without one have an empty schema."""
    usable = documents.where(F.col(text).isNotNull())
    made = T.let(F.split(F.col(text), "\n"), lambda lines: T.let(_typed_openers(lines, document_type, schemas), lambda openers: _parts(lines, openers)))
    parts = usable.select(*keys, F.explode(made).alias("_part"))
    return parts.select(*keys, F.col("_part.name").alias("section_name"), F.col("_part.text").alias("section_text")).where("section_text <> ''")


def pattern_matches(documents: DataFrame, keys: list[str], text: str, document_type: str, schemas: dict[str, list[Section]]) -> DataFrame:
    """(keys, line_no, section_name) of the lines, counted from 0, that open a section."""
    usable = documents.where(F.col(text).isNotNull())
    openers = T.let(F.split(F.col(text), "\n"), lambda lines: _typed_openers(lines, document_type, schemas))
    return usable.select(*keys, F.explode(openers).alias("_o")).select(*keys, (F.col("_o.at") - 1).alias("line_no"), F.col("_o.name").alias("section_name"))


#: Fixed value: the form of the answer that a calibration asks a chat provider for.
CALIBRATION_SCHEMA = {
    "type": "object",
    "properties": {
        "sections": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {"name": {"type": "string"}, "patterns": {"type": "array", "items": {"type": "string"}}},
                "required": ["name", "patterns"],
                "additionalProperties": False,
            },
        }
    },
    "required": ["sections"],
    "additionalProperties": False,
}


def calibrate(samples: list[str], document_type: str, chat, most_sections: int = 8, documents: int = 5, chars: int = 4000) -> list[Section]:
    """Asks a chat provider for the sections of a document type, shown the beginnings of a few documents."""
    shown = "\n\n---\n\n".join(sample[:chars] for sample in samples[:documents])
    prompt = (
        f"The texts below are documents of the type '{document_type}'. Name at most {most_sections} sections that such documents have, "
        "in their usual order, each with phrases that begin it, as they stand in the text.\n\n" + shown
    )
    answer = chat.complete_structured(prompt, CALIBRATION_SCHEMA)
    return parse_schema([(s.get("name"), s.get("patterns")) for s in answer.get("sections", [])])
