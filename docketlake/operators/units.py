"""Units of retrieval: overlapping chunks, whole documents and sections, with their vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from docketlake.functions import text as T, vectors as V
from docketlake.operators import sections as S

Embed = Callable[[Column], Column]
#: The size of the largest broadcast filter, in bits (16 MB).
MOST_BITS = 1 << 27


def chunks(documents: DataFrame, keys: list[str], text: str, size: int = T.CHUNK_WORDS) -> DataFrame:
    """``keys`` with chunk_index and chunk_text, one row for each window of ``size`` words."""
    windows = documents.where(F.col(text).isNotNull()).select(*keys, F.posexplode(T.word_windows(text, size)).alias("chunk_index", "chunk_text"))
    return windows.where("chunk_text <> ''")


def embedded(units: DataFrame, text: str, embed: Embed, dim: int, prefix: str = "") -> DataFrame:
    """``units`` with embedding; a text without content gets a zero vector, and the provider never sees it."""
    asked = T.embedding_input(text, prefix)
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return units.withColumn("_asked", asked).withColumn("embedding", F.when(F.col("_asked") == "", zero).otherwise(embed(F.col("_asked")))).drop("_asked")


def pooled(units: DataFrame, embedded_chunks: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """``units`` with the pooled vector of the chunks of the same ``keys``; zero without any."""
    means = V.mean_pool(embedded_chunks, keys, "embedding", "_pooled")
    zero = F.array_repeat(F.lit(0.0), dim)
    return units.join(means, keys, "left").withColumn("embedding", F.coalesce("_pooled", zero).cast("array<float>")).drop("_pooled")


def full(documents: DataFrame, embedded_chunks: DataFrame, keys: list[str], text: str, dim: int) -> DataFrame:
    """``keys`` with content, an array of the one text, and the vector pooled over all chunks of the keys."""
    units = documents.select(*keys, F.array(text).alias("content"))
    return pooled(units, embedded_chunks, keys, dim)


def sections(documents: DataFrame, keys: list[str], text: str, schema: list[S.Section], embed: Embed, dim: int, prefix: str = "", size: int = T.CHUNK_WORDS) -> DataFrame:
    """``keys`` with section_name, section_text and the vector pooled over the section's windows."""
    split = S.split(documents, keys, text, schema).where(F.col("section_name") != S.WHOLE)
    return sections_of(split, keys, embed, dim, prefix, size)


def sections_of(split: DataFrame, keys: list[str], embed: Embed, dim: int, prefix: str = "", size: int = T.CHUNK_WORDS) -> DataFrame:
    """Vectors for sections (keys, section_name, section_text), whoever found them; a blank one gets a zero vector."""
    of_section = [*keys, "section_name"]
    windows = embedded(chunks(split, of_section, "section_text", size), "chunk_text", embed, dim, prefix)
    return pooled(split, windows, of_section, dim)


def entry_text(entries: DataFrame) -> Column:
    """The text of an entry of any strategy."""
    have = [F.col(c) for c in ("chunk_text", "section_text") if c in entries.columns]
    if "content" in entries.columns:
        have.append(F.array_join("content", " "))
    return F.coalesce(*have, F.lit(""))


def copied_from(asked: DataFrame, texts: DataFrame, run: int = 12) -> DataFrame:
    """The query_id of each passage, in ``asked`` (query_id, relevant_text, file), of which ``run`` consecutive words stand in a text of its file (file, chunk_text), white space and case aside.

    As in ``looks_copied``, the run's first word may end a longer one and its
    last word begin one. What stands between them is joined on its hash with
    the file, so a file with many passages and texts is spread like any other.
    """

    def runs(text: str):
        def at(words: Column) -> Column:
            starts = F.when(F.size(words) >= run, F.sequence(F.lit(0), F.size(words) - run)).otherwise(F.array().cast("array<int>"))

            def one(i: Column) -> Column:
                inner = F.array_join(F.slice(words, i + 2, run - 2), " ")
                return F.struct(F.xxhash64("file", inner).alias("inner"), F.get(words, i).alias("first"), F.get(words, i + run - 1).alias("last"))

            return F.transform(starts, one)

        return F.inline(T.let(T.words(F.lower(F.col(text))), at))

    wanted = asked.where("file is not null and relevant_text is not null")
    passages = wanted.select("query_id", runs("relevant_text")).select("query_id", "inner", F.col("first").alias("begins"), F.col("last").alias("ends"))
    bits, kept = bit_filter(passages, "inner")
    met = texts.where("chunk_text is not null").select(runs("chunk_text")).join(F.broadcast(bits), kept).select("inner", "first", "last").distinct().join(passages, "inner")
    return met.where(F.endswith("first", "begins") & F.startswith("last", "ends")).select("query_id").distinct()


def bit_filter(rows: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """One row with ``bits``, a bit filter of the longs ``key``, of at most MOST_BITS; and the condition, which holds for all of them and few others."""
    size = min(MOST_BITS, 1 << (8 * rows.count() + 64).bit_length())
    place = F.pmod(F.col(key), F.lit(size))
    at, bit = F.shiftright(place, 6).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")
    some = rows.select(at.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("one")).groupBy("at").agg(F.bit_or("one").alias("word"))
    dense = rows.sparkSession.range(size >> 6).select(F.col("id").cast("int").alias("at")).join(some, "at", "left").fillna(0, ["word"])
    bits = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("bits"))
    return bits, F.getbit(F.get("bits", at), bit) == 1
