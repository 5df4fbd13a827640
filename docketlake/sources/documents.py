"""Reading folders of documents, with a place for what could not be read."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The extensions that are read, and the byte order marks with their encodings, the longest first.
EXTENSIONS = (".txt", ".pdf", ".doc", ".docx")
MARKS = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def decode_text(raw: bytes) -> str:
    """The text of a file by its byte order mark, else UTF-8, else Windows' Western encoding; else a ValueError."""
    for mark, encoding in MARKS:
        if raw.startswith(mark):
            return raw.decode(encoding)
    for encoding in ("utf-8", "cp1252"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    raise ValueError("neither UTF-8 nor Windows-1252")


def scan(spark: SparkSession, base: str, limit: int | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, content) of the files under ``base`` with a known extension, in any case.

    ``limit`` keeps the first files by path; 0 and None keep all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    ending = "|".join(e.lstrip(".") for e in extensions)
    found = files.select("path", "content").where(F.lower("path").rlike(rf"\.({ending})$"))
    return found.orderBy("path").limit(limit) if limit and limit > 0 else found


def read(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None, text_extractor: Callable[[str], str] | None = None, tools=None) -> DataFrame:
    """(path, text, error) of the files (path, content); one of text and error is null.

    ``.txt`` files are decoded. Other formats need an extractor for their
    extension, which gets the bytes, or ``tools`` (pages.PageTools), which read
    PDF and office files page by page. ``text_extractor`` gets every path and
    replaces them all. A file that fails keeps its message as error.
    """
    known = dict(extractors or {})
    if tools and not text_extractor:
        from docketlake.sources.pages import paged_documents

        paged = F.concat(F.lit("."), extension("path")).isin(*(set(EXTENSIONS) - {".txt", *known}))
        return read(files.where(~paged), extractors).unionByName(paged_documents(files.where(paged), tools))

    @F.pandas_udf("struct<text: string, error: string>")
    def extract(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for path, content in zip(paths, contents):
            ending = "." + path.rsplit(".", 1)[-1].lower()
            try:
                if text_extractor:
                    rows.append((text_extractor(path), None))
                elif ending == ".txt":
                    rows.append((decode_text(bytes(content)), None))
                elif ending in known:
                    rows.append((known[ending](bytes(content)), None))
                else:
                    rows.append((None, f"no extractor for {ending}"))
            except Exception as error:  # a bad file must not end the job
                rows.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return files.withColumn("_read", extract("path", "content")).select("path", "_read.text", "_read.error")


def readable(read_files: DataFrame) -> DataFrame:
    """(file, content) of the files that were read and are not blank."""
    return read_files.where(F.col("error").isNull() & F.col("text").rlike(r"[^\s\p{Z}]")).select(F.col("path").alias("file"), F.col("text").alias("content"))


def failed(read_files: DataFrame) -> DataFrame:
    """(file, error) of the files that could not be read."""
    return read_files.where(F.col("error").isNotNull()).select(F.col("path").alias("file"), "error")


def office_to_pdf(content: bytes, suffix: str, command: tuple[str, ...] = ("soffice", "--headless", "--convert-to", "pdf", "--outdir")) -> bytes:
    """An office file as PDF by an office program of the executor; its absence is a RuntimeError."""
    import shutil
    import subprocess
    import tempfile
    from pathlib import Path

    if not shutil.which(command[0]):
        raise RuntimeError(f"{command[0]} is not installed")
    with tempfile.TemporaryDirectory() as folder:
        source = Path(folder, f"document{suffix}")
        source.write_bytes(content)
        subprocess.run([*command, folder, str(source)], check=True, capture_output=True, timeout=600)
        return source.with_suffix(".pdf").read_bytes()


def extension(path: Column | str) -> Column:
    """The file's extension in lower case, without the dot."""
    return F.lower(F.regexp_extract(path if isinstance(path, Column) else F.col(path), r"\.([^./]+)$", 1))


def labelled_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant_files, relevant_text) of a JSON file with a list of labelled queries, in its order.

    ``query_id`` is the file's own, where it has one. A list is one value of
    JSON, which one task reads; lists are of a size that people label.
    """
    kind = "array<struct<query_id: bigint, query: string, relevant_files: array<string>, relevant_text: string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("rows"))
    each = whole.select(F.posexplode("rows").alias("at", "row"))
    return each.select(F.coalesce("row.query_id", F.col("at").cast("bigint")).alias("query_id"), "row.query", "row.relevant_files", "row.relevant_text")


def npy_vectors(spark: SparkSession, path: str, rows_per_task: int = 50_000) -> DataFrame:
    """(row, embedding) of a NumPy file with a matrix; each task reads its own rows from the file, which all executors must see."""
    import numpy as np

    count, _ = np.load(path, mmap_mode="r").shape
    starts = spark.range(0, count, rows_per_task, numPartitions=max(1, -(-count // rows_per_task)))

    def load(batches):
        for batch in batches:
            for start in batch["id"]:
                part = np.load(path, mmap_mode="r")[start : start + rows_per_task]
                yield pd.DataFrame({"row": np.arange(start, start + len(part)), "embedding": list(np.asarray(part, np.float32))})

    return starts.mapInPandas(load, "row long, embedding array<float>")


def write_report(rows: DataFrame, path: str) -> None:
    """Writes a measurement, a few rows, as one JSON file in a folder, stamped with the time in UTC."""
    stamped = rows.withColumn("made_at", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss"))
    stamped.coalesce(1).write.mode("overwrite").json(path)
