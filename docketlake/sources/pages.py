"""Pages of scanned documents: which ones need recognition, and how the results come together.

Rendering, recognition and vision models are injected callables, so nothing
of them needs to be installed to plan or test a job.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from docketlake.functions import text as T
from docketlake.session import checkpointed
from docketlake.sources.documents import office_to_pdf

#: A page with less text than this, or with this mark of an unmapped font, is recognised anew.
LEAST_CHARS, UNMAPPED = 50, "(cid:"


class RecognitionUnavailable(RuntimeError):
    """Nothing on the executors can recognise pages."""


class PageFailed(RuntimeError):
    """A page could not be recognised."""


def triage(pages: DataFrame) -> DataFrame:
    """Pages (file, page_no, text, error) with is_problematic: no text, too little of it, unmapped letters or an error."""
    bad = F.coalesce(F.col("error"), F.lit(False)) | F.col("text").isNull() | (F.length(T.strip("text")) < LEAST_CHARS) | F.contains("text", F.lit(UNMAPPED))
    return pages.withColumn("is_problematic", F.coalesce(bad, F.lit(True)))


def runs(pages: DataFrame) -> DataFrame:
    """(file, first_page, last_page) of the runs of consecutive pages among the problematic ones (file, page_no)."""
    order = Window.partitionBy("file").orderBy("page_no")
    islands = pages.select("file", "page_no").distinct().withColumn("island", F.col("page_no") - F.row_number().over(order))
    return islands.groupBy("file", "island").agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")).drop("island")


def merge(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """(file, text): the pages' texts in order, recognised ones (file, page_no, recognised) in place of problematic ones.

    A problematic page of which nothing was recognised is dropped.
    """
    both = pages.join(recognised, ["file", "page_no"], "left")
    chosen = both.select("file", "page_no", F.when(F.col("is_problematic"), T.strip("recognised")).otherwise(F.col("text")).alias("text"), "is_problematic")
    kept = chosen.where(~F.col("is_problematic") | (F.length("text") > 0))
    ordered = kept.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("pages"))
    return ordered.select("file", F.array_join(F.transform("pages", lambda p: p["text"]), "\n").alias("text"))


def page_texts(files: DataFrame, extract: Callable[[bytes], list[str | None]]) -> DataFrame:
    """(file, page_no, text, error) of files (path, content); ``extract`` gives a file's pages."""

    def pages(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, no, text, False) for no, text in enumerate(extract(bytes(content)))]
                except Exception:  # the whole file goes to recognition
                    rows.append((path, 0, None, True))
            yield pd.DataFrame(rows, columns=["file", "page_no", "text", "error"])

    return files.select("path", "content").mapInPandas(pages, "file string, page_no int, text string, error boolean")


def recognise(page_runs: DataFrame, files: DataFrame, render: Callable[[bytes, int, int], list[bytes]], read_image: Callable[[bytes], str] | None) -> DataFrame:
    """(file, page_no, recognised) of the runs; one task renders a run once and reads its pages.

    Without a reader this raises RecognitionUnavailable at once, and a page
    that fails raises PageFailed: neither becomes an empty text.
    """
    if read_image is None:
        raise RecognitionUnavailable("no reader of page images was given")
    wanted = page_runs.join(files.select(F.col("path").alias("file"), "content"), "file").select("file", "first_page", "last_page", "content")

    def read(batches):
        for batch in batches:
            rows = []
            for path, first, last, content in zip(batch["file"], batch["first_page"], batch["last_page"], batch["content"]):
                for no, image in zip(range(first, last + 1), render(bytes(content), first, last)):
                    try:
                        rows.append((path, no, read_image(image)))
                    except Exception as error:
                        raise PageFailed(f"{path}, page {no + 1}: {error}") from error
            yield pd.DataFrame(rows, columns=["file", "page_no", "recognised"])

    return wanted.mapInPandas(read, "file string, page_no int, recognised string")


@dataclass(frozen=True)
class PageTools:
    """What reads paged documents: the pages' texts of a PDF, images of its pages from one to another, the text of an image."""

    extract: Callable[[bytes], list[str | None]]
    render: Callable[[bytes, int, int], list[bytes]]
    read_image: Callable[[bytes], str] | None = None
    #: Makes a PDF of an office file, given its bytes and extension.
    to_pdf: Callable[[bytes, str], bytes] = office_to_pdf


def recognised_documents(files: DataFrame, tools: PageTools) -> DataFrame:
    """(file, text) of files (path, content) in PDF: extracted text, problematic pages recognised.

    Problematic pages without a reader raise RecognitionUnavailable; a file of
    which nothing is left has an empty text.
    """
    pages = checkpointed(triage(page_texts(files, tools.extract)))
    problematic = pages.where("is_problematic")
    nothing = problematic.select("file", "page_no", F.lit(None).cast("string").alias("recognised"))
    read = nothing.limit(0) if problematic.isEmpty() else recognise(runs(problematic), files, tools.render, tools.read_image)
    merged = merge(pages, read)
    return files.select(F.col("path").alias("file")).join(merged, "file", "left").select("file", F.coalesce("text", F.lit("")).alias("text"))


def paged_documents(files: DataFrame, tools: PageTools) -> DataFrame:
    """(path, text, error) of files (path, content) in PDF or an office format, which is made PDF first.

    Recognition that fails ends the job, as in the other functions; a file
    that cannot be made PDF keeps its message as error.
    """

    def convert(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                ending = "." + path.rsplit(".", 1)[-1].lower()
                try:
                    rows.append((path, bytes(content) if ending == ".pdf" else tools.to_pdf(bytes(content), ending), None))
                except Exception as error:  # a bad file must not end the job
                    rows.append((path, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    made = checkpointed(files.select("path", "content").mapInPandas(convert, "path string, content binary, error string"))
    read = recognised_documents(made.where("error is null").select("path", "content"), tools)
    failed = made.where("error is not null").select("path", F.lit(None).cast("string").alias("text"), "error")
    return read.select(F.col("file").alias("path"), "text", F.lit(None).cast("string").alias("error")).unionByName(failed)


def png_base64(image: bytes) -> str:
    """An image in PNG as the data address that vision models take."""
    return "data:image/png;base64," + base64.b64encode(image).decode()
