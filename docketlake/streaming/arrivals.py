"""Documents that arrive in a folder, chunked and appended as they come.

A batch is written under its number, so a batch that runs again after a
failure replaces itself: every document is in the table exactly once. Files
that cannot be read are kept in a table of their own, with the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docketlake.functions import text as T
from docketlake.operators import units
from docketlake.sources import documents as D

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, base: str, pattern: str = "*.[tT][xX][tT]", files_per_batch: int = 1000, **readers) -> DataFrame:
    """A stream of (path, text, error) of the files that appear under ``base``, read as ``documents.read`` does."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(base)
    return D.read(files.select("path", "content"), **readers)


def append_chunks(arrived: DataFrame, target: str, failed: str, checkpoint: str, embed: units.Embed, dim: int, size: int = T.CHUNK_WORDS) -> StreamingQuery:
    """Writes the chunks of a stream (path, text, error) to ``target`` and its failures (file, error) to ``failed``.

    Both are partitioned by batch_id. Ends when all there is has been read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        read = batch.persist()
        chunks = units.embedded(units.chunks(D.readable(read), ["file"], "content", size), "chunk_text", embed, dim)
        chunks.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
        D.failed(read).write.mode("overwrite").parquet(f"{failed}/batch_id={batch_id}")
        read.unpersist()

    return arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
