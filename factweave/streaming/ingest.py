"""Incremental ingestion: new files of a folder, batch by batch.

A batch is idempotent because a file's path and content hash decide what is done
with it, so a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def ingest_stream(spark: SparkSession, engine: Engine, folder: str, checkpoint: str, files_per_batch: int = 1000, once: bool = True) -> StreamingQuery:
    """Ingest the files that appear under ``folder``; with ``once`` those that are
    there now. ``checkpoint`` must be in a shared folder."""
    stream = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    )

    def batch(files, batch_id: int) -> None:
        engine.ingest_files(files, observed_at=batch_id)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
