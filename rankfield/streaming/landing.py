"""Scheduled landing as an incremental stream.

New document files are picked up where the last run stopped and upserted by key, so a
re-published event replaces its rows and a repeated run changes nothing. Only the
partitions a batch touches are read and rewritten.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..session import cut
from ..sources.landing import arrived, failed_documents, last_arrived, upsert, write_partitions


def land(
    spark: SparkSession,
    source: str,
    schema: str,
    parse: Callable[[DataFrame], DataFrame],
    table: str,
    keys: list[str],
    partitions: list[str],
    progress: str,
    log: str,
) -> None:
    """Land every document file not yet seen, then stop. ``progress`` holds the stream's own
    record of what was read and must be a folder all runs share.

    A document that cannot be read becomes a ``failed`` row of the ingest log at ``log``, so that it can be fetched
    again. Of several documents with one key the last to arrive wins."""
    documents = (
        spark.readStream.schema(f"{schema}, _corrupt_record string")
        .option("multiLine", True).option("mode", "PERMISSIVE").json(source).select("*", arrived())
    )

    stream = hashlib.md5(progress.encode()).hexdigest()[:12]

    def write(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        # A folder per batch: one that is tried again replaces its rows.
        failed_documents(batch, table).write.mode("overwrite").parquet(f"{log}/batch={stream}-{number}")
        rows = cut(last_arrived(parse(batch.where("_corrupt_record is null").drop("_corrupt_record")), keys))
        touched = rows.select(*partitions).distinct()
        try:
            stored = spark.read.schema(rows.schema).parquet(table).join(touched, partitions, "left_semi")
            rows = cut(upsert(stored.select(*rows.columns), rows, keys))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        write_partitions(rows, table, partitions)

    (
        documents.writeStream.foreachBatch(write).option("checkpointLocation", progress)
        .trigger(availableNow=True).start().awaitTermination()
    )
