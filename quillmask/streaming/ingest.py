"""Redaction of documents as they arrive: a pack is the unit, a micro-batch its packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillmask.plans.redact import redact


def redact_stream(docs: DataFrame, out: str, checkpoint: str, level: int = 2, **trigger) -> StreamingQuery:
    """Writes redacted documents of a streaming ``docs`` to Parquet under ``out``.

    A micro-batch should hold whole packs (one file each, say), as tokens are numbered within it.  Each
    batch is written to a folder of its own number, which a retry overwrites.
    """

    def write(batch: DataFrame, number: int) -> None:
        redact(batch, level).documents.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
