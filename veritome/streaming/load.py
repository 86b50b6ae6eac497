"""Continuous loading: each micro-batch of documents becomes one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veritome.api import Evidence
from veritome.sources import batch


def load_stream(evidence: Evidence, corpus: str, docs: DataFrame, checkpoint: str, span_bytes: int = 4096, **trigger) -> StreamingQuery:
    """Loads a stream of (asset_id, path, source, ingestion_key).

    Keys make a repeated micro-batch harmless: its rows are refused as used.
    """

    def one(rows: DataFrame, number: int) -> None:
        batch.load(evidence, corpus, rows, span_bytes)

    writer = docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
