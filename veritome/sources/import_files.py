"""Imports a folder of text files as assets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.api import Evidence
from veritome.functions import utf8
from veritome.sources import batch


def import_files(evidence: Evidence, corpus: str, folder: str, span_bytes: int = 4096) -> DataFrame:
    """Stages and publishes all files that are new or changed, in one load; (path, outcome).

    The outcome is ``imported``, ``unchanged``, ``skipped`` (too large, with a NUL, or no
    UTF-8) or the reason of a refusal.  An asset's id follows from its path, its key
    from its digest and revision, so a second run over the same files changes nothing.
    """
    s = evidence._store(corpus).snapshot()
    most = evidence._config(s).limits.max_source_bytes
    root = folder.rstrip("/")
    files = evidence.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.when((F.col("length") <= most) & F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8"))
    current = s.table("assets").join(s.table("versions").select(F.col("version_id").alias("current_version_id"), "source_sha256"), "current_version_id", "left")
    rows = files.select(F.element_at(F.split("path", f"\\Q{root}/\\E", 2), -1).alias("path"), text.alias("source"))
    rows = rows.withColumn("asset_id", batch._id("file", "path")).join(current.select("asset_id", "content_revision", F.col("source_sha256").alias("before")), "asset_id", "left")
    digest, revision = utf8.sha256_hex(F.col("source")), F.coalesce("content_revision", F.lit(0).cast("long"))
    rows = rows.withColumn("outcome", F.when(F.col("source").isNull() | (F.instr("source", "\0") > 0), "skipped").when(F.col("before") == digest, "unchanged"))
    rows = rows.withColumn("ingestion_key", F.concat_ws("@", "asset_id", digest, revision.cast("string"))).withColumn("expected_revision", revision)
    loaded = batch.load(evidence, corpus, rows.where("outcome is null"), span_bytes)
    named = rows.select("path", "outcome", "ingestion_key").join(loaded.select("ingestion_key", "problem"), "ingestion_key", "left")
    return named.select("path", F.coalesce("outcome", "problem", F.lit("imported")).alias("outcome"))
