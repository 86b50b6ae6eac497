"""The tables that operators read, and what is derived from all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tables:
    """One snapshot of a corpus (schemas in ``veritome.sources.schema``)."""

    spark: SparkSession
    assets: DataFrame
    versions: DataFrame
    publications: DataFrame
    spans: DataFrame
    embeddings: DataFrame
    tags: DataFrame
    relations: DataFrame
    tombstones: DataFrame


def version_status(t: Tables, some: DataFrame | None = None) -> DataFrame:
    """(version_id, asset_id, path, published_revision, status) of every version, or of ``some``, few; the first rule that fits decides."""
    v, a = t.versions.select("version_id", "asset_id", "path"), t.assets.select("asset_id", "current_version_id", "retired_at")
    p = t.publications.select("version_id", F.col("revision").alias("published_revision"))
    x = t.tombstones.select("version_id", F.lit(True).alias("purged"))
    if some is not None:
        v, p, x = (side.join(F.broadcast(some), "version_id", "left_semi") for side in (v, p, x))
    rows = v.join(a, "asset_id", "left").join(p, "version_id", "left").join(x, "version_id", "left")
    status = (
        F.when(F.col("purged"), "purged")
        .when(F.col("current_version_id") == F.col("version_id"), "current")
        .when(F.col("published_revision").isNull(), "staged")
        .when(F.col("current_version_id").isNull() & F.col("retired_at").isNotNull(), "retired")
        .otherwise("historical")
    )
    return rows.select("version_id", "asset_id", "path", "published_revision", status.alias("status"))


def current_versions(t: Tables) -> DataFrame:
    """(version_id, asset_id, path) of current versions."""
    a = t.assets.where("current_version_id is not null").select(F.col("current_version_id").alias("version_id"), "asset_id")
    return a.join(t.versions.select("version_id", "path"), "version_id")
