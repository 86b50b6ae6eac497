"""Schemas of a corpus's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(**columns: str) -> T.StructType:
    """``name="type"``, with ``!`` where null is not allowed."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "ts": T.TimestampType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType(), False)}
    return T.StructType([T.StructField(k, kinds[v.rstrip("!")], not v.endswith("!")) for k, v in columns.items()])


TABLES = {
    "collection_config": _table(
        schema_version="int!", embedding_model="string", embedding_dimensions="int", text_search_config="string!", max_source_bytes="int!", max_response_bytes="int!",
        max_candidates_per_operator="int!", max_plan_nodes="int!", max_edges_returned="int!", created_at="ts!",
    ),
    "assets": _table(asset_id="string!", current_version_id="string", current_path="string", content_revision="long!", annotation_revision="long!", retired_at="ts", created_at="ts!"),
    "versions": _table(
        version_id="string!", asset_id="string!", path="string!", source="string", source_sha256="string!", byte_length="int!", ingestion_key="string!", request_sha256="string!",
        base_revision="long!", created_by="string!", created_at="ts!",
    ),
    "publications": _table(asset_id="string!", version_id="string!", revision="long!", published_by="string!", published_at="ts!"),
    "spans": _table(evidence_id="string!", version_id="string!", start_byte="int!", end_byte="int!", text="string", tokens="strings"),
    "embeddings": _table(evidence_id="string!", embedding="floats!"),
    "tags": _table(asset_id="string!", tag="string!", created_by="string!", created_at="ts!"),
    "relations": _table(source_evidence_id="string!", kind="string!", target_evidence_id="string!", asserted_by="string!", asserted_at="ts!"),
    "tombstones": _table(version_id="string!", purged_by="string!", purged_at="ts!", reason="string!"),
}
