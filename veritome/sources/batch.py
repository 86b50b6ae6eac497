"""Set-based calls: many documents, versions, tags, relations or vectors in one commit, as DataFrames.

The checks of the single calls are columns here.  Each function returns its rows with
``problem``: null where the row was written or had been before, else the reason for
which it was not.  Rows that break a rule of their own are set aside first; only the
others are joined and ranked, so null keys never meet in one task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritome.api import Evidence
from veritome.errors import EvidenceError
from veritome.functions import fulltext, utf8
from veritome.requests import MAX_KEY_BYTES, MAX_PATH_BYTES, MAX_REASON_BYTES, MAX_SPANS, MAX_TAG_BYTES, SPAN_BYTES_FACTOR, Config, span_faults
from veritome.sources.chunk import chunk_spans
from veritome.sources.store import Changes, Snapshot

UUID_FORM = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SPANS = "array<struct<start_byte:int,end_byte:int>>"
#: Bytes of text that a task holds as spans.
SPAN_BATCH = 4 << 20


def _now() -> Column:
    return F.lit(dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))


def _id(kind: str, *key: Column | str) -> Column:
    """An id that follows from the key, so a task that runs twice writes the same rows."""
    h = F.md5(F.concat_ws(":", F.lit(kind), *key).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _text_flaw(name: str, most: int) -> Column:
    return (F.octet_length(name) > most) | (F.col(name) == "") | F.col(name).rlike(r"[\x00-\x1f\x7f-\x9f]")


def _sift(rows: DataFrame, rules: list[tuple[Column, str]], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with ``problem``: the first rule that a row breaks, or what ``judge`` says of those that break none."""
    broken = F.lit(None).cast("string")
    for test, reason in reversed(rules):
        broken = F.when(test, reason).otherwise(broken)
    marked = rows.withColumn("problem", broken)
    judged = judge(marked.where("problem is null").drop("problem"))
    return judged.unionByName(marked.where("problem is not null"), allowMissingColumns=True)


def _run(evidence: Evidence, corpus: str, body: Callable[[Snapshot, Changes, Config], DataFrame]) -> DataFrame:
    evidence._may("writer")
    return evidence._store(corpus).transact(lambda s, c: body(s, c, evidence._config(s)))


def _first(key: str, order: str) -> Column:
    """Whether a row is the first one of its key."""
    return F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1


# ---- versions ---------------------------------------------------------------


def _with_spans(rows: DataFrame, span_bytes: int, given: bool, config: Config) -> DataFrame:
    """Adds ``spans``, by lines unless given, and ``span_flaw``."""

    @F.pandas_udf(SPANS)
    def cut(sources: pd.Series) -> pd.Series:
        return sources.map(lambda source: [{"start_byte": a, "end_byte": b} for a, b in chunk_spans(source.encode(), span_bytes)])

    @F.pandas_udf("string")
    def flaw(sources: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([_span_flaw(source.encode(), a, b, SPAN_BYTES_FACTOR * config.limits.max_source_bytes) for source, a, b in zip(sources, starts, ends)], dtype=object)

    if not given:
        return rows.withColumn("spans", cut("source")).withColumn("span_flaw", F.when(F.size("spans") > MAX_SPANS, "max_spans_per_version"))
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))
    return rows.withColumn("span_flaw", F.when(F.size("spans") > MAX_SPANS, "max_spans_per_version").otherwise(flaw("source", "spans.start_byte", "spans.end_byte")))


def _span_flaw(raw: bytes, starts: Iterable, ends: Iterable, most: int) -> str | None:
    """The rule that the first faulty span breaks; one without a start or end is faulty."""
    start, end = (np.nan_to_num(np.array(x, np.float64), nan=-1).astype(np.int64) for x in (starts, ends))
    faulty, heavy = span_faults(start, end, raw, most)
    for i in np.flatnonzero((faulty > 0) | heavy)[:1]:
        return "spans" if faulty[i] else "max_span_bytes_total"
    return None


def _pairs() -> Column:
    """Spans as a request writes them."""
    return F.array_join(F.transform("spans", lambda x: F.concat(F.lit("["), x["start_byte"].cast("string"), F.lit(","), x["end_byte"].cast("string"), F.lit("]"))), ",")


def _request_sha256() -> Column:
    """The digest that the single call has for the same request."""
    path = F.to_json(F.struct("path"))
    body = F.concat(
        F.lit('{"asset_id":"'), "asset_id", F.lit('","expected_revision":'), F.col("base_revision").cast("string"), F.lit(","), F.substring(path, F.lit(2), F.length(path) - 2),
        F.lit(',"source_sha256":"'), "source_sha256", F.lit('","spans":['), "pairs", F.lit("]}"),
    )
    return utf8.sha256_hex(body)


def _span_rows(versions: DataFrame) -> DataFrame:
    """(version_id, key, start_byte, end_byte, text) of versions with their spans, a few megabytes at a time; a source is encoded once."""
    names = ["version_id", "key", "start_byte", "end_byte", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column("source").cast(pa.binary())
            ids, keys = batch.column("version_id"), batch.column("ingestion_key")
            first, last, of, texts, size = [], [], [], [], 0

            def made() -> pa.RecordBatch:
                at = pa.array(of, pa.int64())
                return pa.RecordBatch.from_arrays([ids.take(at), keys.take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())], names)

            for i, (source, starts, ends) in enumerate(zip(sources, batch.column("starts"), batch.column("ends"))):
                raw = source.as_py()
                for a, b in zip(starts.as_py(), ends.as_py()):
                    first.append(a)
                    last.append(b)
                    of.append(i)
                    texts.append(raw[a:b])
                    size += b - a
                    if size > SPAN_BATCH:
                        yield made()
                        first, last, of, texts, size = [], [], [], [], 0
            if of:
                yield made()

    rows = versions.select("version_id", "ingestion_key", "source", F.col("spans.start_byte").alias("starts"), F.col("spans.end_byte").alias("ends"))
    return rows.mapInArrow(run, "version_id string, key string, start_byte int, end_byte int, text string")


def stage(evidence: Evidence, corpus: str, docs: DataFrame, spans: DataFrame | None = None, span_bytes: int = 4096) -> DataFrame:
    """Keeps versions of (asset_id, path, source, ingestion_key[, expected_revision][, spans]) rows; (ingestion_key, version_id, problem).

    Spans are those of ``spans`` (ingestion_key, start_byte, end_byte), else the array that a
    row brings, else whole lines of at most ``span_bytes``.  Without ``expected_revision`` a version
    is based on its asset's revision now.  The same request under one key changes nothing.

    Rows are judged without their sources; these move once, to the table of versions.
    """

    def body(s: Snapshot, c: Changes, config: Config) -> DataFrame:
        expected = F.col("expected_revision") if "expected_revision" in docs.columns else F.lit(None)
        own = [F.col("spans").cast(SPANS).alias("spans")] if spans is None and "spans" in docs.columns else []
        rows = docs.select(F.lower("asset_id").alias("asset_id"), "path", "source", "ingestion_key", expected.cast("long").alias("expected"), *own)
        assets = s.table("assets").select("asset_id", "content_revision")
        before = s.table("versions").select("ingestion_key", F.col("request_sha256").alias("old_sha256"), F.col("version_id").alias("old_id"))

        def cut(rows: DataFrame) -> DataFrame:
            rows = rows.withColumn("source_sha256", utf8.sha256_hex(F.col("source")))
            if spans is not None:
                lists = spans.groupBy("ingestion_key").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).cast(SPANS).alias("spans"))
                rows = rows.join(lists, "ingestion_key", "left")
            return _with_spans(rows, span_bytes, spans is not None or bool(own), config).withColumn("problem", F.lit(None).cast("string"))

        rows = _sift(rows, [
            (F.col("source").isNull() | F.col("path").isNull() | F.col("ingestion_key").isNull() | F.col("asset_id").isNull(), "missing_field"),
            (~F.col("asset_id").rlike(UUID_FORM), "asset_id"), (_text_flaw("path", MAX_PATH_BYTES), "path"), (_text_flaw("ingestion_key", MAX_KEY_BYTES), "ingestion_key"),
            (F.octet_length("source") > config.limits.max_source_bytes, "max_source_bytes"), (F.instr("source", "\0") > 0, "source"), (F.col("expected") < 0, "expected_revision"),
        ], cut)
        rows = c.kept(rows.withColumn("row", F.monotonically_increasing_id()))  # asked for once here, read by all that follows
        sound = rows.where("problem is null")
        judged = sound.select("row", "asset_id", "path", "ingestion_key", "expected", "source_sha256", "span_flaw", _pairs().alias("pairs")).join(assets, "asset_id", "left").join(before, "ingestion_key", "left")
        judged = judged.withColumn("base_revision", F.coalesce("expected", "content_revision", F.lit(0).cast("long")))
        judged = judged.withColumn("request_sha256", _request_sha256()).withColumn("first", _first("ingestion_key", "request_sha256"))
        judged = judged.withColumn("problem", (
            F.when(F.col("span_flaw").isNotNull(), F.col("span_flaw"))
            .when((F.col("old_sha256") != F.col("request_sha256")) | ~F.col("first"), "ingestion_key_reused")
            .when(F.col("content_revision").isNull() & (F.col("base_revision") != 0), "revision_conflict")
        )).withColumn("version_id", F.coalesce("old_id", _id("version", "ingestion_key")))
        judged = c.kept(judged.drop("pairs", "span_flaw", "source_sha256", "path"))
        fits = F.col("problem").isNull() & F.col("old_id").isNull()
        now, new = _now(), judged.where(fits)
        texts = sound.select("row", "path", "source", "source_sha256", "ingestion_key", "spans")
        c.append("versions", texts.drop("spans").join(new.drop("ingestion_key"), "row").select(
            "version_id", "asset_id", "path", "source", "source_sha256", F.octet_length("source").alias("byte_length"), "ingestion_key", "request_sha256", "base_revision",
            F.lit(evidence.user).alias("created_by"), now.alias("created_at"),
        ))
        # A new version's id follows from its key.  As a rule few rows are left out, so they are broadcast by their size.
        others = c.kept(judged.where(~fits).select("row"))
        fresh_texts = texts.join(others, "row", "left_anti").withColumn("version_id", _id("version", "ingestion_key"))
        c.append("spans", _span_rows(fresh_texts).select(_id("span", "key", F.col("start_byte").cast("string"), F.col("end_byte").cast("string")).alias("evidence_id"), "version_id", "start_byte", "end_byte", "text", fulltext.tokens(F.col("text")).alias("tokens")))
        fresh = new.where("content_revision is null").select("asset_id").distinct()
        zero = F.lit(0).cast("long")
        c.append("assets", fresh.select("asset_id", F.lit(None).alias("current_version_id"), F.lit(None).alias("current_path"), zero.alias("content_revision"), zero.alias("annotation_revision"), F.lit(None).alias("retired_at"), now.alias("created_at")))
        told = judged.select("ingestion_key", F.when(F.col("problem").isNull(), F.col("version_id")).alias("version_id"), "problem")
        return told.unionByName(rows.where("problem is not null").select("ingestion_key", F.lit(None).cast("string").alias("version_id"), "problem"))

    return _run(evidence, corpus, body)


def publish(evidence: Evidence, corpus: str, versions: DataFrame) -> DataFrame:
    """Makes staged versions (version_id) current; (version_id, revision, problem).  Of several versions of an asset one can win."""

    def body(s: Snapshot, c: Changes, config: Config) -> DataFrame:
        known = s.table("versions").select("version_id", "asset_id", "path", "base_revision", "ingestion_key")
        assets = s.table("assets").select("asset_id", "content_revision")
        taken = s.table("assets").where("current_path is not null").select(F.col("current_path").alias("path"), F.col("asset_id").alias("path_owner"))
        rows = versions.select("version_id").where("version_id is not null").distinct().join(known, "version_id", "left").join(assets, "asset_id", "left")
        rows = rows.join(s.table("publications").select("version_id", F.col("revision").alias("published")), "version_id", "left")
        rows = rows.join(s.table("tombstones").select("version_id", F.lit(True).alias("purged")), "version_id", "left")
        bare = F.lit(None).cast("long")
        if config.embedding_model is not None:
            lacking = s.table("spans").join(versions.select("version_id"), "version_id", "left_semi").join(s.table("embeddings").select("evidence_id"), "evidence_id", "left_anti")
            rows = rows.join(lacking.groupBy("version_id").agg(F.count("*").alias("lacking")), "version_id", "left")
            bare = F.col("lacking")

        def judge(rows: DataFrame) -> DataFrame:
            """Those that could go: one a path and asset, as if they came one by one in the order of their keys."""
            rows = rows.join(taken, "path", "left").withColumn("first", _first("asset_id", "ingestion_key")).withColumn("free", _first("path", "ingestion_key"))
            return rows.withColumn("problem", F.when(~F.col("first"), "revision_conflict").when((F.col("path_owner") != F.col("asset_id")) | ~F.col("free"), "path_in_use"))

        fresh = _sift(rows.where("published is null"), [
            (F.col("path").isNull(), "unknown_version"), (F.col("purged"), "version_purged"),
            (F.col("base_revision") != F.col("content_revision"), "revision_conflict"), (bare > 0, "embeddings_missing"),
        ], judge)
        fresh = c.kept(fresh)
        now, won = _now(), fresh.where("problem is null").withColumn("revision", F.col("base_revision") + 1)
        c.append("publications", won.select("asset_id", "version_id", "revision", F.lit(evidence.user).alias("published_by"), now.alias("published_at")))
        moved = won.select("asset_id", F.col("version_id").alias("v"), F.col("path").alias("p"), F.col("revision").alias("r"))
        c.rewrite("assets", moved.select("asset_id"), lambda df: df.join(moved, "asset_id", "left").withColumns({
            "current_version_id": F.coalesce("v", "current_version_id"), "current_path": F.coalesce("p", "current_path"), "content_revision": F.coalesce("r", "content_revision"),
            "retired_at": F.when(F.col("v").isNull(), F.col("retired_at")),
        }))
        out = fresh.select("version_id", F.when(F.col("problem").isNull(), F.col("base_revision") + 1).alias("revision"), "problem")
        return out.unionByName(rows.where("published is not null").select("version_id", F.col("published").alias("revision"), F.lit(None).cast("string").alias("problem")))

    return _run(evidence, corpus, body)


def load(evidence: Evidence, corpus: str, docs: DataFrame, span_bytes: int = 4096) -> DataFrame:
    """Stages, then publishes (asset_id, path, source, ingestion_key) rows; (ingestion_key, version_id, problem).

    Two commits; a load that stopped between them goes on when it is run again.
    Collections with embeddings need vectors between ``stage`` and ``publish``.
    """
    staged = stage(evidence, corpus, docs, span_bytes=span_bytes)
    done = publish(evidence, corpus, staged.where("problem is null"))
    both = staged.join(done.select("version_id", F.col("problem").alias("unpublished")), "version_id", "left")
    return both.select("ingestion_key", "version_id", F.coalesce("problem", "unpublished").alias("problem"))


def retire(evidence: Evidence, corpus: str, assets: DataFrame) -> DataFrame:
    """Takes (asset_id, expected_revision) assets out of retrieval; (asset_id, problem)."""

    def body(s: Snapshot, c: Changes, config: Config) -> DataFrame:
        have = s.table("assets").select("asset_id", "content_revision")
        rows = assets.select(F.lower("asset_id").alias("asset_id"), "expected_revision").where("asset_id is not null").dropDuplicates(["asset_id"]).join(have, "asset_id", "left")
        rows = rows.withColumn("problem", F.when(F.col("content_revision").isNull(), "unknown_asset").when(~F.col("content_revision").eqNullSafe(F.col("expected_revision")), "revision_conflict"))
        rows, now = c.kept(rows), _now()
        gone = rows.where("problem is null").select("asset_id", F.lit(True).alias("gone"))
        stays = F.col("gone").isNull()
        c.rewrite("assets", gone.select("asset_id"), lambda df: df.join(gone, "asset_id", "left").withColumns({
            "current_version_id": F.when(stays, F.col("current_version_id")), "current_path": F.when(stays, F.col("current_path")),
            "content_revision": F.col("content_revision") + F.when(stays, 0).otherwise(1), "retired_at": F.when(stays, F.col("retired_at")).otherwise(now),
        }))
        return rows.select("asset_id", "problem")

    return _run(evidence, corpus, body)


def purge(evidence: Evidence, corpus: str, versions: DataFrame) -> DataFrame:
    """Removes the text of (version_id, reason) versions for good; (version_id, problem)."""
    evidence._may("purger")

    def body(s: Snapshot, c: Changes, config: Config) -> DataFrame:
        known = s.table("versions").select("version_id", "asset_id")
        rows = versions.select("version_id", "reason").where("version_id is not null").dropDuplicates(["version_id"]).join(known, "version_id", "left")
        rows = rows.join(s.table("assets").select(F.col("current_version_id").alias("version_id"), F.lit(True).alias("live")), "version_id", "left")
        rows = rows.join(s.table("tombstones").select("version_id", F.lit(True).alias("purged")), "version_id", "left")
        rows = c.kept(rows.withColumn("problem", (
            F.when(F.col("reason").isNull() | _text_flaw("reason", MAX_REASON_BYTES), "reason").when(F.col("asset_id").isNull(), "unknown_version")
            .when(F.col("live") & F.col("purged").isNull(), "version_current")
        )))
        new, now = rows.where("problem is null and purged is null"), _now()
        gone = new.select("version_id", F.lit(True).alias("gone"))

        def blank(*names: str) -> Callable[[DataFrame], DataFrame]:
            return lambda df: df.join(gone, "version_id", "left").withColumns({n: F.when(F.col("gone").isNull(), F.col(n)) for n in names})

        keys = gone.select("version_id")
        ids = s.table("spans").join(keys, "version_id", "left_semi").select("evidence_id")
        c.rewrite("versions", keys, blank("source"))
        c.rewrite("spans", keys, blank("text", "tokens"))
        c.rewrite("embeddings", ids, lambda df: df.join(ids, "evidence_id", "left_anti"))
        c.append("tombstones", new.select("version_id", F.lit(evidence.user).alias("purged_by"), now.alias("purged_at"), "reason"))
        return rows.select("version_id", "problem")

    return _run(evidence, corpus, body)


# ---- annotations and vectors ------------------------------------------------


def tag(evidence: Evidence, corpus: str, tags: DataFrame, add: bool = True) -> DataFrame:
    """Adds (asset_id, tag) rows, or removes them; (asset_id, tag, problem).  Each asset named gets its next annotation revision."""

    def body(s: Snapshot, c: Changes, config: Config) -> DataFrame:
        rows = tags.select(F.lower("asset_id").alias("asset_id"), "tag").distinct()
        have = s.table("tags").select("asset_id", "tag", F.lit(True).alias("have"))

        def judge(rows: DataFrame) -> DataFrame:
            known = s.table("assets").select("asset_id", F.lit(True).alias("known"))
            return rows.join(known, "asset_id", "left").join(have, ["asset_id", "tag"], "left").withColumn("problem", F.when(F.col("known").isNull(), "unknown_asset"))

        rows = c.kept(_sift(rows, [(F.col("asset_id").isNull() | F.col("tag").isNull(), "missing_field"), (_text_flaw("tag", MAX_TAG_BYTES), "tag")], judge))
        good = rows.where("problem is null")
        if add:
            c.append("tags", good.where("have is null").select("asset_id", "tag", F.lit(evidence.user).alias("created_by"), _now().alias("created_at")))
        else:
            keys = good.where("have").select("asset_id", "tag")
            c.rewrite("tags", keys, lambda df: df.join(keys, ["asset_id", "tag"], "left_anti"))
        named = good.select("asset_id", F.lit(1).alias("named")).distinct()
        c.rewrite("assets", named.select("asset_id"), lambda df: df.join(named, "asset_id", "left").withColumn("annotation_revision", F.col("annotation_revision") + F.coalesce("named", F.lit(0))))
        return rows.select("asset_id", "tag", "problem")

    return _run(evidence, corpus, body)


def link(evidence: Evidence, corpus: str, links: DataFrame, add: bool = True) -> DataFrame:
    """Adds (source_evidence_id, kind, target_evidence_id) rows, or removes them; these with ``problem``."""
    names = ["source_evidence_id", "kind", "target_evidence_id"]

    def body(s: Snapshot, c: Changes, config: Config) -> DataFrame:
        have = s.table("relations").select(*names, F.lit(True).alias("have"))
        known = s.table("spans").select("evidence_id")

        def judge(rows: DataFrame) -> DataFrame:
            rows = rows.join(have, names, "left")
            if not add:
                return rows.withColumn("problem", F.lit(None).cast("string"))
            for end in (names[0], names[2]):
                rows = rows.join(known.select(F.col("evidence_id").alias(end), F.lit(True).alias(f"{end}_known")), end, "left")
            return rows.withColumn("problem", F.when(F.col(f"{names[0]}_known").isNull() | F.col(f"{names[2]}_known").isNull(), "unknown_evidence"))

        rows = c.kept(_sift(links.select(*names).distinct(), [
            (F.col(names[0]).isNull() | F.col(names[1]).isNull() | F.col(names[2]).isNull(), "missing_field"),
            (~F.col("kind").rlike("^[a-z][a-z0-9_]{0,62}$"), "kind"), (F.col(names[0]) == F.col(names[2]), "target_evidence_id"),
        ], judge))
        good = rows.where("problem is null")
        if add:
            c.append("relations", good.where("have is null").select(*names, F.lit(evidence.user).alias("asserted_by"), _now().alias("asserted_at")))
        else:
            keys = good.where("have").select(*names)
            c.rewrite("relations", keys, lambda df: df.join(keys, names, "left_anti"))
        return rows.select(*names, "problem")

    return _run(evidence, corpus, body)


def attach(evidence: Evidence, corpus: str, vectors: DataFrame) -> DataFrame:
    """Adds (evidence_id, embedding) vectors to spans of unpublished versions; (evidence_id, problem).  Equal vectors again change nothing."""

    def body(s: Snapshot, c: Changes, config: Config) -> DataFrame:
        if config.embedding_model is None:
            raise EvidenceError("22023", "embeddings_not_configured", "the collection stores no embeddings")
        span = s.table("spans").select("evidence_id", "version_id", F.lit(True).alias("known"))
        closed = s.table("publications").select("version_id", F.lit("version_published").alias("closed")).unionByName(s.table("tombstones").select("version_id", F.lit("version_purged").alias("closed")))
        closed = closed.groupBy("version_id").agg(F.max("closed").alias("closed"))
        have = s.table("embeddings").select("evidence_id", F.col("embedding").alias("have"))

        def judge(rows: DataFrame) -> DataFrame:
            rows = rows.join(span, "evidence_id", "left").join(closed, "version_id", "left").join(have, "evidence_id", "left").withColumn("first", _first("evidence_id", "embedding"))
            purged, same = F.col("closed") == "version_purged", F.col("have") == F.col("embedding")
            return rows.withColumn("problem", (
                F.when(F.col("known").isNull(), "unknown_evidence").when(purged, "version_purged").when(~F.col("first") | ~same, "embedding_conflict")
                .when(F.col("have").isNull(), F.col("closed"))
            ))

        number_flaw = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall("embedding", lambda x: x == 0)
        rows = c.kept(_sift(vectors.select("evidence_id", F.col("embedding").cast("array<float>").alias("embedding")), [
            (F.col("evidence_id").isNull() | F.col("embedding").isNull(), "missing_field"), (F.size("embedding") != config.embedding_dimensions, "dimensions"), (number_flaw, "embedding"),
        ], judge))
        c.append("embeddings", rows.where("problem is null and have is null").select("evidence_id", "embedding"))
        return rows.select("evidence_id", "problem")

    return _run(evidence, corpus, body)
