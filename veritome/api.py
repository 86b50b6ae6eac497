"""The nine calls of a corpus, on a warehouse folder.

Requests are dicts or JSON texts, responses JSON texts of exact bytes.  Every call commits for
itself; a query or resolve reads one snapshot.
"""

from __future__ import annotations

import datetime as dt
import threading
import uuid as uuids
from dataclasses import replace
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veritome.errors import CANCELLED, FORBIDDEN, INVALID, EvidenceError, invalid, precondition, revision_conflict, unique, unknown
from veritome.functions import fulltext
from veritome.operators.tables import Tables, version_status
from veritome.plans.compile import compile_plan, fetched
from veritome.plans.plan import parse_plan
from veritome.render import fit, render_query, render_resolve
from veritome.requests import (
    SCHEMA_VERSION, Config, Limits, Stage, TagChange, corpus_name, decode, parse_annotate, parse_attach, parse_config, parse_publish, parse_purge, parse_retire, parse_stage, uuid,
)
from veritome.sources.store import Changes, Snapshot, Store

ROLES = ("reader", "writer", "purger")
PLACEHOLDER = "00000000-0000-0000-0000-000000000000"


def _new_id() -> str:
    return str(uuids.uuid4())


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _stamp(t: dt.datetime) -> str:
    return t.isoformat(timespec="microseconds") + "+00:00"


class Evidence:
    """A session: ``role`` bounds what it may do, ``timeout`` (seconds) what a query may take."""

    def __init__(self, spark: SparkSession, warehouse: str, role: str = "purger", user: str = "local", timeout: float | None = 60.0) -> None:
        if role not in ROLES:
            raise ValueError(f"role must be one of {', '.join(ROLES)}")
        self.spark, self.warehouse, self.role, self.user, self.timeout = spark, warehouse, role, user, timeout

    # ---- shared -----------------------------------------------------------------

    def _store(self, corpus: str) -> Store:
        return Store(self.spark, self.warehouse, corpus_name(corpus))

    def _may(self, role: str) -> None:
        if ROLES.index(self.role) < ROLES.index(role):
            raise EvidenceError(FORBIDDEN, f"{role}_required", f"this call needs the role {role}")

    @staticmethod
    def _config(snapshot: Snapshot) -> Config:
        rows = [r.asDict() for r in snapshot.table("collection_config").collect()]
        if len(rows) != 1:
            raise precondition("invalid_collection_config", "the corpus needs exactly one configuration row")
        c = rows[0]
        if c["schema_version"] != SCHEMA_VERSION:
            raise precondition("unsupported_schema_version", f"schema version {c['schema_version']} is not supported")
        return Config(c["embedding_model"], c["embedding_dimensions"], c["text_search_config"], Limits(*(c[k] for k in Limits.__dataclass_fields__)))

    @staticmethod
    def _version(s: Snapshot, version_id: str) -> dict:
        rows = s.rows("versions", F.col("version_id") == version_id, "version_id", "asset_id", "path", "base_revision")
        if not rows:
            raise unknown("unknown_version", "version_id", f"unknown version_id {version_id}")
        return rows[0]

    @staticmethod
    def _asset(s: Snapshot, asset_id: str) -> dict:
        rows = s.rows("assets", F.col("asset_id") == asset_id)
        if not rows:
            raise unknown("unknown_asset", "asset_id", f"unknown asset_id {asset_id}")
        return rows[0]

    @staticmethod
    def _set_asset(c: Changes, asset_id: str, **values: Any) -> None:
        def change(df):
            mine = F.col("asset_id") == asset_id
            return df.withColumns({k: F.when(mine, F.lit(v).cast(df.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})

        c.rewrite("assets", F.col("asset_id") == asset_id, change)

    def _mutate(self, corpus: str, body) -> str:
        """Runs ``body(snapshot, changes, config)`` in a commit; a response that is too large writes nothing."""

        def run(s: Snapshot, c: Changes) -> str:
            config = self._config(s)
            return fit(body(s, c, config), config.limits.max_response_bytes)

        return self._store(corpus).transact(run)

    # ---- writing ----------------------------------------------------------------

    def init_collection(self, corpus: str, config: Any) -> None:
        self._may("writer")
        store = self._store(corpus)
        store.create(parse_config(decode(config)), _now())

    def stage_version(self, corpus: str, request: Any) -> str:
        """Keeps a version of a document and its spans; the same request under one key gives the same ids."""
        self._may("writer")

        def body(s: Snapshot, c: Changes, config: Config) -> dict:
            req = parse_stage(decode(request), config.limits.max_source_bytes)
            # Ids have one length, so the response's size is known before anything is looked up.
            fit(self._staged(req, False, PLACEHOLDER, [PLACEHOLDER] * len(req.spans)), config.limits.max_response_bytes)
            digest = req.request_sha256()
            before = s.rows("versions", F.col("ingestion_key") == req.ingestion_key, "version_id", "request_sha256")
            if before:
                version_id = before[0]["version_id"]
                if before[0]["request_sha256"] != digest:
                    raise unique("ingestion_key_reused", "ingestion_key was already used for a different request", version_id=version_id)
                ids = {(r["start_byte"], r["end_byte"]): r["evidence_id"] for r in s.rows("spans", F.col("version_id") == version_id, "evidence_id", "start_byte", "end_byte")}
                return self._staged(req, True, version_id, [ids[x] for x in req.spans])
            now = _now()
            if not s.rows("assets", F.col("asset_id") == req.asset_id, "asset_id"):
                if req.expected_revision:
                    raise revision_conflict("content_revision of a new asset", 0, req.expected_revision)
                c.append("assets", [{"asset_id": req.asset_id, "content_revision": 0, "annotation_revision": 0, "created_at": now}])
            version_id, ids, raw = _new_id(), [_new_id() for _ in req.spans], req.source.encode()
            c.append("versions", [{
                "version_id": version_id, "asset_id": req.asset_id, "path": req.path, "source": req.source, "source_sha256": req.source_sha256, "byte_length": len(raw),
                "ingestion_key": req.ingestion_key, "request_sha256": digest, "base_revision": req.expected_revision, "created_by": self.user, "created_at": now,
            }])
            texts = [raw[a:b].decode() for a, b in req.spans]
            c.append("spans", [
                {"evidence_id": i, "version_id": version_id, "start_byte": a, "end_byte": b, "text": t} for i, (a, b), t in zip(ids, req.spans, texts)
            ], tokens=fulltext.tokens(F.col("text")))
            return self._staged(req, False, version_id, ids)

        return self._mutate(corpus, body)

    @staticmethod
    def _staged(req: Stage, replayed: bool, version_id: str, ids: list[str]) -> dict:
        return {
            "status": "staged", "replayed": replayed, "version_id": version_id, "asset_id": req.asset_id, "path": req.path, "source_sha256": req.source_sha256,
            "byte_length": len(req.source.encode()), "base_revision": req.expected_revision,
            "spans": [{"evidence_id": i, "start_byte": a, "end_byte": b} for i, (a, b) in zip(ids, req.spans)],
        }

    def attach_embeddings(self, corpus: str, request: Any) -> None:
        """Adds vectors to a version's spans before it is published; equal vectors again change nothing."""
        self._may("writer")

        def run(s: Snapshot, c: Changes) -> None:
            config = self._config(s)
            if config.embedding_model is None:
                raise EvidenceError(INVALID, "embeddings_not_configured", "this collection has no embedding configuration")
            value = decode(request)
            given = value.get("version_id") if isinstance(value, dict) else None
            if given is None:
                raise invalid("version_id", "version_id is required")
            version_id = uuid(given, "version_id")
            self._version(s, version_id)
            mine = F.col("version_id") == version_id
            if s.rows("tombstones", mine, "version_id"):
                raise precondition("version_purged", f"version {version_id} is purged")
            _, vectors = parse_attach(value, config.embedding_model, config.embedding_dimensions)
            known = {r["evidence_id"] for r in s.rows("spans", mine, "evidence_id")}
            for i, (evidence_id, _) in enumerate(vectors):
                if evidence_id not in known:
                    raise unknown("evidence_not_in_version", f"embeddings[{i}].evidence_id", f"{evidence_id} is not a span of version {version_id}")
            stored = {r["evidence_id"]: r["embedding"] for r in s.rows("embeddings", F.col("evidence_id").isin([i for i, _ in vectors]))}
            for evidence_id, value in vectors:
                if evidence_id in stored and list(stored[evidence_id]) != value:
                    raise unique("embedding_conflict", f"a different embedding is stored for {evidence_id}", evidence_id=evidence_id)
            missing = [(i, v) for i, v in vectors if i not in stored]
            if missing and s.rows("publications", mine, "version_id"):
                raise precondition("version_published", f"version {version_id} is published; its embeddings cannot change")
            c.append("embeddings", [{"evidence_id": i, "embedding": v} for i, v in missing])

        self._store(corpus).transact(run)

    def publish_version(self, corpus: str, request: Any) -> str:
        """Makes a staged version its asset's current one, if nothing came in between."""
        self._may("writer")

        def body(s: Snapshot, c: Changes, config: Config) -> dict:
            version_id = parse_publish(decode(request))
            v = self._version(s, version_id)
            asset, mine = self._asset(s, v["asset_id"]), F.col("version_id") == version_id
            out = {"status": "published", "replayed": True, "version_id": version_id, "asset_id": v["asset_id"]}
            if before := s.rows("publications", mine):
                p = before[0]
                return out | {"revision": p["revision"], "path": v["path"], "published_at": _stamp(p["published_at"]), "published_by": p["published_by"], "current": asset["current_version_id"] == version_id}
            if s.rows("tombstones", mine, "version_id"):
                raise precondition("version_purged", f"version {version_id} is purged")
            if v["base_revision"] != asset["content_revision"]:
                raise revision_conflict("the asset's content_revision", asset["content_revision"], v["base_revision"], base_revision=v["base_revision"], version_id=version_id)
            if config.embedding_model is not None:
                missing = s.table("spans").where(mine).join(s.table("embeddings").select("evidence_id"), "evidence_id", "left_anti").count()
                if missing:
                    raise precondition("embeddings_missing", f"{missing} spans of version {version_id} lack embeddings", missing=missing)
            taken = s.rows("assets", (F.col("current_path") == v["path"]) & (F.col("asset_id") != v["asset_id"]), "asset_id")
            if taken:
                raise unique("path_in_use", f"another asset is current at {v['path']}", path=v["path"])
            now, revision = _now(), asset["content_revision"] + 1
            c.append("publications", [{"asset_id": v["asset_id"], "version_id": version_id, "revision": revision, "published_by": self.user, "published_at": now}])
            self._set_asset(c, v["asset_id"], current_version_id=version_id, current_path=v["path"], content_revision=revision, retired_at=None)
            return out | {"replayed": False, "revision": revision, "path": v["path"], "published_at": _stamp(now), "published_by": self.user, "current": True}

        return self._mutate(corpus, body)

    def retire(self, corpus: str, request: Any) -> str:
        """Takes an asset out of retrieval; its versions stay."""
        self._may("writer")

        def body(s: Snapshot, c: Changes, config: Config) -> dict:
            asset_id, expected = parse_retire(decode(request))
            asset = self._asset(s, asset_id)
            if asset["content_revision"] != expected:
                raise revision_conflict("the asset's content_revision", asset["content_revision"], expected)
            now = _now()
            self._set_asset(c, asset_id, current_version_id=None, current_path=None, retired_at=now, content_revision=expected + 1)
            return {"status": "retired", "asset_id": asset_id, "content_revision": expected + 1, "retired_at": _stamp(now)}

        return self._mutate(corpus, body)

    def annotate(self, corpus: str, request: Any) -> str:
        """Tags of an asset, or relations between spans."""
        self._may("writer")

        def body(s: Snapshot, c: Changes, config: Config) -> dict:
            change = parse_annotate(decode(request))
            return self._tag(s, c, change) if isinstance(change, TagChange) else self._link(s, c, change)

        return self._mutate(corpus, body)

    def _tag(self, s: Snapshot, c: Changes, change: TagChange) -> dict:
        asset = self._asset(s, change.asset_id)
        if asset["annotation_revision"] != change.expected:
            raise revision_conflict("the asset's annotation_revision", asset["annotation_revision"], change.expected)
        mine = (F.col("asset_id") == change.asset_id) & F.col("tag").isin(list(change.tags))
        have = {r["tag"] for r in s.rows("tags", mine, "tag")}
        if change.add:
            done = sorted(set(change.tags) - have)
            c.append("tags", [{"asset_id": change.asset_id, "tag": t, "created_by": self.user, "created_at": _now()} for t in done])
        else:
            done = sorted(have)
            c.rewrite("tags", mine, lambda df: df.where(~mine))
        self._set_asset(c, change.asset_id, annotation_revision=change.expected + 1)
        return {"status": "annotated", "action": "tag" if change.add else "untag", "asset_id": change.asset_id, "annotation_revision": change.expected + 1, "added" if change.add else "removed": done}

    def _link(self, s: Snapshot, c: Changes, change) -> dict:
        key = {"source_evidence_id": change.source, "kind": change.kind, "target_evidence_id": change.target}
        mine = (F.col("source_evidence_id") == change.source) & (F.col("kind") == change.kind) & (F.col("target_evidence_id") == change.target)
        have = s.rows("relations", mine)
        if not change.add:
            c.rewrite("relations", mine, lambda df: df.where(~mine))
            return {"status": "unlinked" if have else "absent", **key}
        known = {r["evidence_id"] for r in s.rows("spans", F.col("evidence_id").isin([change.source, change.target]), "evidence_id")}
        for field, value in (("source_evidence_id", change.source), ("target_evidence_id", change.target)):
            if value not in known:
                raise unknown("unknown_evidence", field, f"unknown {field} {value}")
        if have:
            return {"status": "existing", **key, "asserted_by": have[0]["asserted_by"], "asserted_at": _stamp(have[0]["asserted_at"])}
        now = _now()
        c.append("relations", [{**key, "asserted_by": self.user, "asserted_at": now}])
        return {"status": "linked", **key, "asserted_by": self.user, "asserted_at": _stamp(now)}

    def purge(self, corpus: str, request: Any) -> str:
        """Removes a version's text for good; ids, offsets and digests stay.  ``vacuum`` then removes the old files."""

        def body(s: Snapshot, c: Changes, config: Config) -> dict:
            version_id, reason = parse_purge(decode(request))
            self._may("purger")
            v, mine = self._version(s, version_id), F.col("version_id") == version_id
            out = {"status": "purged", "replayed": True, "version_id": version_id, "asset_id": v["asset_id"]}
            if before := s.rows("tombstones", mine):
                x = before[0]
                return out | {"purged_at": _stamp(x["purged_at"]), "purged_by": x["purged_by"], "reason": x["reason"], "spans_purged": 0, "embeddings_deleted": 0}
            if self._asset(s, v["asset_id"])["current_version_id"] == version_id:
                raise precondition("version_current", f"version {version_id} is current; publish another version or retire the asset first")
            ids = s.table("spans").where(mine).select("evidence_id")
            spans, vectors = ids.count(), s.table("embeddings").join(ids, "evidence_id", "left_semi").count()
            blank = lambda *names: lambda df: df.withColumns({n: F.when(~mine, F.col(n)) for n in names})
            c.rewrite("versions", mine, blank("source"))
            c.rewrite("spans", mine, blank("text", "tokens"))
            if vectors:
                hit = F.col("evidence_id").isin([r[0] for r in ids.collect()])
                c.rewrite("embeddings", hit, lambda df: df.where(~hit))
            now = _now()
            c.append("tombstones", [{"version_id": version_id, "purged_by": self.user, "purged_at": now, "reason": reason}])
            return out | {"replayed": False, "purged_at": _stamp(now), "purged_by": self.user, "reason": reason, "spans_purged": spans, "embeddings_deleted": vectors}

        self._may("reader")
        return self._mutate(corpus, body)

    def exists(self, corpus: str) -> bool:
        return self._store(corpus).exists()

    def rename(self, corpus: str, name: str) -> None:
        """Gives a corpus another name."""
        self._may("writer")
        self._store(corpus).rename(corpus_name(name))

    def tables(self, corpus: str) -> Tables:
        """All tables of the newest commit."""
        return self._store(corpus).snapshot().tables()

    def vacuum(self, corpus: str) -> int:
        self._may("purger")
        return self._store(corpus).vacuum()

    # ---- reading ----------------------------------------------------------------

    def query(self, corpus: str, request: Any) -> str:
        """Runs a plan over one snapshot and renders it within its byte budget."""
        s = self._store(corpus).snapshot()
        config = self._config(s)
        if not self.timeout:
            raise precondition("statement_timeout_unset", "a query needs a timeout above zero")
        plan = parse_plan(decode(request), config)
        with _Deadline(self.spark, self.timeout):
            compiled = compile_plan(plan, s.tables())
            results = [r.asDict() for r in compiled.results().collect()]
            edges = [r.asDict() for r in compiled.edge_rows().orderBy("node", "edge_rn").collect()]
            stats = [r.asDict() for r in compiled.stats().orderBy("node").collect()]
        return render_query(plan, results, edges, stats, "ready" if config.embedding_model else "not_configured")

    @staticmethod
    def _resolved(s: Snapshot, evidence_id: str, max_source_bytes: int) -> list:
        """The span's row with its version, status and tombstone; tables are searched by key, so none is moved."""
        span = fetched(s.holding("spans", "evidence_id", evidence_id).drop("tokens"))
        if not (near := span.select("version_id").collect()):
            return []
        # A source over the limit stays where it is.
        source = F.when(F.octet_length("source") <= max_source_bytes, F.col("source"))
        version_id = near[0].version_id
        version = fetched(s.holding("versions", "version_id", version_id).withColumn("source_octets", F.octet_length("source")).withColumn("source", source))
        t, mine = s.tables(), F.col("version_id") == version_id
        assets = t.assets.where(F.col("asset_id").isin([r.asset_id for r in version.select("asset_id").collect()]))
        t = replace(t, versions=version, assets=fetched(assets), publications=fetched(t.publications.where(mine)), tombstones=fetched(t.tombstones.where(mine)))
        rows = span.join(version.drop("asset_id", "path"), "version_id").join(version_status(t), "version_id").join(t.tombstones, "version_id", "left")
        return rows.collect()

    def resolve(self, corpus: str, evidence_id: Any) -> str:
        """One span's exact bytes, verified, or why there are none."""
        s = self._store(corpus).snapshot()
        limits = self._config(s).limits
        wanted = uuid(evidence_id, "evidence_id")
        found = self._resolved(s, wanted, limits.max_source_bytes)
        row = found[0].asDict() if found else None
        if row and row["purged_at"]:
            row["purged_at"] = _stamp(row["purged_at"])
        return render_resolve(row, limits.max_source_bytes, limits.max_response_bytes)


class _Deadline:
    """Cancels the jobs of a block that takes too long."""

    def __init__(self, spark: SparkSession, seconds: float) -> None:
        self.sc, self.group, self.hit = spark.sparkContext, f"query-{uuids.uuid4().hex}", False
        self.timer = threading.Timer(seconds, self._cancel)

    def _cancel(self) -> None:
        self.hit = True
        self.sc.cancelJobGroup(self.group)

    def __enter__(self) -> None:
        self.sc.setJobGroup(self.group, "evidence query", interruptOnCancel=True)
        self.timer.start()

    def __exit__(self, kind, error, trace) -> None:
        self.timer.cancel()
        self.sc.setLocalProperty("spark.jobGroup.id", None)
        if self.hit and kind is not None:
            raise EvidenceError(CANCELLED, "timeout", "the query took longer than its timeout") from error
