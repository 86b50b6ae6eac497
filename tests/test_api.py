import hashlib
import json
import shutil
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from veritome.api import Evidence
from veritome.errors import EvidenceError
from veritome.sources import batch
from veritome.sources.import_files import import_files
from veritome.sources.schema import TABLES
from veritome.streaming.load import load_stream
from veritome.tools import run_tool

A, B = "5d41402a-bc4b-4a76-b971-9d911017c592", "7d793037-a076-4186-974b-0282f2f435e7"


@pytest.fixture()
def store(spark, tmp_path):
    e = Evidence(spark, str(tmp_path))
    e.init_collection("docs", {})
    return e


def request(source, spans, asset=A, path="a.md", key="k1", revision=0):
    return {"asset_id": asset, "path": path, "source": source, "source_sha256": hashlib.sha256(source.encode()).hexdigest(), "spans": [{"start_byte": a, "end_byte": b} for a, b in spans], "ingestion_key": key, "expected_revision": revision}


def put(e, source, spans, publish=True, corpus="docs", **more):
    staged = json.loads(e.stage_version(corpus, request(source, spans, **more)))
    if publish:
        e.publish_version(corpus, {"version_id": staged["version_id"]})
    return staged


def ask(e, *nodes, corpus="docs", **more):
    return json.loads(e.query(corpus, {"nodes": list(nodes), "output": nodes[-1]["id"], **more}))


def texts(got):
    return [r["excerpt"] for r in got["results"]]


def fails(state, reason, call):
    with pytest.raises(EvidenceError) as got:
        call()
    assert (got.value.sqlstate, got.value.reason) == (state, reason)
    return got.value


def test_lifecycle(store):
    source = "﻿café é\r\n😀 end"
    raw = source.encode()
    spans = [(0, len(raw)), (3, 9)]
    first = put(store, source, spans, publish=False)
    assert [s["start_byte"] for s in first["spans"]] == [0, 3] and not first["replayed"]
    again = json.loads(store.stage_version("docs", request(source, spans)))
    assert again["replayed"] and again["spans"] == first["spans"]
    fails("23505", "ingestion_key_reused", lambda: store.stage_version("docs", request(source, spans[:1])))
    e1 = first["spans"][1]["evidence_id"]
    assert json.loads(store.resolve("docs", e1))["status"] == "staged"
    assert ask(store, {"id": "a", "op": "literal", "text": "cafe"})["results"] == []
    done = json.loads(store.publish_version("docs", {"version_id": first["version_id"]}))
    assert done["revision"] == 1 and done["current"] and not done["replayed"]
    cited = json.loads(store.resolve("docs", e1.upper()))
    assert cited["text"] == "café" and cited["verified"] and cited["status"] == "current"
    assert json.loads(store.publish_version("docs", {"version_id": first["version_id"]}))["replayed"]
    fails("55000", "version_current", lambda: store.purge("docs", {"version_id": first["version_id"], "reason": "x"}))
    second = put(store, "new words", [(0, 3), (4, 9)], key="k2", revision=1)
    assert json.loads(store.resolve("docs", e1))["status"] == "historical"
    assert texts(ask(store, {"id": "a", "op": "literal", "text": "w"})) == ["new", "words"]
    stale = put(store, "late", [(0, 4)], publish=False, key="k3", revision=0)
    fails("55000", "revision_conflict", lambda: store.publish_version("docs", {"version_id": stale["version_id"]}))
    gone = json.loads(store.purge("docs", {"version_id": first["version_id"], "reason": "asked"}))
    assert gone["spans_purged"] == 2 and not gone["replayed"]
    assert json.loads(store.purge("docs", {"version_id": first["version_id"], "reason": "again"}))["reason"] == "asked"
    purged = json.loads(store.resolve("docs", e1))
    assert purged["status"] == "purged" and "text" not in purged and purged["reason"] == "asked"
    store.vacuum("docs")
    kept = store._store("docs").snapshot()
    assert not [r for r in kept.rows("versions", F.col("source").contains("cafe"))]
    assert kept.rows("spans", F.col("evidence_id") == e1)[0]["tokens"] is None
    fails("55000", "revision_conflict", lambda: store.retire("docs", {"asset_id": A, "expected_revision": 1}))
    assert json.loads(store.retire("docs", {"asset_id": A, "expected_revision": 2}))["content_revision"] == 3
    assert json.loads(store.resolve("docs", second["spans"][0]["evidence_id"]))["status"] == "retired"
    assert json.loads(store.resolve("docs", str(uuid.uuid4()))) == {"status": "not_found"}
    fails("22023", "unknown_version", lambda: store.publish_version("docs", {"version_id": B}))
    fails("55000", "revision_conflict", lambda: put(store, "x", [], asset=B, key="k9", revision=4))


def test_search_filters_tags_and_hops(store):
    guide = put(store, "retry the call\npurge the cache", [(0, 14), (15, 30)], path="docs/guide.md")
    notes = put(store, "é retry notes", [(0, 14)], asset=B, path="notes/n.md", key="k2")
    fails("23505", "path_in_use", lambda: put(store, "zz", [], asset=str(uuid.uuid4()), path="notes/n.md", key="k3"))
    tagged = json.loads(store.annotate("docs", {"action": "tag", "asset_id": A, "tags": ["x", "b"], "expected_annotation_revision": 0}))
    assert tagged["added"] == ["b", "x"] and tagged["annotation_revision"] == 1
    assert json.loads(store.annotate("docs", {"action": "tag", "asset_id": A, "tags": ["x"], "expected_annotation_revision": 1}))["added"] == []
    store.annotate("docs", {"action": "tag", "asset_id": B, "tags": ["x"], "expected_annotation_revision": 0})
    fails("55000", "revision_conflict", lambda: store.annotate("docs", {"action": "untag", "asset_id": A, "tags": ["x"], "expected_annotation_revision": 0}))
    lit = lambda **f: texts(ask(store, {"id": "a", "op": "literal", "text": "retry", "filter": f}))
    assert lit() == ["retry the call", "é retry notes"]
    assert lit(path_prefix="notes/") == ["é retry notes"] and lit(asset_ids=[A.upper()]) == ["retry the call"]
    assert lit(tags_all=["x", "b"]) == ["retry the call"] and len(lit(tags_any=["x", "zz"])) == 2 and len(lit(tags_all=[])) == 2
    assert json.loads(store.annotate("docs", {"action": "untag", "asset_id": A, "tags": ["b", "zz"], "expected_annotation_revision": 2}))["removed"] == ["b"]
    assert lit(tags_all=["b"]) == []
    assert texts(ask(store, {"id": "r", "op": "regex", "pattern": "^É", "case_insensitive": True})) == ["é retry notes"]
    fails("2201B", "invalid_regular_expression", lambda: ask(store, {"id": "r", "op": "regex", "pattern": "("}))
    g0, g1, n0 = guide["spans"][0]["evidence_id"], guide["spans"][1]["evidence_id"], notes["spans"][0]["evidence_id"]
    link = {"action": "link", "source_evidence_id": g0, "target_evidence_id": n0, "kind": "cites"}
    first = json.loads(store.annotate("docs", link))
    assert first["status"] == "linked" and json.loads(store.annotate("docs", link)) == first | {"status": "existing"}
    store.annotate("docs", link | {"target_evidence_id": g1, "kind": "next"})
    fails("22023", "unknown_evidence", lambda: store.annotate("docs", link | {"target_evidence_id": str(uuid.uuid4())}))
    hop = {"id": "b", "op": "neighbors", "from": "a"}
    start = {"id": "a", "op": "lexical", "query": "retry call"}
    got = ask(store, start, hop)
    assert [r["evidence_id"] for r in got["results"]] == [n0, g1] and [e["kind"] for e in got["edges"]] == ["cites", "next"]
    got = ask(store, start, hop | {"kinds": ["next"]}, {"id": "u", "op": "union", "inputs": ["a", "b"]})
    assert [r["mode"] for r in got["results"]] == ["lexical", "neighbors"] and "rank" in got["results"][0]
    assert got["complete"] and got["readiness"]["semantic"] == "not_configured"
    cut = ask(store, {"id": "a", "op": "literal", "text": "e", "limit": 1}, excerpt_bytes=1)
    assert cut["truncation"]["truncated"] and cut["truncation"]["excerpts_truncated"] and not cut["complete"]
    store.retire("docs", {"asset_id": B, "expected_revision": 1})
    assert ask(store, start, hop | {"status": ["current"]})["results"][0]["evidence_id"] == g1
    assert [r["status"] for r in ask(store, start, hop | {"direction": "out"})["results"]] == ["retired", "current"]
    assert json.loads(store.annotate("docs", {**link, "action": "unlink"}))["status"] == "unlinked"
    assert json.loads(store.annotate("docs", {**link, "action": "unlink"}))["status"] == "absent"
    tool = run_tool(store, "evidence_search", {"corpus": "docs", "query": "retry", "hops": True})
    assert [r["evidence_id"] for r in tool["results"]] == [g0, g1]
    assert run_tool(store, "evidence_cite", {"corpus": "docs", "evidence_id": "x"})["error"] == "22023"
    assert run_tool(store, "other", {})["error"] == "unknown_tool"


def test_embeddings(spark, tmp_path):
    e = Evidence(spark, str(tmp_path))
    e.init_collection("vec", {"embedding_model": "m", "embedding_dimensions": 3})
    staged = put(e, "north east south", [(0, 5), (6, 10), (11, 16)], publish=False, corpus="vec")
    version, ids = staged["version_id"], [s["evidence_id"] for s in staged["spans"]]
    assert fails("55000", "embeddings_missing", lambda: e.publish_version("vec", {"version_id": version})).detail["missing"] == 3
    give = lambda *pairs: e.attach_embeddings("vec", {"version_id": version, "model": "m", "embeddings": [{"evidence_id": i, "vector": v} for i, v in pairs]})
    give((ids[0], [0, 1, 0]), (ids[1], [1, 0, 0]))
    give((ids[0], [0, 1, 0]))
    fails("23505", "embedding_conflict", lambda: give((ids[0], [0, 1, 1])))
    fails("22023", "evidence_not_in_version", lambda: give((A, [0, 1, 1])))
    give((ids[2], [0, -1, 0.1]))
    e.publish_version("vec", {"version_id": version})
    got = ask(e, {"id": "s", "op": "semantic", "model": "m", "vector": [0.1, 0.9, 0]}, corpus="vec")
    assert texts(got) == ["north", "east", "south"] and got["approximate"] and not got["complete"]
    assert got["results"][0]["distance"] == pytest.approx(1 - 0.9 / (0.82**0.5), abs=1e-6)
    e.retire("vec", {"asset_id": A, "expected_revision": 1})
    assert json.loads(e.purge("vec", {"version_id": version, "reason": "r"}))["embeddings_deleted"] == 3
    fails("55000", "version_purged", lambda: give((ids[0], [0, 1, 0])))


def test_roles_limits_timeout_and_schema(spark, tmp_path, store):
    with pytest.raises(EvidenceError):
        store.init_collection("docs", {})
    fails("42P06", "corpus_exists", lambda: store.init_collection("docs", {}))
    fails("42P01", "unknown_corpus", lambda: store.query("nope", {}))
    reader, writer = Evidence(spark, str(tmp_path), "reader"), Evidence(spark, str(tmp_path), "writer")
    fails("42501", "writer_required", lambda: put(reader, "x", []))
    v = put(writer, "x", [(0, 1)], publish=False)
    fails("42501", "purger_required", lambda: writer.purge("docs", {"version_id": v["version_id"], "reason": "r"}))
    fails("55000", "statement_timeout_unset", lambda: Evidence(spark, str(tmp_path), timeout=0).query("docs", {}))
    store.init_collection("tight", {"limits": {"max_response_bytes": 450}})
    put(store, "abcdef", [(0, 1)], publish=False, corpus="tight")
    fails("54000", "response_too_large", lambda: put(store, "abcdef", [(0, n) for n in range(1, 6)], publish=False, corpus="tight", key="k2"))
    assert len(store._store("tight").snapshot().rows("versions", F.lit(True))) == 1
    for name, schema in TABLES.items():
        assert store._store("docs").snapshot().table(name).schema == schema or [(f.name, f.dataType) for f in store._store("docs").snapshot().table(name).schema] == [(f.name, f.dataType) for f in schema]


def test_races(store):
    one = put(store, "one", [(0, 3)], publish=False, key="a")
    two = put(store, "two", [(0, 3)], publish=False, key="b")
    out = []

    def publish(v):
        try:
            out.append(json.loads(store.publish_version("docs", {"version_id": v}))["status"])
        except EvidenceError as error:
            out.append(error.reason)

    jobs = [threading.Thread(target=publish, args=(v["version_id"],)) for v in (one, two)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert sorted(out) == ["published", "revision_conflict"]


def test_commit_lost_to_another_process(store, monkeypatch):
    from veritome.sources import store as module

    put(store, "one", [(0, 3)], publish=False, key="a")
    real, hits = module.Files.create, []

    def create(self, name, text):
        if not hits:  # another writer takes this number
            hits.append(name)
            real(self, name, json.dumps(store._store("docs").snapshot().manifest))
        return real(self, name, text)

    monkeypatch.setattr(module.Files, "create", create)
    put(store, "two", [(0, 3)], publish=False, key="b")
    assert len(store._store("docs").snapshot().rows("versions", F.lit(True))) == 2 and hits


def test_corruption_is_found(store):
    staged = put(store, "abc def", [(0, 3)])
    i = staged["spans"][0]["evidence_id"]

    def damage(table, column, value):
        store._store("docs").transact(lambda s, c: c.rewrite(table, F.lit(True), lambda df: df.withColumn(column, F.lit(value))))

    damage("spans", "text", "abd")
    fails("XX001", "span_mismatch", lambda: store.resolve("docs", i))
    damage("versions", "source", "abd def")
    fails("XX001", "digest_mismatch", lambda: store.resolve("docs", i))


def test_copy_of_a_corpus_answers_alike(spark, store, tmp_path):
    staged = put(store, "abc\ndef", [(0, 3), (4, 7)])
    shutil.copytree(tmp_path / "docs", tmp_path / "copy")
    for span in staged["spans"]:
        assert store.resolve("docs", span["evidence_id"]) == store.resolve("copy", span["evidence_id"])
    q = {"nodes": [{"id": "a", "op": "literal", "text": "e"}], "output": "a"}
    assert store.query("docs", q) == store.query("copy", q)


def test_sets_of_changes(spark, tmp_path):
    e = Evidence(spark, str(tmp_path))
    e.init_collection("sets", {"embedding_model": "m", "embedding_dimensions": 2})
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    told = lambda df: {r[0]: r.problem for r in df.collect()}
    docs = frame("asset_id string, path string, source string, ingestion_key string, expected_revision long", (A, "p", "é b", "k1", 0), (B, "p", "c", "k2", 0), (A, "q", "d", "k3", 1), (B, "r", "e", "k4", 3), (None, "r", "e", None, 0), (None, "r", "e", None, 0))
    spans = frame("ingestion_key string, start_byte int, end_byte int", ("k1", 0, 2), ("k1", 0, 4), ("k2", 0, 1), ("k3", 0, 9), ("k4", 0, 1))
    staged = batch.stage(e, "sets", docs, spans)
    assert told(staged) == {"k1": None, "k2": None, "k3": "spans", "k4": "revision_conflict", None: "missing_field"}
    single = json.loads(e.stage_version("sets", request("é b", [(0, 2), (0, 4)], path="p")))
    assert single["replayed"] and told(batch.stage(e, "sets", docs.limit(1), spans)) == {"k1": None}  # one digest for both ways
    v1, v2 = (next(r.version_id for r in staged.collect() if r.ingestion_key == k) for k in ("k1", "k2"))
    ids = {(r["version_id"], r["end_byte"]): r["evidence_id"] for r in e._store("sets").snapshot().rows("spans", F.lit(True))}
    both = frame("version_id string", (v1,), (v2,), (A,))
    assert told(batch.publish(e, "sets", both)) == {v1: "embeddings_missing", v2: "embeddings_missing", A: "unknown_version"}
    vectors = lambda *rows: batch.attach(e, "sets", frame("evidence_id string, embedding array<float>", *rows))
    a, b, c = ids[v1, 2], ids[v1, 4], ids[v2, 1]
    assert told(vectors((a, [1.0, 0.0]), (b, [0.0, 0.0]), (c, [1.0]), (A, [1.0, 0.0]))) == {a: None, b: "embedding", c: "dimensions", A: "unknown_evidence"}
    assert told(vectors((a, [1.0, 0.0]), (b, [0.0, 1.0]), (c, [0.0, 1.0]))) == {a: None, b: None, c: None} and told(vectors((a, [2.0, 0.0]))) == {a: "embedding_conflict"}
    assert told(batch.publish(e, "sets", both.limit(2))) == {v1: None, v2: "path_in_use"} and told(batch.publish(e, "sets", both.limit(1))) == {v1: None}
    assert told(vectors((a, [1.0, 0.0]))) == {a: None} and texts(ask(e, {"id": "a", "op": "literal", "text": "b"}, corpus="sets")) == ["é b"]
    tags = frame("asset_id string, tag string", (A, "x"), (A, "y"), (A, "x"), (str(uuid.uuid4()), "x"), (B, ""))
    assert sorted(str(r.problem) for r in batch.tag(e, "sets", tags).collect()) == ["None", "None", "tag", "unknown_asset"]
    assert json.loads(e.annotate("sets", {"action": "untag", "asset_id": A, "tags": ["y"], "expected_annotation_revision": 1}))["removed"] == ["y"]
    batch.tag(e, "sets", tags.limit(1), add=False)
    assert e._store("sets").snapshot().rows("tags", F.lit(True)) == []
    links = frame("source_evidence_id string, kind string, target_evidence_id string", (a, "k", c), (a, "K", c), (a, "k", a), (a, "k", A))
    assert sorted(str(r.problem) for r in batch.link(e, "sets", links).collect()) == ["None", "kind", "target_evidence_id", "unknown_evidence"]
    assert json.loads(e.annotate("sets", {"action": "link", "source_evidence_id": a, "target_evidence_id": c, "kind": "k"}))["status"] == "existing"
    batch.link(e, "sets", links.limit(1), add=False)
    assert e._store("sets").snapshot().rows("relations", F.lit(True)) == []
    gone = frame("version_id string, reason string", (v1, "r"), (v2, "r"), (B, "r"))
    assert told(batch.purge(e, "sets", gone)) == {v1: "version_current", v2: None, B: "unknown_version"}
    assets = frame("asset_id string, expected_revision long", (A, 1), (B, 7), (str(uuid.UUID(int=1)), 0))
    assert sorted(map(str, told(batch.retire(e, "sets", assets)).values())) == ["None", "revision_conflict", "unknown_asset"]
    assert told(batch.purge(e, "sets", gone)) == {v1: None, v2: None, B: "unknown_version"} and told(vectors((a, [1.0, 0.0]))) == {a: "version_purged"}
    assert json.loads(e.resolve("sets", a))["status"] == "purged" and e._store("sets").snapshot().rows("embeddings", F.lit(True)) == []
    before = {t: e._store("sets").snapshot().table(t).count() for t in TABLES}
    e._store("sets").compact(1)
    e.vacuum("sets")
    after = e._store("sets").snapshot()
    assert {t: after.table(t).count() for t in TABLES} == before and all(len(p) <= 1 for p in after.manifest["tables"].values())


def test_files_batches_and_streams(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("alpha\nbeta\n")
    (folder / "b.bin").write_bytes(b"\xff\xfe")
    outcome = lambda: dict(map(tuple, import_files(store, "docs", str(folder)).collect()))
    assert outcome() == {"a.txt": "imported", "b.bin": "skipped"}
    (folder / "deep").mkdir()
    (folder / "deep" / "c.txt").write_text("x\r\ny")
    assert outcome() == {"a.txt": "unchanged", "b.bin": "skipped", "deep/c.txt": "imported"}
    (folder / "a.txt").write_text("gamma\n")
    assert outcome()["a.txt"] == "imported"
    assert texts(ask(store, {"id": "a", "op": "literal", "text": "a"})) == ["gamma\n"]
    rows = [(A, "x/1", "one\ntwo\n", "d1"), (B, "x/2", "zwei", "d2"), ("bad", "x/3", "s", "d3"), (str(uuid.uuid4()), "x/1", "s", "d4"), (str(uuid.uuid4()), "x/5", None, "d5")]
    docs = spark.createDataFrame(rows, "asset_id string, path string, source string, ingestion_key string")
    got = {r.ingestion_key: r.problem for r in batch.load(store, "docs", docs, 4).collect()}
    assert got == {"d1": None, "d2": None, "d3": "asset_id", "d4": "path_in_use", "d5": "missing_field"}
    hits = ask(store, {"id": "a", "op": "lexical", "query": "two"})["results"]
    assert json.loads(store.resolve("docs", hits[0]["evidence_id"]))["text"] == "two\n"
    again = {r.ingestion_key: r.problem for r in batch.load(store, "docs", docs.limit(2)).collect()}
    assert set(again.values()) == {"ingestion_key_reused"}
    (tmp_path / "stream").mkdir()
    spark.createDataFrame([(A, "x/1", "three", "s1")], docs.schema).coalesce(1).write.json(str(tmp_path / "stream" / "one"))
    live = spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").json(str(tmp_path / "stream"))
    load_stream(store, "docs", live, str(tmp_path / "chk"), availableNow=True).awaitTermination(120)
    assert texts(ask(store, {"id": "a", "op": "literal", "text": "three"})) == ["three"]
    assert ask(store, {"id": "a", "op": "literal", "text": "one"})["results"] == []


def test_set_based_staging_takes_the_spans_of_a_row(store):
    from pyspark.sql import functions as F

    from veritome.sources import batch, fixtures

    store.init_collection("own", {})
    docs = [(A, "a", "é\n\nbc\n", "k1", [(3, 4), (0, 2)]), (B, "b", "é", "k2", [(1, 2)]), (B, "b", "é", "k3", [(None, 2)]), (B, "b", "é", "k4", [(-1, 2)]), (B, "b", "é", "k5", [(0, 2), (0, 2)]), (B, "b", "é", "k6", None), (B, "b", "é", "k6", None)]
    rows = store.spark.createDataFrame(docs, f"asset_id string, path string, source string, ingestion_key string, spans {batch.SPANS}")
    told = sorted((r.ingestion_key, str(r.problem)) for r in batch.stage(store, "own", rows).collect())
    assert told == [("k1", "None"), ("k2", "spans"), ("k3", "spans"), ("k4", "spans"), ("k5", "spans"), ("k6", "None"), ("k6", "ingestion_key_reused")]
    assert sorted((r.start_byte, r.end_byte, r.text) for r in store.tables("own").spans.collect()) == [(0, 2, "é"), (3, 4, "\n")]
    assert sorted(r.source for r in store.tables("own").versions.collect()) == ["é", "é\n\nbc\n"]
    texts = ["a\nb\n", None, "", "\n\nx", "é\n", "q", "\n", "\r\né\n\nab"]
    got = store.spark.createDataFrame([(t,) for t in texts], "t string").select("t", fixtures.line_spans("t").alias("s")).collect()
    for r in got:
        raw, at = (r.t or "").encode(), 0
        want = [(at := at + len(x) + 1) and (at - 1 - len(x), at - 1) for x in raw.split(b"\n")]
        assert [tuple(x) for x in r.s] == [(a, b) for a, b in want if a < b]


def test_a_resolve_reads_whole_only_the_files_that_hold_its_rows(store):
    from veritome.sources import batch

    store.init_collection("files", {})
    for k, asset in enumerate((A, B)):
        batch.stage(store, "files", store.spark.createDataFrame([(asset, f"p{k}", f"text {k}", f"k{k}")], "asset_id string, path string, source string, ingestion_key string"))
    s = store._store("files").snapshot()
    span = s.rows("spans", "text = 'text 1'", "evidence_id", "version_id")[0]
    found = s.holding("versions", "version_id", span["version_id"])
    assert len(found.inputFiles()) == 1 < len(s.table("versions").inputFiles()) and [r.source for r in found.collect()] == ["text 1"]
    assert s.holding("versions", "version_id", A).collect() == [] and s.holding("tombstones", "version_id", A).collect() == []
    assert '"text":"text 1"' in store.resolve("files", span["evidence_id"]) and '"status":"staged"' in store.resolve("files", span["evidence_id"])
    assert "not_found" in store.resolve("files", A)
