"""Named queries over the fixture corpus, and DuckDB SQL for the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritome.functions import utf8
from veritome.operators.tables import Tables, version_status
from veritome.plans.compile import Compiled, compile_plan
from veritome.plans.plan import Filter, Lexical, Literal, Neighbors, Node, Plan, Regex, Semantic, Union
from veritome.sources import chunk, fixtures

# Parameters of the queries.
NEEDLE = "ing the"
PATTERN = r"^Licensed under|[0-9]{3}-[0-9]{4}"
PATTERN_CI = "apache|GNU general"
PLAIN, PHRASE, WEBSEARCH = "license version", "public license", '"apache license" or gnu -3'
PREFIX, TAGS_ALL, TAGS_ANY, FILTER_TEXT = "src1", ("lang:en", "quality:1"), ("lang:fr", "toxic:1"), "the"
ASSETS = (1, 2, 3, 4, 11, 13, 17, 22)
EXCERPT, TRIM, LIMIT = 60, 21, 40
SEEDS, MANY_SEEDS, HOP_LIMIT, MAX_EDGES = 250, 10_000, 150, 240
ITEM_BUDGET, RESPONSE_BYTES, RESOLVED, CHUNK = 4000, 6000, 12, 400


def _asset_id(number: int) -> str:
    import hashlib
    import uuid

    return str(uuid.UUID(hashlib.md5(f"a:{number}".encode()).hexdigest()))


def _plan(*nodes: Node, excerpt: int = EXCERPT) -> Plan:
    return Plan(nodes, len(nodes) - 1, excerpt)


def _compiled(spark: SparkSession, sf_dir: str, *nodes: Node, whole: bool = False) -> Compiled:
    return compile_plan(_plan(*nodes), fixtures.tables(spark, sf_dir, whole))


def _search(op, limit: int = LIMIT):
    """Rows of one search node with their place."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _compiled(spark, sf_dir, Node("hits", op, limit)).results()

    return run


def _scored(op, limit: int = LIMIT, whole: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _compiled(spark, sf_dir, Node("hits", op, limit), whole=whole).results()
        return rows.withColumn("score", F.round("score", 6))

    return run


SEED = Node("hits", Literal(NEEDLE), SEEDS)


def _hop(seed: Node | None = None, **options):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _compiled(spark, sf_dir, seed or SEED, Node("hop", Neighbors(0, max_edges=MAX_EDGES, **options), HOP_LIMIT)).results()

    return run


def _union_nodes() -> tuple[Node, ...]:
    return SEED, Node("pattern", Regex(PATTERN_CI, True), 30), Node("all", Union((0, 1)), 260)


def _composed_nodes() -> tuple[Node, ...]:
    return Node("hits", Lexical("with", "plain"), 25), Node("related", Neighbors(0, "both", (), ("current",), MAX_EDGES), 25), Node("all", Union((0, 1)), 50)


def neighbors_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compiled(spark, sf_dir, SEED, Node("hop", Neighbors(0, "both", max_edges=MAX_EDGES), HOP_LIMIT)).edge_rows()


def composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compiled(spark, sf_dir, *_composed_nodes()).results().withColumn("score", F.round("score", 6))


def node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compiled(spark, sf_dir, *_composed_nodes()).stats()


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 0").select("embedding").first()
    return _scored(Semantic(tuple(vectors.embedding)), whole=True)(spark, sf_dir)


def status_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_status(fixtures.tables(spark, sf_dir)).withColumn("published_revision", F.coalesce("published_revision", F.lit(0)))


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a response in order, as many as a byte budget holds, and their running size."""
    rows = _search(Literal(NEEDLE))(spark, sf_dir)
    item = F.concat_ws(":", "evidence_id", "path", utf8.trim_column(F.col("excerpt"), EXCERPT))
    sized = rows.select("rn", item.alias("item")).withColumn("used", F.sum(F.octet_length("item") + 1).over(Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
    return sized.where(F.col("used") <= ITEM_BUDGET)


def excerpt_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = fixtures.tables(spark, sf_dir).spans.where("text is not null")
    cut = utf8.trim_column(F.col("text"), TRIM)
    return spans.select("evidence_id", cut.alias("excerpt"), (F.octet_length(cut) < F.octet_length("text")).alias("excerpt_truncated"))


def resolve_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span with its status, its bytes compared with its source and the source with its digest."""
    t = fixtures.tables(spark, sf_dir)
    checked = t.versions.select(
        "version_id", "source", "source_sha256", "byte_length", (F.col("source").isNotNull() & (utf8.sha256_hex(F.col("source")) == F.col("source_sha256")) & (F.octet_length("source") == F.col("byte_length"))).alias("whole")
    )
    same = utf8.byte_slice(F.col("source"), F.col("start_byte"), F.col("end_byte")) == F.col("text")
    rows = t.spans.join(checked, "version_id").join(version_status(t), "version_id")
    return rows.select("evidence_id", "version_id", "status", F.coalesce("published_revision", F.lit(0)).alias("published_revision"), "start_byte", "end_byte", "source_sha256", (F.col("whole") & F.coalesce(same, F.lit(False))).alias("verified"))


def ingest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.tables(spark, sf_dir)
    return t.versions.select("version_id", "asset_id", "path", "source_sha256", "byte_length", "ingestion_key", "base_revision", "request_sha256")


def ingest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.tables(spark, sf_dir).spans.select("evidence_id", "version_id", "start_byte", "end_byte", F.coalesce(F.size("tokens"), F.lit(0)).alias("n_tokens"), "text")


def embeddings_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that cannot be published yet: how many of their spans lack an embedding."""
    t = fixtures.tables(spark, sf_dir, whole=True)
    bare = t.spans.join(t.embeddings.select("evidence_id"), "evidence_id", "left_anti")
    return bare.groupBy("version_id").agg(F.count("*").alias("missing"))


def publish_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What publishing each version would find."""
    t = fixtures.tables(spark, sf_dir)
    rows = t.versions.select("version_id", "asset_id", "base_revision").join(t.assets.select("asset_id", "content_revision", "current_version_id"), "asset_id")
    rows = rows.join(t.publications.select("version_id", "revision"), "version_id", "left").join(t.tombstones.select("version_id", F.lit(True).alias("p")), "version_id", "left")
    purged = F.coalesce("p", F.lit(False))
    verdict = F.when(F.col("revision").isNotNull(), "replay").when(purged, "version_purged").when(F.col("base_revision") != F.col("content_revision"), "revision_conflict").otherwise("publish")
    return rows.select("version_id", "base_revision", "content_revision", F.coalesce("revision", F.lit(0)).alias("revision"), purged.alias("purged"), F.coalesce(F.col("current_version_id") == F.col("version_id"), F.lit(False)).alias("current"), verdict.alias("verdict"))


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.tables(spark, sf_dir)
    return t.tags.groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"), F.count_distinct("tag").alias("n_tags"))


def purge_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of purged versions: digests, offsets and ids, no text."""
    t = fixtures.tables(spark, sf_dir)
    rows = t.tombstones.select("version_id", "reason").join(t.versions, "version_id").join(t.spans, "version_id", "left")
    return rows.groupBy("version_id", "reason", "source_sha256", "byte_length").agg(F.count("evidence_id").alias("spans_purged"), F.count("text").alias("texts_left"), F.count("source").alias("sources_left"))


# ---- responses of the API -----------------------------------------------------


def _ask(spark: SparkSession, sf_dir: str, *nodes: dict, **more) -> str:
    evidence, name = fixtures.corpus(spark, sf_dir)
    return evidence.query(name, {"nodes": list(nodes), "output": nodes[-1]["id"], **more})


_HITS = {"id": "hits", "op": "literal", "text": NEEDLE, "limit": LIMIT}
_GRAPH = (
    {"id": "hits", "op": "lexical", "query": "with", "syntax": "plain", "limit": 25},
    {"id": "related", "op": "neighbors", "from": "hits", "status": ["current"], "limit": 25, "max_edges": MAX_EDGES},
    {"id": "all", "op": "union", "inputs": ["hits", "related"]},
)


def rendered_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = json.loads(_ask(spark, sf_dir, _HITS, excerpt_bytes=TRIM))
    rows = [(k + 1, *(r[c] for c in ("evidence_id", "version_id", "asset_id", "path", "start_byte", "end_byte", "status", "mode", "excerpt", "excerpt_truncated"))) for k, r in enumerate(got["results"])]
    return spark.createDataFrame(rows, "rn int, evidence_id string, version_id string, asset_id string, path string, start_byte int, end_byte int, status string, mode string, excerpt string, excerpt_truncated boolean")


def rendered_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a byte budget leaves of a response, and the bytes it has then."""
    text = _ask(spark, sf_dir, _HITS, excerpt_bytes=EXCERPT, max_response_bytes=RESPONSE_BYTES)
    cut = json.loads(text)["truncation"]
    return spark.createDataFrame([(cut["returned"], cut["dropped_for_budget"], cut["truncated"], cut["underfilled"], len(text.encode()))], "returned int, dropped int, truncated boolean, underfilled boolean, n_bytes int")


def rendered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = json.loads(_ask(spark, sf_dir, *_GRAPH))
    return spark.createDataFrame([(e["source_evidence_id"], e["kind"], e["target_evidence_id"]) for e in got["edges"]], "source_id string, kind string, target_id string")


def rendered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = json.loads(_ask(spark, sf_dir, *_GRAPH))
    rows = [(n["id"], n["op"], n["requested"], n["returned"], n["truncated"], n["underfilled"], got["approximate"], got["complete"]) for n in got["nodes"]]
    return spark.createDataFrame(rows, "id string, op string, requested int, returned int, truncated boolean, underfilled boolean, approximate boolean, complete boolean")


def resolve_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of several states that a hop finds, each resolved by a call."""
    hop = {"id": "hop", "op": "neighbors", "from": "hits", "status": ["historical", "purged", "retired", "staged"], "limit": RESOLVED, "max_edges": MAX_EDGES}
    got = json.loads(_ask(spark, sf_dir, {"id": "hits", "op": "literal", "text": FILTER_TEXT, "limit": 250}, hop))
    evidence, name = fixtures.corpus(spark, sf_dir)
    told = [json.loads(evidence.resolve(name, r["evidence_id"])) for r in got["results"]]
    rows = [(r["evidence_id"], r["status"], r["start_byte"], r["end_byte"], r["source_sha256"], r["byte_length"], r["published_revision"] or 0, r.get("reason") or "", r.get("text") or "", r.get("verified", False)) for r in told]
    return spark.createDataFrame(rows, "evidence_id string, status string, start_byte int, end_byte int, source_sha256 string, byte_length int, published_revision int, reason string, text string, verified boolean")


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), CHUNK)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked hits, what they relate to, and the union of both."""
    return composed(spark, sf_dir)


QUERIES = {
    "literal_search": _search(Literal(NEEDLE)),
    "regex_search": _search(Regex(PATTERN)),
    "regex_search_ci": _search(Regex(PATTERN_CI, True)),
    "lexical_plain": _scored(Lexical(PLAIN, "plain")),
    "lexical_phrase": _scored(Lexical(PHRASE, "phrase")),
    "lexical_websearch": _scored(Lexical(WEBSEARCH)),
    "semantic_topk": semantic_topk,
    "filter_path_prefix": _search(Literal(FILTER_TEXT, Filter(path_prefix=PREFIX))),
    "filter_asset_ids": _search(Literal(FILTER_TEXT, Filter(asset_ids=tuple(map(_asset_id, ASSETS))))),
    "filter_tags_all": _search(Literal(FILTER_TEXT, Filter(tags_all=TAGS_ALL))),
    "filter_tags_any": _search(Literal(FILTER_TEXT, Filter(tags_any=TAGS_ANY))),
    "neighbors_out": _hop(direction="out"),
    "neighbors_in": _hop(direction="in"),
    "neighbors_both": _hop(direction="both"),
    "neighbors_kinds": _hop(direction="both", kinds=("copy_of",)),
    "neighbors_status": _hop(Node("hits", Literal(FILTER_TEXT), MANY_SEEDS), direction="both", statuses=("historical", "retired", "purged", "staged")),
    "neighbors_edges": neighbors_edges,
    "union_dedup": lambda spark, sf_dir: _compiled(spark, sf_dir, *_union_nodes()).results(),
    "composed_lexical_hop_union": composed,
    "node_stats": node_stats,
    "status_all": status_all,
    "budget_prefix": budget_prefix,
    "excerpt_trim": excerpt_trim,
    "resolve_verified": resolve_verified,
    "ingest_versions": ingest_versions,
    "ingest_spans": ingest_spans,
    "embeddings_missing": embeddings_missing,
    "publish_state": publish_state,
    "tag_sets": tag_sets,
    "purge_projection": purge_projection,
    "rendered_results": rendered_results,
    "rendered_budget": rendered_budget,
    "rendered_edges": rendered_edges,
    "rendered_nodes": rendered_nodes,
    "resolve_calls": resolve_calls,
    "chunk_lines": chunk_lines,
}

# ---- the same in SQL --------------------------------------------------------


def _uuid(text: str) -> str:
    h = f"md5({text})"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"


_OF_SPAN = "'span:doc:' || doc_id || ':' || start_byte || ':' || end_byte"
_CORPUS = f"""d AS (SELECT doc_id, text, lang, source, doc_id // 4 AS asset_no, doc_id % 4 + 1 AS rev, {_uuid("'version:doc:' || doc_id")} AS version_id, {_uuid("'a:' || (doc_id // 4)")} AS asset_id,
  source || '/' || lang || '/' || lpad((doc_id // 4)::VARCHAR, 8, '0') || '.txt' AS path FROM documents),
life AS (SELECT *, published + CASE WHEN asset_no % 7 = 0 THEN 1 ELSE 0 END AS content, CASE WHEN asset_no % 7 <> 0 AND published > 0 THEN published END AS current
  FROM (SELECT asset_no, CASE WHEN asset_no % 3 = 0 THEN max(rev) - 1 ELSE max(rev) END AS published FROM d GROUP BY asset_no)),
p AS (SELECT d.*, content, current, published, asset_no % 5 = 0 AND rev = 1 AND current IS DISTINCT FROM 1 AS purged FROM d JOIN life USING (asset_no)),
v AS (SELECT *, CASE WHEN purged THEN 'purged' WHEN rev = current THEN 'current' WHEN rev > published THEN 'staged' WHEN asset_no % 7 = 0 THEN 'retired' ELSE 'historical' END AS status,
  CASE WHEN rev <= published THEN rev END AS published_revision FROM p),
lines AS (SELECT doc_id, line_no, line, (after - 1 - strlen(line))::INT AS start_byte, (after - 1)::INT AS end_byte FROM (
  SELECT doc_id, i - 1 AS line_no, lines[i] AS line, sum(strlen(lines[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS after
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents))) WHERE line <> ''),
s AS (SELECT {_uuid(_OF_SPAN)} AS evidence_id, doc_id, line_no, version_id, asset_id, path, status, start_byte, end_byte, CASE WHEN NOT purged THEN line END AS text FROM lines JOIN v USING (doc_id)),
tok AS (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS tokens FROM s),
tg AS (SELECT {_uuid("'a:' || asset_no")} AS asset_id, tag FROM (
  SELECT asset_no, unnest(['lang:' || arg_min(lang, doc_id), 'src:' || arg_min(source, doc_id)]) AS tag FROM d GROUP BY asset_no
  UNION SELECT doc_id // 4, unnest(['quality:' || quality, 'toxic:' || toxic]) FROM labels)),
firsts AS (SELECT doc_id, arg_min(evidence_id, line_no) AS id FROM s GROUP BY doc_id),
rel AS (SELECT evidence_id AS source_id, 'follows' AS kind, target_id FROM (SELECT evidence_id, lead(evidence_id) OVER (PARTITION BY doc_id ORDER BY line_no) AS target_id FROM s) WHERE target_id IS NOT NULL
  UNION ALL SELECT a.id, 'copy_of', b.id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc FROM documents) c JOIN firsts a ON a.doc_id = c.doc_id JOIN firsts b ON b.doc_id = c.first_doc WHERE c.doc_id <> c.first_doc),
w AS (SELECT {_uuid("'span:doc:' || doc_id || ':0:' || strlen(text)")} AS evidence_id, version_id, {_uuid("'w:' || doc_id")} AS asset_id, source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path,
  CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'current' ELSE 'staged' END AS status, 0 AS start_byte, strlen(text)::INT AS end_byte, text, doc_id FROM d WHERE text <> '')"""
_PLACE = "evidence_id, version_id, asset_id, path, start_byte, end_byte, status"


def _sql(ctes: str, select: str) -> str:
    return f"WITH {_CORPUS}{', ' + ctes if ctes else ''} {select}"


def _ranked(name: str, where: str, limit: int, mode: str, score: str = "NULL::DOUBLE", order: str = "path, start_byte, evidence_id", table: str = "tok") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM (SELECT evidence_id, path, start_byte, {score} AS score, '{mode}' AS mode FROM {table} WHERE status = 'current' AND ({where})) QUALIFY rn <= {limit} + 1)"


def _result(node: str, limit: int, table: str = "s", score: str = "n.score") -> str:
    return f"SELECT {', '.join('s.' + c for c in _PLACE.split(', '))}, n.mode, left(s.text, {EXCERPT}) AS excerpt, {score} AS score, n.rn::INT AS rn FROM {node} n JOIN {table} s ON s.evidence_id = n.evidence_id WHERE n.rn <= {limit}"


def _literal(extra: str = "", text: str = NEEDLE, limit: int = LIMIT) -> str:
    return _sql(_ranked("n", f"contains(text, '{text}'){extra}", limit, "literal"), _result("n", limit))


def _count(word: str) -> str:
    return f"(0.1::DOUBLE * len(list_filter(tokens, lambda x: x = '{word}')))::FLOAT::DOUBLE"


def _near(a: str, b: str) -> str:
    """Sum over adjacent different places of two words of 0.1 / distance."""
    at = f"list_filter(range(1, len(tokens) + 1), lambda i: tokens[i] = '{a}' OR tokens[i] = '{b}')"
    return f"list_sum(list_transform(range(1, len({at})), lambda k: CASE WHEN tokens[({at})[k]] <> tokens[({at})[k + 1]] THEN 0.1::DOUBLE / (({at})[k + 1] - ({at})[k]) ELSE 0.0 END))::FLOAT::DOUBLE"


def _adjacent(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = '{a}' AND tokens[i + 1] = '{b}'))"


def _edges(seed: str, limit: int, direction: str, extra: str = "", max_edges: int = MAX_EDGES, kinds: str = "") -> str:
    out = f"SELECT f.rn AS from_rn, source_id, kind, target_id, target_id AS to_id, 0 AS dir FROM {seed} f JOIN rel ON source_id = f.evidence_id WHERE f.rn <= {limit}"
    into = f"SELECT f.rn AS from_rn, source_id, kind, target_id, source_id AS to_id, 1 AS dir FROM {seed} f JOIN rel ON target_id = f.evidence_id WHERE f.rn <= {limit}"
    both = {"out": out, "in": into, "both": f"{out} UNION ALL {into}"}[direction]
    where = f"WHERE EXISTS (SELECT 1 FROM s WHERE s.evidence_id = x.to_id AND s.status IN ({extra}))" if extra else f"WHERE kind IN ({kinds})" if kinds else ""
    return f"e AS (SELECT *, row_number() OVER (ORDER BY from_rn, kind, to_id, dir) AS edge_rn FROM ({both}) x {where} QUALIFY edge_rn <= {max_edges} + 1)"


def _ends(limit: int, max_edges: int = MAX_EDGES) -> str:
    return f"h AS (SELECT evidence_id, NULL::DOUBLE AS score, 'neighbors' AS mode, row_number() OVER (ORDER BY first_edge) AS rn FROM (SELECT to_id AS evidence_id, min(edge_rn) AS first_edge FROM e WHERE edge_rn <= {max_edges} GROUP BY to_id) QUALIFY rn <= {limit} + 1)"


def _hop_sql(direction: str, statuses: str = "", text: str = NEEDLE, seeds: int = SEEDS, kinds: str = "") -> str:
    return _sql(", ".join([_ranked("n", f"contains(text, '{text}')", seeds, "literal"), _edges("n", seeds, direction, statuses, kinds=kinds), _ends(HOP_LIMIT)]), _result("h", HOP_LIMIT))


def _cut(text: str, most: int) -> str:
    """Longest prefix of at most so many bytes."""
    return f"left({text}, list_max(list_filter(range(0, {most} + 1), lambda k: strlen(left({text}, k)) <= {most}))::INT)"


def _merge(name: str, first: str, n_first: int, second: str, n_second: int, limit: int) -> str:
    return f"""{name} AS (SELECT evidence_id, score, mode, row_number() OVER (ORDER BY inp, irn) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY inp, irn) AS k FROM (
  SELECT evidence_id, score, mode, 0 AS inp, rn AS irn FROM {first} WHERE rn <= {n_first} UNION ALL SELECT evidence_id, score, mode, 1, rn FROM {second} WHERE rn <= {n_second})) WHERE k = 1 QUALIFY rn <= {limit} + 1)"""


_COMPOSED = ", ".join([_ranked("n", "list_contains(tokens, 'with')", 25, "lexical", _count("with"), "score DESC, evidence_id"), _edges("n", 25, "both", "'current'"), _ends(25), _merge("u", "n", 25, "h", 25, 50)])
_BY_RANK = "score DESC, evidence_id"
_A, _B = PLAIN.split()
_P, _Q = PHRASE.split()
_WEB = f"(len(list_filter(range(1, len(tokens)), lambda i: tokens[i] = 'apache' AND tokens[i + 1] = 'license')) > 0 OR (list_contains(tokens, 'gnu') AND NOT list_contains(tokens, '3')))"

ORACLE = {
    "literal_search": _literal(),
    "regex_search": _sql(_ranked("n", f"regexp_matches(text, '{PATTERN}', 's')", LIMIT, "regex"), _result("n", LIMIT)),
    "regex_search_ci": _sql(_ranked("n", f"regexp_matches(text, '{PATTERN_CI}', 'is')", LIMIT, "regex"), _result("n", LIMIT)),
    "lexical_plain": _sql(_ranked("n", f"list_contains(tokens, '{_A}') AND list_contains(tokens, '{_B}')", LIMIT, "lexical", _near(_A, _B), _BY_RANK), _result("n", LIMIT, score="round(n.score, 6)")),
    "lexical_phrase": _sql(_ranked("n", f"{_adjacent(_P, _Q)} > 0", LIMIT, "lexical", f"(0.1::DOUBLE * {_adjacent(_P, _Q)})::FLOAT::DOUBLE", _BY_RANK), _result("n", LIMIT, score="round(n.score, 6)")),
    "lexical_websearch": _sql(_ranked("n", _WEB, LIMIT, "lexical", f"(0.1::DOUBLE * ({_adjacent('apache', 'license')} + len(list_filter(tokens, lambda x: x = 'gnu'))))::FLOAT::DOUBLE", _BY_RANK), _result("n", LIMIT, score="round(n.score, 6)")),
    "semantic_topk": _sql(
        _ranked("n", "true", LIMIT, "semantic", "score", "score, evidence_id", "(SELECT w.*, list_cosine_distance(x.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM w JOIN embeddings x ON x.vec_id = w.doc_id)"),
        _result("n", LIMIT, "w", "round(n.score, 6)"),
    ),
    "filter_path_prefix": _literal(f" AND starts_with(path, '{PREFIX}')", FILTER_TEXT),
    "filter_asset_ids": _literal(" AND asset_id IN (" + ", ".join(f"'{_asset_id(a)}'" for a in ASSETS) + ")", FILTER_TEXT),
    "filter_tags_all": _literal("".join(f" AND asset_id IN (SELECT asset_id FROM tg WHERE tag = '{t}')" for t in TAGS_ALL), FILTER_TEXT),
    "filter_tags_any": _literal(" AND asset_id IN (SELECT asset_id FROM tg WHERE tag IN (" + ", ".join(f"'{t}'" for t in TAGS_ANY) + "))", FILTER_TEXT),
    "neighbors_out": _hop_sql("out"),
    "neighbors_in": _hop_sql("in"),
    "neighbors_both": _hop_sql("both"),
    "neighbors_kinds": _hop_sql("both", kinds="'copy_of'"),
    "neighbors_status": _hop_sql("both", "'historical', 'retired', 'purged', 'staged'", FILTER_TEXT, MANY_SEEDS),
    "neighbors_edges": _sql(", ".join([_ranked("n", f"contains(text, '{NEEDLE}')", SEEDS, "literal"), _edges("n", SEEDS, "both")]), f"SELECT 1 AS node, source_id, kind, target_id, to_id, edge_rn::INT AS edge_rn FROM e WHERE edge_rn <= {MAX_EDGES}"),
    "union_dedup": _sql(", ".join([_ranked("n", f"contains(text, '{NEEDLE}')", SEEDS, "literal"), _ranked("m", f"regexp_matches(text, '{PATTERN_CI}', 'is')", 30, "regex"), _merge("u", "n", SEEDS, "m", 30, 260)]), _result("u", 260)),
    "composed_lexical_hop_union": _sql(_COMPOSED, _result("u", 50, score="round(n.score, 6)")),
    "node_stats": _sql(_COMPOSED, "SELECT 0 AS node, (SELECT count(*) FROM n) AS n_rows, 0::BIGINT AS n_edges UNION ALL SELECT 1, (SELECT count(*) FROM h), (SELECT count(*) FROM e) UNION ALL SELECT 2, (SELECT count(*) FROM u), 0"),
    "status_all": _sql("", "SELECT version_id, asset_id, path, coalesce(published_revision, 0) AS published_revision, status FROM v"),
    "budget_prefix": _sql(
        _ranked("n", f"contains(text, '{NEEDLE}')", LIMIT, "literal") + f", r AS ({_result('n', LIMIT)})",
        f"SELECT * FROM (SELECT rn, item, (sum(strlen(item) + 1) OVER (ORDER BY rn))::BIGINT AS used FROM (SELECT rn, evidence_id || ':' || path || ':' || left(excerpt, list_max(list_filter(range(0, {EXCERPT} + 1), lambda k: strlen(left(excerpt, k)) <= {EXCERPT}))::INT) AS item FROM r)) WHERE used <= {ITEM_BUDGET}",
    ),
    "excerpt_trim": _sql("", f"SELECT evidence_id, excerpt, strlen(excerpt) < strlen(text) AS excerpt_truncated FROM (SELECT evidence_id, text, left(text, list_max(list_filter(range(0, {TRIM} + 1), lambda k: strlen(left(text, k)) <= {TRIM}))::INT) AS excerpt FROM s WHERE text IS NOT NULL)"),
    "resolve_verified": _sql("", "SELECT s.evidence_id, s.version_id, s.status, coalesce(v.published_revision, 0) AS published_revision, s.start_byte, s.end_byte, sha256(v.text) AS source_sha256, NOT v.purged AS verified FROM s JOIN v USING (doc_id)"),
    "ingest_versions": _sql(
        "ranges AS (SELECT doc_id, string_agg('[' || start_byte || ',' || end_byte || ']', ',' ORDER BY start_byte) AS list FROM lines GROUP BY doc_id)",
        """SELECT version_id, asset_id, path, sha256(text) AS source_sha256, strlen(text)::INT AS byte_length, 'doc:' || doc_id AS ingestion_key, rev - 1 AS base_revision,
        sha256('{"asset_id":"' || asset_id || '","expected_revision":' || (rev - 1) || ',"path":"' || path || '","source_sha256":"' || sha256(text) || '","spans":[' || coalesce(list, '') || ']}') AS request_sha256 FROM v LEFT JOIN ranges USING (doc_id)""",
    ),
    "ingest_spans": _sql("", "SELECT evidence_id, version_id, start_byte, end_byte, coalesce(len(tokens), 0)::INT AS n_tokens, text FROM tok"),
    "embeddings_missing": _sql("", "SELECT version_id, count(*) AS missing FROM w WHERE status = 'staged' GROUP BY version_id"),
    "publish_state": _sql("", "SELECT version_id, rev - 1 AS base_revision, content AS content_revision, coalesce(published_revision, 0) AS revision, purged, rev IS NOT DISTINCT FROM current AS current, CASE WHEN published_revision IS NOT NULL THEN 'replay' WHEN purged THEN 'version_purged' WHEN rev - 1 <> content THEN 'revision_conflict' ELSE 'publish' END AS verdict FROM v"),
    "tag_sets": _sql("", "SELECT asset_id, string_agg(tag, ',' ORDER BY tag) AS tags, count(*) AS n_tags FROM tg GROUP BY asset_id"),
    "purge_projection": _sql("", "SELECT v.version_id, 'retention' AS reason, sha256(v.text) AS source_sha256, strlen(v.text)::INT AS byte_length, count(s.evidence_id) AS spans_purged, 0::BIGINT AS texts_left, 0::BIGINT AS sources_left FROM v LEFT JOIN s USING (doc_id) WHERE v.purged GROUP BY ALL"),
}

_ITEM = f"""'{{"evidence_id":"' || s.evidence_id || '","version_id":"' || s.version_id || '","asset_id":"' || s.asset_id || '","path":"' || s.path || '","start_byte":' || s.start_byte || ',"end_byte":' || s.end_byte
  || ',"status":"current","mode":"literal","excerpt":' || to_json({_cut('s.text', EXCERPT)})::VARCHAR || ',"excerpt_truncated":' || (strlen({_cut('s.text', EXCERPT)}) < strlen(s.text)) || '}}'"""
_REST = f"""'{{"results":[],"edges":[],"truncation":{{"requested":{LIMIT},"returned":' || k || ',"truncated":' || (total > {LIMIT} OR k < shown) || ',"underfilled":' || (k < {LIMIT}) || ',"dropped_for_budget":' || (shown - k)
  || ',"edges_truncated":false,"excerpts_truncated":' || coalesce(cut, false) || '}},"nodes":[{{"id":"hits","op":"literal","requested":{LIMIT},"returned":' || shown || ',"truncated":' || (total > {LIMIT}) || ',"underfilled":' || (shown < {LIMIT})
  || '}}],"readiness":{{"literal":"ready","regex":"ready","lexical":"ready","semantic":"not_configured"}},"approximate":false,"complete":' || (total <= {LIMIT} AND k = shown AND NOT coalesce(cut, false)) || '}}'"""
_NEEDLE_HITS = _ranked("n", f"contains(text, '{NEEDLE}')", LIMIT, "literal")
_RESOLVED = ", ".join([_ranked("n", f"contains(text, '{FILTER_TEXT}')", 250, "literal"), _edges("n", 250, "both", "'historical', 'purged', 'retired', 'staged'"), _ends(RESOLVED)])
_NEXT = f"""coalesce(list_max(list_filter(ends, lambda x: x > b AND x <= b + {CHUNK})), list_max(list_filter(range(b + {CHUNK} - 3, b + {CHUNK} + 1), lambda i: substr(h, 2 * i + 1, 1) NOT IN ('8', '9', 'A', 'B'))))"""
ORACLE |= {
    "rendered_results": _sql(_NEEDLE_HITS, f"SELECT rn::INT AS rn, {', '.join('s.' + c for c in _PLACE.split(', '))}, n.mode, {_cut('s.text', TRIM)} AS excerpt, strlen({_cut('s.text', TRIM)}) < strlen(s.text) AS excerpt_truncated FROM n JOIN s USING (evidence_id) WHERE rn <= {LIMIT}"),
    "rendered_budget": _sql(
        f"{_NEEDLE_HITS}, items AS (SELECT rn, {_ITEM} AS item, strlen({_cut('s.text', EXCERPT)}) < strlen(s.text) AS cut FROM n JOIN s ON s.evidence_id = n.evidence_id WHERE rn <= {LIMIT}), size AS (SELECT (SELECT count(*) FROM n) AS total, (SELECT count(*) FROM items) AS shown), "
        f"options AS (SELECT k, total, shown, coalesce((SELECT sum(strlen(item) + 1) - 1 FROM items WHERE rn <= k), 0) + strlen({_REST.replace('coalesce(cut, false)', '(SELECT coalesce(bool_or(cut), false) FROM items WHERE rn <= k)')}) AS n FROM size, range(0, {LIMIT} + 1) r(k) WHERE k <= shown)",
        f"SELECT k::INT AS returned, (shown - k)::INT AS dropped, total > {LIMIT} OR k < shown AS truncated, k < {LIMIT} AS underfilled, n::INT AS n_bytes FROM options WHERE n <= {RESPONSE_BYTES} ORDER BY k DESC LIMIT 1",
    ),
    "rendered_edges": _sql(_COMPOSED, f"SELECT DISTINCT source_id, kind, target_id FROM e WHERE edge_rn <= {MAX_EDGES} AND to_id IN (SELECT evidence_id FROM u WHERE rn <= 50)"),
    "rendered_nodes": _sql(
        _COMPOSED + ", c AS (SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM h) AS h, (SELECT count(*) FROM u) AS u, (SELECT count(*) FROM e) AS e, (SELECT bool_or(strlen(text) > 512) FROM s WHERE evidence_id IN (SELECT evidence_id FROM u)) AS cut)",
        f"SELECT id, op, requested, least(rows, requested)::INT AS returned, truncated, rows < requested AS underfilled, false AS approximate, NOT (bool_or(truncated) OVER () OR coalesce(cut, false)) AS complete FROM ("
        f"SELECT 'hits' AS id, 'lexical' AS op, 25 AS requested, n AS rows, n > 25 AS truncated, cut FROM c UNION ALL SELECT 'related', 'neighbors', 25, h, h > 25 OR e > {MAX_EDGES}, cut FROM c UNION ALL SELECT 'all', 'union', 50, u, u > 50, cut FROM c)",
    ),
    "resolve_calls": _sql(_RESOLVED, f"SELECT s.evidence_id, s.status, s.start_byte, s.end_byte, sha256(v.text) AS source_sha256, strlen(v.text)::INT AS byte_length, coalesce(v.published_revision, 0)::INT AS published_revision, CASE WHEN v.purged THEN 'retention' ELSE '' END AS reason, coalesce(s.text, '') AS text, NOT v.purged AS verified FROM h JOIN s USING (evidence_id) JOIN v USING (doc_id) WHERE rn <= {RESOLVED}"),
    "chunk_lines": f"""WITH RECURSIVE t AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE text <> ''),
l AS (SELECT doc_id, i, sum(strlen(parts[i])) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS after FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\r\\n]*(\\r\\n|\\r|\\n)|[^\\r\\n]+') AS parts FROM documents))),
e AS (SELECT t.*, ends FROM t JOIN (SELECT doc_id, list(after ORDER BY i) AS ends FROM l GROUP BY doc_id) USING (doc_id)),
c AS (SELECT doc_id, -1 AS chunk, 0::BIGINT AS a, 0::BIGINT AS b FROM e UNION ALL SELECT c.doc_id, chunk + 1, b, {_NEXT} FROM c JOIN e ON e.doc_id = c.doc_id WHERE b < n)
SELECT doc_id, chunk::INT AS chunk, a::INT AS start_byte, b::INT AS end_byte FROM c WHERE chunk >= 0""",
}
