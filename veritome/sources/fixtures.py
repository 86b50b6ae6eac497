"""Corpora made from the ``documents`` table by the set-based calls.

``lines``: four successive documents are the versions of one asset, with a span a
line.  Each revision is staged on the one before and published, but for the last one
of every third asset, which stays staged; then every seventh asset is retired, and
the first version of every fifth is purged where it is not current.  ``whole``: each
document is an asset of its own with one span and, if it has one, an embedding; those
without cannot be published.  Ids follow from the keys, so SQL can derive the same.

A corpus is written once a session and folder; queries read its tables.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritome.api import Evidence
from veritome.operators.tables import Tables
from veritome.sources import batch
from veritome.sources.shared import shared_dir

VERSIONS, MODEL, DIMENSIONS = 4, "fixture", 64
_made: dict[tuple[str, str], Evidence] = {}


def uuid_of(text: Column) -> Column:
    h = F.md5(text.cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _key(prefix: str, *parts: Column) -> Column:
    return uuid_of(F.concat(F.lit(prefix), F.concat_ws(":", *(p.cast("string") for p in parts))))


def _documents(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
    return docs.withColumn("asset_no", F.floor(F.col("doc_id") / VERSIONS)).withColumn("rev", F.col("doc_id") % VERSIONS + 1)


def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_no, last, published): the last revision and the last one to be published."""
    last = _documents(spark, sf_dir, ["doc_id"]).groupBy("asset_no").agg(F.max("rev").alias("last"))
    return last.withColumn("published", F.when(F.col("asset_no") % 3 == 0, F.col("last") - 1).otherwise(F.col("last")))


def line_ranges(texts: pa.Array) -> pa.Array:
    """The byte ranges of a text's non-empty lines, in order; all texts of a batch at once."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()), np.uint8)
    at = np.append(0, np.cumsum(sizes))
    breaks, every = np.flatnonzero(data == 10), np.arange(len(sizes))
    owner = np.append(every, np.searchsorted(at, breaks, "right") - 1)
    ordered = lambda places: places[np.lexsort((places, owner))]
    start, end, owner = ordered(np.append(at[:-1], breaks + 1)), ordered(np.append(at[1:], breaks)), np.sort(owner)
    some = start < end
    start, end = ((x - at[owner])[some].astype(np.int32) for x in (start, end))
    offsets = np.append(0, np.cumsum(np.bincount(owner[some], minlength=len(sizes)))).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([start, end], ["start_byte", "end_byte"]))


def line_spans(text: str) -> Column:
    """``line_ranges`` of a text column."""
    return F.arrow_udf(line_ranges, batch.SPANS)(text)


def corpus(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[Evidence, str]:
    """The corpus of a folder and its name, made when it is first asked for."""
    key, name = (spark.sparkContext.applicationId, sf_dir), "whole" if whole else "lines"
    if key not in _made:
        _made[key] = Evidence(spark, f"{shared_dir(spark)}/veritome-corpora-{uuid4().hex}", user="fixture", timeout=600.0)
    evidence = _made[key]
    if not evidence.exists(name):
        (_make_whole if whole else _make_lines)(evidence, f"{name}_new", sf_dir)
        evidence.rename(f"{name}_new", name)
    return evidence, name


def tables(spark: SparkSession, sf_dir: str, whole: bool = False) -> Tables:
    """The tables of a corpus: a span a line, or with ``whole`` a span and an embedding a document."""
    evidence, name = corpus(spark, sf_dir, whole)
    return evidence.tables(name)


def _paths(docs: DataFrame, number: str) -> DataFrame:
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.lpad(F.col(number).cast("string"), 8, "0"), F.lit(".txt")))
    return docs.withColumn("path", path).withColumn("ingestion_key", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))


def _make_lines(evidence: Evidence, name: str, sf_dir: str) -> None:
    spark = evidence.spark
    evidence.init_collection(name, {})
    docs = _paths(_documents(spark, sf_dir, ["doc_id", "text", "lang", "source"]), "asset_no").withColumn("asset_id", _key("a:", F.col("asset_no")))
    life = _lifecycle(spark, sf_dir)
    rows = docs.select("asset_id", "path", F.col("text").alias("source"), "ingestion_key", (F.col("rev") - 1).alias("expected_revision"), "doc_id", "asset_no", "rev")
    version = batch._id("version", "ingestion_key").alias("version_id")
    for rev in range(1, VERSIONS + 1):
        some = rows.where(F.col("rev") == rev)
        batch.stage(evidence, name, some.withColumn("spans", line_spans("source")))
        batch.publish(evidence, name, some.join(life.select("asset_no", "published"), "asset_no").where("rev <= published").select(version))
    batch.retire(evidence, name, life.where("asset_no % 7 = 0").select(_key("a:", F.col("asset_no")).alias("asset_id"), F.col("published").alias("expected_revision")))
    batch.purge(evidence, name, rows.where("asset_no % 5 = 0 and rev = 1").select(version, F.lit("retention").alias("reason")))
    first = docs.groupBy("asset_no").agg(F.min_by("lang", "doc_id").alias("lang"), F.min_by("source", "doc_id").alias("source"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("asset_no", F.floor(F.col("doc_id") / VERSIONS))
    tags = first.select("asset_no", F.explode(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("src:"), "source"))).alias("tag")).unionByName(
        labels.select("asset_no", F.explode(F.array(F.concat(F.lit("quality:"), F.col("quality").cast("string")), F.concat(F.lit("toxic:"), F.col("toxic").cast("string")))).alias("tag"))
    )
    batch.tag(evidence, name, tags.select(_key("a:", F.col("asset_no")).alias("asset_id"), "tag"))
    batch.link(evidence, name, _relations(docs.select("doc_id", "text")))


def _make_whole(evidence: Evidence, name: str, sf_dir: str) -> None:
    spark = evidence.spark
    evidence.init_collection(name, {"embedding_model": MODEL, "embedding_dimensions": DIMENSIONS})
    docs = _paths(_documents(spark, sf_dir, ["doc_id", "text", "lang", "source"]), "doc_id").withColumn("asset_id", _key("w:", F.col("doc_id")))
    rows = docs.select("asset_id", "path", F.col("text").alias("source"), "ingestion_key", F.lit(0).alias("expected_revision"), "doc_id")
    spans = rows.where("source <> ''").select("ingestion_key", F.lit(0).alias("start_byte"), F.octet_length("source").alias("end_byte"))
    staged = batch.stage(evidence, name, rows, spans)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").join(rows.where("source <> ''").select(F.col("doc_id").alias("vec_id"), "ingestion_key", F.octet_length("source").cast("string").alias("n")), "vec_id")
    batch.attach(evidence, name, vectors.select(batch._id("span", "ingestion_key", F.lit("0"), "n").alias("evidence_id"), "embedding"))
    batch.publish(evidence, name, staged.where("problem is null"))


def _relations(docs: DataFrame) -> DataFrame:
    """``follows``: a line and the next one; ``copy_of``: the first line of a copy and that of the first equal text."""
    key = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    spans = docs.select("doc_id", key.alias("key"), line_spans("text").alias("spans"))
    span_id = lambda x: batch._id("span", "key", x["start_byte"].cast("string"), x["end_byte"].cast("string"))
    ids = spans.where(F.size("spans") > 1).select(F.transform("spans", span_id).alias("ids"))
    pairs = F.arrays_zip(F.slice("ids", F.lit(1), F.size("ids") - 1).alias("a"), F.slice("ids", F.lit(2), F.size("ids") - 1).alias("b"))
    follows = ids.select(F.explode(pairs).alias("p")).select(F.col("p.a").alias("source_evidence_id"), F.lit("follows").alias("kind"), F.col("p.b").alias("target_evidence_id"))
    rest = docs.select("doc_id", key.alias("key"), F.octet_length("text").alias("n"), F.ltrim("text", F.lit("\n")).alias("rest")).where("rest <> ''").withColumn("start_byte", F.col("n") - F.octet_length("rest"))
    first = F.struct("start_byte", (F.col("start_byte") + F.octet_length(F.substring_index("rest", "\n", 1))).alias("end_byte"))
    first_line = rest.select("doc_id", span_id(first).alias("id"))
    digests = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first_doc"))
    copies = digests.join(firsts, "digest").where("doc_id <> first_doc").select("doc_id", "first_doc").join(first_line, "doc_id")
    copies = copies.join(first_line.select(F.col("doc_id").alias("first_doc"), F.col("id").alias("first_id")), "first_doc")
    return follows.unionByName(copies.select(F.col("id").alias("source_evidence_id"), F.lit("copy_of").alias("kind"), F.col("first_id").alias("target_evidence_id")))
