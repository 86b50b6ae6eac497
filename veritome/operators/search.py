"""Search operators: ranked rows (evidence_id, score, mode, rn) of current spans.

Predicates on the text are stated on ``spans`` alone, so they reach the scan;
filters on assets are semi joins on the small side.  Each operator keeps one row
more than its limit, which shows whether it was cut, and numbers what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritome.functions import fulltext, regex, vectors
from veritome.operators.tables import Tables, current_versions
from veritome.plans.plan import Filter, Lexical, Literal, Regex, Semantic

NODE_SCHEMA = "evidence_id string, score double, mode string, rn int"


def numbered(rows: DataFrame, order: list[Column], keep: int) -> DataFrame:
    """The first ``keep`` rows in order, with their number; the window sees only these."""
    top = rows.orderBy(*order).limit(keep)
    return top.withColumn("rn", F.row_number().over(Window.orderBy(*order)))


def filtered_versions(t: Tables, f: Filter) -> DataFrame:
    """Current versions that pass a filter; empty lists filter nothing."""
    rows = current_versions(t)
    if f.path_prefix is not None:
        rows = rows.where(F.col("path").startswith(f.path_prefix))
    if f.asset_ids:
        rows = rows.where(F.col("asset_id").isin(list(f.asset_ids)))
    if f.tags_any:
        rows = rows.join(t.tags.where(F.col("tag").isin(list(f.tags_any))).select("asset_id"), "asset_id", "left_semi")
    if f.tags_all:
        wanted = list(dict.fromkeys(f.tags_all))
        full = t.tags.where(F.col("tag").isin(wanted)).groupBy("asset_id").agg(F.count_distinct("tag").alias("n")).where(F.col("n") == len(wanted))
        rows = rows.join(full.select("asset_id"), "asset_id", "left_semi")
    return rows


def _by_place(t: Tables, found: DataFrame, f: Filter, mode: str, keep: int) -> DataFrame:
    rows = found.join(filtered_versions(t, f).select("version_id", "path"), "version_id")
    top = numbered(rows.select("path", "start_byte", "evidence_id"), [F.col("path"), F.col("start_byte"), F.col("evidence_id")], keep)
    return top.select("evidence_id", F.lit(None).cast("double").alias("score"), F.lit(mode).alias("mode"), "rn")


def literal(t: Tables, op: Literal, keep: int) -> DataFrame:
    """Spans that contain the text; by path, place and id."""
    found = t.spans.where(F.col("text").contains(op.text)).select("evidence_id", "version_id", "start_byte")
    return _by_place(t, found, op.filter, "literal", keep)


def regular_expression(t: Tables, op: Regex, keep: int) -> DataFrame:
    """Spans in which the pattern is found; by path, place and id."""
    pattern = regex.checked(t.spark, op.pattern, op.case_insensitive)
    found = t.spans.where(F.col("text").rlike(pattern)).select("evidence_id", "version_id", "start_byte")
    return _by_place(t, found, op.filter, "regex", keep)


def lexical(t: Tables, op: Lexical, keep: int) -> DataFrame:
    """Spans that satisfy the query; by rank, then id."""
    tree = fulltext.parse(op.query, op.syntax)
    found = t.spans.where(fulltext.matches(tree, F.col("tokens"))).select("evidence_id", "version_id", "tokens")
    rows = found.join(filtered_versions(t, op.filter).select("version_id"), "version_id")
    scored = rows.select("evidence_id", (fulltext.rank(tree, F.col("tokens")) if tree else F.lit(0.0)).alias("score"))
    return numbered(scored, [F.col("score").desc(), F.col("evidence_id")], keep).select("evidence_id", "score", F.lit("lexical").alias("mode"), "rn")


def semantic(t: Tables, op: Semantic, keep: int) -> DataFrame:
    """Spans by cosine distance to the vector, then id; exact."""
    rows = t.embeddings.join(t.spans.select("evidence_id", "version_id"), "evidence_id").join(filtered_versions(t, op.filter).select("version_id"), "version_id")
    query = F.array(*(F.lit(float(x)) for x in op.vector))
    scored = rows.select("evidence_id", vectors.cosine_distance(F.col("embedding"), query).alias("score"))
    return numbered(scored, [F.col("score"), F.col("evidence_id")], keep).select("evidence_id", "score", F.lit("semantic").alias("mode"), "rn")
