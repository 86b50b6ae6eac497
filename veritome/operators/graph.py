"""One hop along relations, and the union of ranked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritome.operators.search import numbered
from veritome.operators.tables import Tables, version_status
from veritome.plans.plan import Neighbors


def edges(t: Tables, seeds: DataFrame, seed_limit: int, op: Neighbors) -> DataFrame:
    """(from_rn, source_id, kind, target_id, to_id, dir, edge_rn): the first ``max_edges`` + 1 edges.

    ``seeds`` are at most a node's limit of rows, a bound that the plan has
    checked, so they may be broadcast to the relations.
    """
    near = F.broadcast(seeds.where(F.col("rn") <= seed_limit).select(F.col("evidence_id").alias("seed"), F.col("rn").alias("from_rn")))
    rel = t.relations.select("source_evidence_id", "kind", "target_evidence_id")
    if op.kinds:
        rel = rel.where(F.col("kind").isin(list(op.kinds)))
    sides = []
    for direction, number, here, there in (("out", 0, "source_evidence_id", "target_evidence_id"), ("in", 1, "target_evidence_id", "source_evidence_id")):
        if op.direction in (direction, "both"):
            hop = rel.join(near, F.col(here) == F.col("seed"))
            sides.append(hop.select("from_rn", F.col("source_evidence_id").alias("source_id"), "kind", F.col("target_evidence_id").alias("target_id"), F.col(there).alias("to_id"), F.lit(number).alias("dir")))
    found = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    if op.statuses:
        fitting = version_status(t).where(F.col("status").isin(list(op.statuses))).select("version_id")
        # All edges of the seeds, before any limit: as many as the relations hold, so nothing is broadcast here.
        ends = t.spans.select(F.col("evidence_id").alias("to_id"), "version_id").join(found.select("to_id"), "to_id", "left_semi").join(fitting, "version_id", "left_semi")
        found = found.join(ends.select("to_id"), "to_id", "left_semi")
    order = [F.col(c) for c in ("from_rn", "kind", "to_id", "dir")]
    return numbered(found, order, op.max_edges + 1).withColumnRenamed("rn", "edge_rn")


def endpoints(found: DataFrame, max_edges: int, keep: int) -> DataFrame:
    """Where the kept edges lead, by the first edge that leads there."""
    first = found.where(F.col("edge_rn") <= max_edges).groupBy("to_id").agg(F.min("edge_rn").alias("first_edge"))
    top = numbered(first, [F.col("first_edge")], keep)
    return top.select(F.col("to_id").alias("evidence_id"), F.lit(None).cast("double").alias("score"), F.lit("neighbors").alias("mode"), "rn")


def union(inputs: list[tuple[DataFrame, int]], keep: int) -> DataFrame:
    """Rows of all inputs, each id once, from the earliest input and rank that has it."""
    parts = [rows.where(F.col("rn") <= limit).select("evidence_id", F.struct(F.lit(k).alias("inp"), F.col("rn").alias("irn"), "score", "mode").alias("w")) for k, (rows, limit) in enumerate(inputs)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    best = both.groupBy("evidence_id").agg(F.min("w").alias("w")).select("evidence_id", "w.*")
    order = [F.col("inp"), F.col("irn")]
    top = best.orderBy(*order).limit(keep).withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    return top.select("evidence_id", "score", "mode", "rn")
