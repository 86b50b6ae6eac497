"""From a plan to DataFrames over one snapshot.

A node that others read is computed once: its rows, of which the plan allows at most
10,001, or 100,001 edges, are fetched and handed on as a local table.  So are the rows
of a response before their status is looked up; the plan has checked their bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritome.operators import graph, search
from veritome.operators.tables import Tables, version_status
from veritome.plans.plan import Lexical, Literal, Neighbors, Plan, Regex, Semantic, Union

_SEARCH = {Literal: search.literal, Regex: search.regular_expression, Lexical: search.lexical, Semantic: search.semantic}


@dataclass
class Compiled:
    """A frame a node, and a frame of edges a neighbors node."""

    plan: Plan
    tables: Tables
    nodes: list[DataFrame]
    edges: dict[int, DataFrame]

    def results(self) -> DataFrame:
        """The output node's rows with their place, excerpt and status, by rank."""
        t, node = self.tables, self.plan.nodes[self.plan.output]
        rows = self.nodes[self.plan.output].where(F.col("rn") <= node.limit)
        spans = t.spans.select("evidence_id", "version_id", "start_byte", "end_byte", F.left("text", F.lit(self.plan.excerpt_bytes)).alias("excerpt"))
        # At most a node's limit of rows, so the other tables are probed, not moved.
        near = fetched(spans.join(F.broadcast(rows), "evidence_id"))
        status = version_status(t, near.select("version_id").distinct())
        return status.join(F.broadcast(near), "version_id").select("evidence_id", "version_id", "asset_id", "path", "start_byte", "end_byte", "status", "mode", "excerpt", "score", "rn").orderBy("rn")

    def edge_rows(self) -> DataFrame:
        """(node, source_id, kind, target_id, to_id, edge_rn) of the kept edges."""
        out = None
        for i, found in self.edges.items():
            part = found.where(F.col("edge_rn") <= self.plan.nodes[i].op.max_edges).select(F.lit(i).alias("node"), "source_id", "kind", "target_id", "to_id", "edge_rn")
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.tables.spark.createDataFrame([], "node int, source_id string, kind string, target_id string, to_id string, edge_rn int")

    def stats(self) -> DataFrame:
        """(node, n_rows, n_edges), each counted up to its limit plus one."""
        out = None
        for i, rows in enumerate(self.nodes):
            part = rows.agg(F.count("*").alias("n_rows")).withColumn("n_edges", F.lit(0).cast("long"))
            if i in self.edges:
                part = part.drop("n_edges").join(self.edges[i].agg(F.count("*").alias("n_edges")))
            part = part.select(F.lit(i).alias("node"), "n_rows", "n_edges")
            out = part if out is None else out.unionByName(part)
        return out


def fetched(rows: DataFrame) -> DataFrame:
    """The same few rows as a local table."""
    return rows.sparkSession.createDataFrame(rows.toArrow(), rows.schema)


def compile_plan(plan: Plan, t: Tables) -> Compiled:
    nodes: list[DataFrame] = []
    edges: dict[int, DataFrame] = {}
    for i, node in enumerate(plan.nodes):
        op, keep = node.op, node.limit + 1
        if isinstance(op, Neighbors):
            edges[i] = fetched(graph.edges(t, nodes[op.source], plan.nodes[op.source].limit, op))
            nodes.append(graph.endpoints(edges[i], op.max_edges, keep))
        elif isinstance(op, Union):
            nodes.append(graph.union([(nodes[k], plan.nodes[k].limit) for k in op.inputs], keep))
        else:
            nodes.append(_SEARCH[type(op)](t, op, keep))
        if len(plan.nodes) > 1:
            nodes[-1] = fetched(nodes[-1])
    return Compiled(plan, t, nodes, edges)
