"""The lineage graph of a warehouse, end to end: nodes, inferred and logged edges, and the impact of changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import graph, infer
from plumbline.session import cut_lineage


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def warehouse_graph(
    spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, log: DataFrame | None = None
) -> Graph:
    """Tables and columns as nodes; edges found in the data, and those of a lineage log if there is one.

    The edges are written down, so that each later question does not infer them again.
    """
    edges = infer.infer_edges(spark, tables)
    if log is not None:
        edges = edges.unionByName(graph.log_edges(log))
    return Graph(graph.nodes_of(spark, tables, keys), cut_lineage(edges))


def impact_of(found: Graph, ops: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Effects of operations on all nodes that they reach; see ``graph.impact``."""
    return graph.impact(ops, found.nodes, found.edges, max_hops)
