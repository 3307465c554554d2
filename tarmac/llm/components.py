"""Connected components by smallest label, with each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.sources.scratch import stage


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label for every node: the smallest ``label`` among the nodes it is connected to. Further columns of ``nodes`` stay.

    ``nodes`` has unique nodes with their own labels, ``edges`` has columns a, b. Each round lets every root take the smallest root that
    an edge reaches and then follows two steps of the resulting tree, so that long chains shrink geometrically. A round goes on with
    the distinct links between different roots alone. Only the nodes at links take part; the state of a round is a written table, which
    cuts the lineage.
    """
    links = stage(_between(edges), "links")
    touched = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    # Roots are nodes here; labels come in at the end, since several nodes may share a label.
    state = stage(touched.select("node", F.col("node").alias("root")), "roots")
    while True:
        hooks = stage(links.groupBy(F.col("a").alias("root_a")).agg(F.min("b").alias("root_b")), "hooks")
        if hooks.isEmpty():
            break
        # A hook leads to a smaller root, so hooks have no cycle; they are shortened until all point to a root.
        hooks = _shorten(hooks)
        state = stage(state.join(hooks, F.col("root") == F.col("root_a"), "left").select(
            "node", F.coalesce("root_b", "root").alias("root")), "roots")
        to_a, to_b = (hooks.select(F.col("root_a").alias(f"_{name}"), F.col("root_b").alias(f"to_{name}")) for name in ("a", "b"))
        links = stage(_between(links.join(to_a, F.col("a") == F.col("_a"), "left").join(to_b, F.col("b") == F.col("_b"), "left").select(
            F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b"))), "links")
    joined = nodes.join(state.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(
        *nodes.columns, F.coalesce("root", "node").alias("root"))
    joined = stage(joined, "rooted")
    best = stage(joined.groupBy(F.col("root").alias("_root")).agg(F.min("label").alias("best")), "component-labels")
    return stage(joined.join(best, F.col("root") == F.col("_root")).select(
        *(F.col("best").alias(name) if name == "label" else name for name in nodes.columns)), "components")


def _between(edges: DataFrame) -> DataFrame:
    """Every link between two different ends once, the larger end as a."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _shorten(hooks: DataFrame) -> DataFrame:
    while True:
        further = hooks.select(F.col("root_a").alias("_a"), F.col("root_b").alias("_b"))
        longer = stage(hooks.join(further, F.col("root_b") == F.col("_a"), "left").select(
            "root_a", F.coalesce("_b", "root_b").alias("root_b"), F.col("_b").isNotNull().alias("moved")), "hooks")
        hooks = longer.select("root_a", "root_b")
        if longer.where("moved").isEmpty():
            return hooks
