"""Connected components of a list of links, contracted round by round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import forget, stored


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a bigint, b bigint) to one row per linked node: ``node``, ``root``.

    A round points each node at its smallest neighbour, if that is smaller,
    follows the pointers to their ends, and replaces the links by links between
    those ends.  Every component with a link left at least halves, so the rounds
    are logarithmic.  Each step is a join or a pre-aggregated minimum and is
    written to the shared folder, so a lost executor costs a step at most.  All
    nodes of a component get the same root, one of them.  Loops and repeated
    links do no harm; nulls are left out.
    """
    links = stored(links.where("a != b").distinct(), "links")
    roots = None
    while True:
        both = links.select("a", "b").union(links.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parents = stored(
            nearest.select("node", F.least("node", "low").alias("root")), "parents"
        )
        if parents.isEmpty():
            return stored(roots if roots is not None else parents, "roots")
        parents = _flattened(parents)
        ends = links
        for side in ("a", "b"):
            ends = ends.join(
                parents.select(F.col("node").alias(side), F.col("root").alias("_" + side)), side
            )
        ends = ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        left = stored(ends.where("a != b").distinct(), "links")
        forget(links)
        links = left
        if roots is None:
            roots = parents
        else:
            step = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = stored(
                roots.join(step, "root", "left").select(
                    "node", F.coalesce("next", "root").alias("root")
                ),
                "roots",
            )
            forget(roots)
            forget(parents)
            roots = moved
        if links.isEmpty():
            return roots


def _flattened(parents: DataFrame) -> DataFrame:
    """Pointers replaced by where they lead, doubling until none moves."""
    while True:
        step = parents.select(F.col("node").alias("root"), F.col("root").alias("next"))
        longer = stored(
            parents.join(step, "root").select(
                "node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")
            ),
            "pointers",
        )
        forget(parents)
        parents = longer.select("node", "root")
        if longer.where("moved").isEmpty():
            return parents
