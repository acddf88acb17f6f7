"""Connected components by contraction: hook each node to its smallest neighbour, jump to the roots, join what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import keep


def _roots(parents: DataFrame) -> DataFrame:
    """node, parent with every parent a root, by pointer jumping; parents are smaller than their nodes, or equal at roots."""
    was = None
    while (total := parents.agg(F.sum(F.col("parent").cast("decimal(38,0)"))).first()[0]) != was:
        was = total
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        parents = keep(parents.join(up, "parent").select("node", F.col("next").alias("parent")), "parents")
    return parents


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node with a link in links(a long, b long).

    Loops and repeated links do no harm; null ends are dropped, as nothing links to them. Each round replaces nodes by the
    roots of the forest that their smallest neighbours form, so links shrink fast and no round sees more of them than the
    one before. A hub's rows meet one row on the other side of each join, so Spark can split them.
    """
    ends = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = keep(ends(links.where("a is not null and b is not null")), "links")
    found = None
    for _ in range(rounds):
        if links.isEmpty():
            return found if found is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        both = links.union(links.select(F.col("b"), F.col("a")))
        parents = _roots(keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent")), "parents"))
        one = links.join(parents, F.col("a") == F.col("node")).select(F.col("parent").alias("a"), "b")
        links = keep(ends(one.join(parents, F.col("b") == F.col("node")).select("a", F.col("parent").alias("b"))), "links")
        if found is None:
            found = parents.withColumnRenamed("parent", "component")
        else:
            up = parents.select(F.col("node").alias("component"), "parent")
            found = keep(found.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "components")
    raise RuntimeError(f"components not settled after {rounds} rounds")
