"""Connected components by contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """edges(src, dst) -> (node, label): label is the smallest node reachable; nodes without an edge do not appear.

    In a round every node takes its smallest neighbour, if smaller, as parent, then its parent's parent; edges are renamed
    to the parents and those within one parent are settled and dropped, so that what is joined shrinks from round to
    round. Each round is written to the shared folder. Minima are pre-aggregated before the shuffle; joins are on plain keys
    with one row for each on the parents' side, so Spark may split the edges of a hub. Empty edges give an empty table.
    """
    e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null")
    e = materialize(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), f"{name}-edges")
    labels = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("label", F.col("node"))
    live = e.where("src <> dst")
    for r in range(1, max_rounds + 1):
        low = live.groupBy(F.col("src").alias("v")).agg(F.min("dst").alias("p"))
        parent = materialize(low.unionByName(live.select(F.col("dst").alias("v"), F.col("dst").alias("p")).distinct()).groupBy("v").agg(F.min("p").alias("p")), f"{name}-parent-{r}")
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("up"))
        parent = materialize(parent.join(up, "p").select("v", F.col("up").alias("p")), f"{name}-up-{r}")
        labels = materialize(labels.join(parent.select(F.col("v").alias("label"), F.col("p").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label")), f"{name}-labels-{r}")
        a = live.join(parent.select(F.col("v").alias("src"), F.col("p").alias("a")), "src").select("a", "dst")
        b = a.join(parent.select(F.col("v").alias("dst"), F.col("p").alias("b")), "dst").where("a <> b").select("a", "b")
        live = materialize(b.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(), f"{name}-edges-{r}")
        if not live.limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
