"""Connected components by label propagation with pointer jumping, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize


def component_labels(edges: DataFrame, *, rounds: int = 100) -> DataFrame:
    """node, component: the least node reachable. edges: a, b, in either direction.

    Each round links every node's larger neighbours to its least one, then every node to the least
    of its smaller ones (alternating large and small stars), until nothing changes; rounds grow with the logarithm
    of the size. Each round is written to the shared folder; the driver gets one number from it.
    """
    both = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(both)
    seen = None
    for _ in range(rounds):
        around = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = around.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(least, "a")
        small = joined.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b"))).distinct()
        now = materialize(small)
        # sums of hashes tell whether the set of links has changed
        print_ = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_ == seen:
            break
        seen = print_
    else:
        raise RuntimeError("components haven't settled")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
