"""Connected components by alternating stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgrid.llm.scratch import Scratch


def _lowest(pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """For each u the smallest of itself and its v's; written, so that a hot u can be split in the join that follows."""
    return scratch.put(pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), name)


def _are_stars(pairs: DataFrame) -> bool:
    """Whether each u has one v, which is no u itself."""
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("top")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("top")),
    )).alias("x")).groupBy("x.node").agg(F.sum("x.down").alias("down"), F.max("x.top").alias("top"))
    return ends.where("down > 1 or (down = 1 and top = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """From links (u long, v long) the rows (node, component): component is the smallest node reachable.

    Nodes without a link, self-links and nulls are left out; links may repeat. Each round
    points all of a node's larger neighbours at its smallest one, then its smaller ones, until
    all are stars; rounds are about logarithmic in a component's length.
    """
    now = scratch.put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-0")
    for k in range(max_rounds):
        if _are_stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = scratch.put(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), f"cc-both-{k}")
        low = _lowest(both, scratch, f"cc-large-{k}")
        large = scratch.put(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), f"cc-mid-{k}")
        low2 = _lowest(large, scratch, f"cc-small-{k}")
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).union(low2.select("u", F.col("low").alias("v")))
        now = scratch.put(small.where("u <> v").distinct(), f"cc-{k + 1}")
        scratch.drop(f"cc-both-{k}", f"cc-large-{k}", f"cc-mid-{k}", f"cc-small-{k}", f"cc-{k}")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
