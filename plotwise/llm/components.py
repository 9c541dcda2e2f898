"""Connected components of a link table by alternating stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import remove, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it is linked to by any path) for every node of a table of links a, b (long).

    Large star: every node hands its larger neighbours its smallest one. Small star: every node hands its
    smaller neighbours, and itself, the smallest. Both are a minimum per node, added up before the shuffle,
    and a join (a merge: nodes are never broadcast); the table never has more rows than links and nodes together, and a path of n nodes takes
    some log(n) rounds. Links of a node with itself and null ends are left out. If `rounds` do not settle it, that is an error.
    """
    spark = links.sparkSession
    a, b = F.col("a"), F.col("b")
    edges = written(links.where("a is not null and b is not null and a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a > b holds in every row of `large`: the smallest neighbour of a node with larger ones is below them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down.hint("merge"), "a").where("b <> m").select("b", "m").toDF("a", "b").unionByName(down.toDF("a", "b"))
        after = written(small.where("a <> b").distinct(), "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        remove(spark, edges.plotwise_path)
        edges = after
        if before == state:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
