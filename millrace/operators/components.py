"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.shared import materialize, scratch

#: So many edges (a few MB) are one partition, whose rounds shuffle nothing; more are dealt by node.
FEW = 1 << 16


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, few: int = FEW) -> DataFrame:
    """node, component (the least node reachable) for every node of an edge between two different nodes.

    Edges with a null end and loops are dropped; repeated and reversed edges do no harm; no edge gives
    no rows. Edges lead from the greater node u to the lesser v. Each round groups by node with partial aggregation, joins the minimum back (a hub is an
    ordinary skewed join key) and writes its edges to the shared folder, so the plan stays short. Once a round leaves
    each u one edge, the edges are trees, one a component, and pointers to their roots are doubled.
    """

    def written(edges: DataFrame) -> tuple[DataFrame, dict]:
        """edges (u, v, k) without k, in a table; n rows, of which k have that mark."""
        seen = Observation()
        table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).select("u", "v"), "edges")
        return (table.coalesce(1) if seen.get["n"] <= few else table), seen.get

    with scratch(edges.sparkSession):  # the rounds' tables
        e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        e, now = written(e.distinct().withColumn("k", F.lit(0)))
        for _ in range(most_rounds):
            if now["n"] == now["k"]:
                break
            small = now["n"] <= few
            dealt = lambda d, small=small: d.coalesce(1) if small else d
            least = e.groupBy("u").agg(F.min("v").alias("m"))
            star = e.join(least.select(F.col("u").alias("v"), "m"), "v", "left").select("u", F.coalesce("m", "v").alias("v"))
            star = dealt(star.unionByName(least.select("u", F.col("m").alias("v"))))
            low = star.groupBy("u").agg(F.min("v").alias("m"))
            more = star.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(0).alias("k"))
            both = dealt(more.unionByName(low.select("u", F.col("m").alias("v"), F.lit(1).alias("k"))))
            e, now = written(both.groupBy("u", "v").agg(F.max("k").alias("k")))  # k: the one edge to the least; others: none
        else:
            raise RuntimeError("components did not settle")
        while now["n"] and now["k"]:
            up = e.select(F.col("u").alias("v"), F.col("v").alias("w"))
            e, now = written(e.join(up, "v", "left").select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().cast("int").alias("k")))
        e = materialize(e, "components", keep=True)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
