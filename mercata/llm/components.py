"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.functions.lineage import materialize


def _signature(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
    )


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` that isn't its component's root.

    The root is the component's smallest node. Large-star and small-star
    rounds alternate until the links are stars around the roots; the number
    of rounds is of the order of the logarithm of the longest chain. Each
    round is aggregates with map-side combine and equi-joins whose hub side
    AQE can split, and ends in a reliable checkpoint, so that the lineage
    stays short and a lost executor costs no earlier round. Links with a null
    end are ignored; an empty table gives an empty result.
    """
    pairs = links.select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).isNotNull().alias("_x"), F.col(b).isNotNull().alias("_y")
    ).where("_x and _y and a <> b")
    edges = materialize(pairs.select("a", "b").distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        # written first, so that both sides of the join are plain exchanges and AQE can split a hub
        low = materialize(low.select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(
                F.struct(F.col("a"), F.col("m").alias("b")),
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            )).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        edges = materialize(small)
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
