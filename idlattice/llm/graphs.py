"""Connected components of a link table, without gathering links or components anywhere.

Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond", 2014) until the stars stand still. Each step takes minima by aggregation, which combines on
the map side, and joins them back, which Spark splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    low = _minima(down)
    own = low.select("u", F.col("m").alias("v"))
    rest = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(rest).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u long, v long) -> (u, v): every node that has a smaller one in its component, with the smallest.

    The smallest nodes themselves have no row. Empty edges give no rows.
    """
    now = materialize(edges.where("u != v").select("u", "v"), "links")
    state = None
    for _ in range(most_rounds):
        after = materialize(_small_star(_large_star(now)), "stars")
        drop_table(now)
        now = after
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            return now
        state = tuple(mark)
    raise RuntimeError("the components did not settle")
