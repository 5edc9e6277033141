"""Connected components by alternating star contraction (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.staging import discard, stage


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(print, root) for every end of a link: root is the smallest value that links reach.

    Each round costs two aggregations by vertex and two joins, on links alone; rounds grow with the logarithm of the largest
    component. A vertex with many links is a minimum to aggregate and a join side that adaptive execution can split, never a
    gathered group. Vertices without links are not returned.
    """
    a, b = F.col(left), F.col(right)
    now = stage(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return now.groupBy("u").agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()).groupBy("u").agg(F.min("root").alias("root")).withColumnRenamed("u", "print")
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        new = stage(small, "links")
        discard(now)
        now = new
