"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportloom.llm.cluster import cut, few, salted_join

#: Steps needed grow with the logarithm of the longest chain; more than this means a fault.
MOST_STEPS = 60


def components(links: DataFrame, n: int | None = None) -> DataFrame:
    """(node, root) for every node of (a, b) but the roots, which are the smallest nodes of their components.

    Steps are in ``few`` parts for a table of ``n`` rows; no step has more links than there were.
    """
    stars = few(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), n)
    for _ in range(MOST_STEPS):
        stars = cut(stars)
        low = stars.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
        chained = stars.select("v").distinct().join(low.select(F.col("u").alias("v")), "v", "left_semi")
        if few(low.where("n > 1"), n).isEmpty() and few(chained, n).isEmpty():
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # large star: what hangs on v goes to the smallest neighbour of v
        lower = low.select(F.col("u").alias("v"), F.col("low").alias("next"))
        stars = few(salted_join(stars, "v", lower, n=n).select("u", F.coalesce("next", "v").alias("v")).distinct(), n)
        # small star: u and its smaller neighbours go to the smallest of them
        low = stars.groupBy("u").agg(F.min("v").alias("low"))
        both = few(stars.join(low, "u"), n)
        stars = both.select("u", F.col("low").alias("v")).union(both.select(F.col("v").alias("u"), F.col("low").alias("v"))).where("u <> v").distinct()
        stars = few(stars, n)
    raise RuntimeError("components did not settle")
