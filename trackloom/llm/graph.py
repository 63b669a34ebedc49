"""Connected components by star contraction, every round a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import join_counted, store


def _linked_to_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges (u, v) with the least neighbour of u (or u itself) beside them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("degree"))
    least = least.withColumn("least", F.least("u", "least"))
    return join_counted(edges, least, ["u"], "degree", total)


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in ``links`` (a, b): the label is the least id of its component.

    Alternates two contractions that keep components: every node hands its larger neighbours to
    its least one, then its smaller ones likewise, until all are stars around least ids. Ids with
    a large share of all links are joined apart; no neighbourhood is gathered. Repeated links and
    links to itself count once or not at all; an id only linked to itself is not returned, and no
    links give no row.
    """
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), "links")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    state = print_of(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both, 2 * state[0]).where("v > u").select(
            F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        large = store(large, "links")
        near = _linked_to_least(large, 2 * state[0])  # no more than there are before
        small = near.select(F.explode(F.array(
            F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v"))
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = store(small, "links")
        before, state = state, print_of(edges)
        if before == state:
            break
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("id"), "label").distinct())
