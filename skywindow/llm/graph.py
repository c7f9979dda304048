"""Connected components and bucket leaders, as joins and sums that no hot group can pile up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the ``a, b`` edges: the least node of its component.

    Least labels spread along edges, then jump along labels, until nothing changes: a logarithm of rounds of the longest
    path. Each round is sums by node (combined before the shuffle) and joins; its state is written to the shared folder.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        moved = stash(least.join(jump, least.label == jump.at, "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")))
        labels = moved.select("node", "label")
        if moved.where("old != label").isEmpty():
            return labels


def contracted(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` with the same components as ``from, a, b`` ones, but one for each ``from`` and set of ends.

    ``from`` is a node of ``a``'s part; its ends ``b`` are few, as only leaders are ends. It keeps the edge to the least
    one, and each distinct set of ends is linked once, however many nodes have it.
    """
    stars = edges.groupBy("from").agg(F.first("a").alias("a"), F.sort_array(F.collect_set("b")).alias("ends"))
    stars = stash(stars)
    between = stars.where(F.size("ends") > 1).select("ends").distinct().select(F.col("ends")[0].alias("a"), F.explode(F.slice("ends", 2, F.size("ends"))).alias("b"))
    return stars.select("a", F.col("ends")[0].alias("b")).union(between).where("a != b").distinct()


def relabelled(labels: DataFrame | None, joined: DataFrame) -> DataFrame:
    """``node, label`` after the labels themselves have been joined into the components ``joined`` (``node, label``)."""
    if labels is None:
        return joined
    to = joined.toDF("at", "to")
    moved = labels.join(to, labels.label == to.at, "left").select("node", F.coalesce("to", "label").alias("label"))
    return stash(moved.unionByName(joined.join(labels.select("node"), "node", "left_anti")))


def leader_pairs(rows: DataFrame, small: int, leaders: int, carry: tuple[str, ...] = (), likely: Callable[[], Column] | None = None, order: str = "a") -> tuple[DataFrame, DataFrame]:
    """Pairs ``key, a, b`` to verify in each bucket of ``key, a`` rows, and the rows of the large buckets with ``leads``.

    Buckets of up to ``small`` members give all pairs. In larger ones about ``leaders`` members, those of least hash, are
    paired with each member: the number of pairs grows with the members, not with their square, and as the hash is the same
    in every bucket, members of one group meet the same few leaders in all buckets that they share. So does the member that
    ``order`` puts first. Columns of ``carry`` come along, those of ``b`` with ``_b`` behind their names; ``likely`` is a
    condition on them.
    """
    rank = F.pmod(F.xxhash64("a", F.lit(17)), F.lit(1 << 30))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.col(order).alias("o"), rank.alias("h"), "a")).alias("first")).where("n > 1")
    sized = rows.join(counts, "key")
    sized = sized.withColumn("leads", (F.col("n") <= small) | (rank * F.col("n") < F.lit(leaders << 30)) | (F.col("a") == F.col("first.a")))
    heads = sized.where("leads").select("key", F.col("a").alias("b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    found = sized.join(heads, "key").where((F.col("a") != F.col("b")) & ((F.col("a") < F.col("b")) | ~F.col("leads")))
    if likely is not None:
        found = found.where(likely())
    return found.select("key", "a", "b", *carry, *[f"{c}_b" for c in carry]), sized.where(F.col("n") > small).select("key", "a", *carry, "leads")
