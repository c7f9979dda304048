"""Mixing sources to target weights as a time-varying curriculum.

Each source's weight changes over training time by a schedule; its integral, scaled to the source's target, is the
source's cumulative token demand. A source's documents lie end to end on its token line in the order of a hash; a second
copy of the line follows the first. Inverting the demand at a document's place gives its training position, and sorting
by ranges of positions gives the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TAG, settled, stash, tagged

#: Base weights by rank of the source, repeating; share of all sizes that the mix takes; most copies of a document.
WEIGHTS, TOTAL_PERCENT, MAX_COPIES = (5, 2, 1), 150, 2
#: A schedule is w(t) = 1 + slope (2t - 1), t from 0 to 1; slopes by rank of the source, repeating.
SLOPES = (-0.75, 0.0, 0.75)
WORDS = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash that cut a source's token line into pieces for the running sums (16^3 = 4096 pieces).
PIECE_DIGITS = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """From ``source, size`` rows: ``source, source_size, rank, target``. One row a source.

    Sources take part in the order of code points, null last. A target is the smaller of twice the source's size and its
    weight times the level at which all targets add up to the total: the level is the highest that the sources in the
    order of size by weight reach, so no reshare has to be repeated.
    """
    cast = lambda xs: F.array(*[F.lit(x) for x in xs])
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", F.element_at(cast(WEIGHTS), F.col("rank") % len(WEIGHTS) + 1).cast("long"))
    ranked = ranked.withColumns({"cap": F.col("source_size") * MAX_COPIES, "goal": F.sum("source_size").over(Window.partitionBy()) * TOTAL_PERCENT / F.lit(100.0)})
    run = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(run.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("level", F.max((F.col("goal") - before) / rest).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return levels.select("source", "source_size", "rank", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _position(place, demand, slope):
    """The time t at which a source's cumulative demand reaches ``place``: a t^2 + (1 - a) t = place / demand."""
    y = place / demand
    return 2 * y / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * y))


def _schedule(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row for each row of ``docs``: what ``mix`` says of it, and its ``copies``: ``words, position`` of each one taken."""
    rows = tagged(docs, id_col, text_col, source_col)
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    sized = stash(rows.select(TAG, "doc_id", F.col(f"`{source_col}`").cast("string").alias("source"), size.alias("size"), F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("h")))
    sized = sized.withColumns({"key": F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce("source", F.lit(""))), "piece": F.substring("h", 1, PIECE_DIGITS)})
    # words before each piece of the line: sums of pieces, then running sums over at most 4097 pieces a source
    pieces = sized.groupBy("key", "piece").agg(F.sum("size").alias("piece_size"))
    ahead = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("key", "piece", F.coalesce(F.sum("piece_size").over(ahead), F.lit(0)).alias("piece_start"))
    targets = source_targets(sized)
    targets = targets.select(F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce("source", F.lit(""))).alias("key"), "source_size", "rank", "target")
    placed = sized.join(starts.join(targets, "key"), ["key", "piece"])
    within = Window.partitionBy("key", "piece").orderBy("h", "doc_id", "size", TAG).rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("piece_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = placed.withColumn("at", at)
    goal = F.floor("target").cast("long")
    first = F.least(F.col("size"), F.greatest(F.lit(0), goal - F.col("at")))
    second = F.least(F.col("size"), F.greatest(F.lit(0), goal - F.col("source_size") - F.col("at")))
    slope = F.element_at(F.array(*[F.lit(x) for x in SLOPES]), F.col("rank") % len(SLOPES) + 1)
    copies = F.array(*[F.when(n > 0, F.struct(n.alias("words"), _position(F.col("at") + k * F.col("source_size"), F.col("target"), slope).alias("position"))) for k, n in enumerate((first, second))])
    return placed.select(TAG, "doc_id", "size", "source_size", "target", F.array_compact(copies).alias("copies"))


def _in_order(copies: DataFrame) -> DataFrame:
    """Copies in the order of the mix: by training time, dealt by ranges of it."""
    return copies.repartitionByRange("position", TAG).sortWithinPartitions("position", TAG)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, size, source_size, target, taken, positions`` and the row tag.

    ``size`` is the number of words (null text: 0); ``taken`` the words that the mix takes of it, summed over its copies in
    the mix, at most twice its size: each source's words add up to its target, rounded down, the last document being taken in
    part. ``positions`` has the training time, from 0 to 1, of each copy that is taken. Order within a source is by md5 of the
    id as text, then the id and size: equal rows are alike, so reruns agree. Null sources are one source, weighed last; null
    ids sort first; an empty table gives an empty result.
    """
    own = [TAG, "doc_id", "size", "source_size", "target"]
    copies = _in_order(_schedule(docs, id_col, text_col, source_col).select(*own, F.inline_outer("copies")))
    taken = copies.groupBy(*own).agg(F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("taken"), F.min("position").alias("a"), F.max("position").alias("b"), F.count("position").alias("n"))
    return taken.select(*own, "taken", F.array_compact(F.array("a", F.when(F.col("n") > 1, F.col("b")))).alias("positions"))


def mixed_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the columns of ``docs`` for every copy that is taken, range-sorted by ``position``.

    A column of ``docs`` named ``position`` is replaced. Copies of one document are rows of their own.
    """
    docs = settled(docs)
    plan = _schedule(docs, id_col, text_col, source_col).select(TAG, F.inline("copies")).drop("words")
    kept = [c for c in docs.columns if c != "position"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(TAG, F.monotonically_increasing_id())
    return _in_order(rows.join(plan, TAG)).select(*[F.col(f"`{c}`") for c in kept], "position")
