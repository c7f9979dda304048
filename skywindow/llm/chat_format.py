"""Multi-party perspective rotation: each participant in turn is the assistant, all others are named users.

DataFrame functions only. A conversation of up to ``CHUNK`` turns is one text for each perspective; a longer one is cut,
in the order of its turns, into texts of ``CHUNK`` turns by a range sort. ``whole_conversations`` joins them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

CHUNK = 512
SYSTEM, UNKNOWN = "system", "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _render(df: DataFrame, keys: list[str]) -> DataFrame:
    """From ``turns`` (array of structs with role and text) and ``perspective``: the text and its mask."""

    def head(t: Column) -> Column:
        who = F.when(t["role"] == SYSTEM, F.lit(SYSTEM)).when(t["role"] == F.col("perspective"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), t["role"]))
        return F.concat(F.lit(OPEN), who, F.lit("\n"))

    parts = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(CLOSE)).alias("body"), (t["role"] == F.col("perspective")).alias("own")))
    df = df.withColumn("parts", parts)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(p["own"], F.concat(acc["mask"], own)).otherwise(acc["mask"]).alias("mask"))

    return df.select(
        *keys, "perspective", F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n")))).alias("rendered"),
        F.aggregate("parts", start, step, lambda acc: acc["mask"]).alias("mask"),
    )


def rotate_perspectives(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation (or piece of a long one) and participant: ``conv_id, chunk, perspective, n_turns, rendered, mask``.

    Every turn reads ``<|im_start|>`` + ``assistant``, ``system`` or ``user name=<role>`` + line feed + text + ``<|im_end|>``
    + line feed. ``mask`` lists the code points (start, end exclusive) that are learned from: text and ``<|im_end|>`` of the
    perspective's own turns. Participants are all roles but ``system``; a null or empty role is ``unknown``, and characters
    other than letters, digits, ``_`` and ``-`` in a role become ``_``. Turns are in the order of turn (null first), role,
    text; repeated rows repeat. A null text is empty; ``<|`` inside a text becomes ``< |``, so no text can forge a turn.
    Rows with a null conversation id are one conversation. A conversation with only system turns, and an empty table,
    give no row. ``chunk`` is 0, or numbers, from 1, the pieces of ``CHUNK`` turns of a longer conversation; each
    piece has a mask of its own.
    """
    name = F.regexp_replace(F.col(f"`{role_col}`").cast("string"), r"[^\p{L}\p{N}_-]+", "_")
    turns = conversations.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.nullif(name, F.lit("")), F.lit(UNKNOWN)).alias("role"),
        F.replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    long_ones = turns.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select(F.col("conv_id").alias("long_id"))
    is_long = F.col("conv_id").eqNullSafe(F.col("long_id"))
    short = turns.join(long_ones, is_long, "left_anti").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    roles = F.array_distinct(F.transform(F.filter("turns", lambda t: t["role"] != SYSTEM), lambda t: t["role"]))
    short = short.select("conv_id", F.lit(0).cast("long").alias("chunk"), "turns", F.explode(roles).alias("perspective"))
    # long conversations: a range sort deals any number of turns evenly; each task numbers its own, then the turns of
    # a conversation in the tasks before are added, so that its cuts depend on nothing else
    order = ["conv_id", "turn", "role", "text"]
    dealt = turns.join(long_ones, is_long, "left_semi").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = stash(dealt.withColumn("task", F.expr("shiftright(place, 33)")))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = dealt.groupBy("conv_id", "task").agg(F.count("*").alias("n"), F.min("place").alias("begin")).select(F.col("conv_id").alias("long_id"), F.col("task").alias("of"), (ahead - F.col("begin")).alias("shift"))
    dealt = dealt.join(shift, is_long & (F.col("task") == F.col("of"))).withColumn("place", F.col("place") + F.col("shift"))
    pieces = dealt.groupBy("conv_id", F.expr(f"place div {CHUNK} + 1").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("place", "turn", "role", "text"))).alias("turns"))
    pieces = pieces.withColumn("turns", F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"))))
    speakers = turns.join(long_ones, is_long, "left_semi").where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("long_id"), F.col("role").alias("perspective")).distinct()
    pieces = pieces.join(speakers, is_long).select("conv_id", "chunk", "turns", "perspective")
    return _render(short.unionByName(pieces), ["conv_id", "chunk"])


def whole_conversations(rendered: DataFrame) -> DataFrame:
    """``rotate_perspectives`` with the pieces of long conversations put together: ``chunk`` is 0, masks are of the whole text."""
    parts = rendered.where("chunk > 0").groupBy("conv_id", "perspective").agg(F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("chunk", "rendered", "mask"))).alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask"))

    def step(acc: Column, p: Column) -> Column:
        moved = F.transform(p["mask"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end")))
        return F.struct((acc["at"] + F.length(p["rendered"])).alias("at"), F.concat(acc["mask"], moved).alias("mask"))

    long_ones = parts.select("conv_id", F.lit(0).cast("long").alias("chunk"), "perspective", "n_turns", F.concat_ws("", F.transform("parts", lambda p: p["rendered"])).alias("rendered"), F.aggregate("parts", start, step, lambda acc: acc["mask"]).alias("mask"))
    return rendered.where("chunk = 0").unionByName(long_ones)
