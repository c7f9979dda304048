"""A Merkle manifest of a dataset, with nested-interval labels instead of pointers.

Each language is a tree over its rows in the order of their ids. A node carries the interval ``[lo, hi)`` of the leaf ranks
that it covers; a node of level k covers up to 8^k leaves, from a multiple of 8^k on. An ancestor is a node whose interval
contains the other's. As intervals nest, both have the same number ``lo div 8^level`` at the ancestor's level, so that the
containment join is bucketed by level and that number. What is left of a parent's interval without the node's own, on its left and on its right,
names the siblings. The roots of the languages are the leaves of one more tree of the same kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import TAG, stash, unstash

FANOUT = 8
#: Rows whose id has a checksum that this divides are tampered with in ``tampered``.
TAMPER_EVERY = 3
_PATH = "array<struct<left:string,right:string>>"


def digest(parts: Column) -> Column:
    """Lowercase hex SHA-256; digests go in as hex text."""
    return F.sha2(parts.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Of a row: each value as ``-`` if null, else its length in UTF-8 bytes, ``:`` and itself."""
    text = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in lower case where the checksum of the id is a multiple of ``TAMPER_EVERY``; else as it is."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_EVERY == 0
    return F.when(hit, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(text)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (a stored table) with ``lo``, the row's rank in its tree, and ``n``, the tree's number of rows; and the table below.

    Rows are dealt by ranges, so that a large tree is in many tasks; ranks are counts of the ranges before plus the place
    within the range.
    """
    part = "__part"
    dealt = stash(rows.repartitionByRange(tree, *order).withColumn(part, F.spark_partition_id()))
    counts = dealt.groupBy(tree, part).agg(F.count("*").alias("here"))
    parts = Window.partitionBy(tree).orderBy(part)  # a row for each range that the tree touches
    before = F.sum("here").over(parts.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("here")
    counts = counts.select(tree, part, before.alias("before"), F.sum("here").over(Window.partitionBy(tree)).alias("n"))
    place = F.row_number().over(Window.partitionBy(tree, part).orderBy(*order))
    out = dealt.withColumn("place", place).join(counts, [tree, part])
    return out.withColumn("lo", F.col("before") + F.col("place") - 1).drop(part, "place", "before"), dealt


def _bucket(level: int) -> Column:
    return F.floor(F.col("lo") / F.lit(FANOUT**level)).cast("long")


def _levels(most: int) -> int:
    k = 0
    while FANOUT**k < most:
        k += 1
    return k


def _height() -> Column:
    """The level of the root of a tree with ``n`` leaves."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT**k) for k in range(21)]), lambda most: F.col("n") > most))


def build(leaves: DataFrame) -> list[DataFrame]:
    """All inner nodes by level, from stored ``tree, lo, n, digest, item`` rows: ``tree, lo, hi, n, height, digest, kids``.

    The kids of a node, eight at most, are in its row, each with its interval and digest (leaves with their ``item``).
    The first table has the leaves themselves, without kids.
    """
    nodes = leaves.select("tree", "lo", (F.col("lo") + 1).alias("hi"), "n", _height().alias("height"), "digest", "item")
    tables = [nodes]
    most = leaves.agg(F.max("n")).first()[0] or 0
    for level in range(1, _levels(most) + 1):
        below = tables[-1].where(F.col("height") >= level)
        kid = F.struct("lo", "hi", "digest", *(["item"] if level == 1 else []))
        up = below.groupBy("tree", _bucket(level).alias("b"), "n", "height").agg(F.sort_array(F.collect_list(kid)).alias("kids"))
        whole = F.array_join(F.transform("kids", lambda x: x["digest"]), "")
        tables.append(stash(up.select("tree", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "n", "height", digest(whole).alias("digest"), "kids")))
    return tables


def roots(tables: list[DataFrame]) -> DataFrame:
    """The root of each tree: ``tree, digest``."""
    out = None
    for level, table in enumerate(tables):
        top = table.where(F.col("height") == level).select("tree", "digest")
        out = top if out is None else out.unionByName(top)
    return out


def _beside(kids: Column, lo: Column, hi: Column) -> Column:
    """The parent's interval without the node's own: the digests on its left and on its right."""
    side = lambda keep: F.array_join(F.transform(F.filter(kids, keep), lambda x: x["digest"]), "")
    return F.struct(side(lambda x: x["hi"] <= lo).alias("left"), side(lambda x: x["lo"] >= hi).alias("right"))


def paths(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Every leaf with its siblings from the bottom to the root: ``tree, digest, item, path, ends``.

    ``tops`` (``tree, path, ends``) is what follows above the root of each tree, and what else each leaf of it gets. Ancestors are attached from the top down: a level's
    nodes join the level above by bucket and containment.
    """
    above = None
    for level in range(len(tables) - 1, 0, -1):
        table = tables[level]
        here = table.where(F.col("height") == level).join(tops, "tree").select(*table.columns, "path", "ends")
        if above is not None:
            up = above.select("ends", F.col("tree").alias("t"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("kids").alias("beside"), F.col("path").alias("onward"), _bucket(level + 1).alias("b"))
            inside = (F.col("tree") == F.col("t")) & (_bucket(level + 1) == F.col("b")) & (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
            path = F.concat(F.array(_beside(F.col("beside"), F.col("lo"), F.col("hi"))), "onward")
            under = table.where(F.col("height") > level).join(up, inside).select(*table.columns, path.alias("path"), "ends")
            here = here.unionByName(under)
        above = here if level == 1 else stash(here)
    alone = tables[0].where(F.col("height") == 0).join(tops, "tree").select("tree", "digest", "item", "path", "ends")
    if above is None:
        return alone
    kid = above.select("tree", "kids", F.explode("kids").alias("kid"), "path", "ends")
    path = F.concat(F.array(_beside(F.col("kids"), F.col("kid.lo"), F.col("kid.hi"))), "path")
    return kid.select("tree", F.col("kid.digest").alias("digest"), F.col("kid.item").alias("item"), path.alias("path"), "ends").unionByName(alone)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, from the bottom to the root, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), check: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, leaf, subroot, root, path, folded_root, verified``.

    ``columns`` go into a leaf, in that order. ``check`` is the text as it was found later (see ``tampered``): its leaf, folded
    with the siblings of the original, gives ``folded_root``; by default it is the text itself, and everything verifies.
    The text is the last of ``columns``.

    Rows of one language ascend by id, null first; repeated ids by leaf, so that equal rows are alike. Null languages are a
    tree of their own, first among the trees; an empty string is another. A lone leaf is its language's root, a lone
    language's root is the root; then there are no siblings and the proof is the digest of nothing. Other columns are
    ignored. An empty table gives an empty result.
    """
    values = [F.col(f"`{c}`") for c in columns]
    tree = F.concat(F.when(F.col(f"`{lang_col}`").isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")))
    leaf = leaf_digest(*values)
    found = leaf if check is None else leaf_digest(*values[:-1], check)
    rows = stash(docs.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf.alias("digest"), found.alias("found"), F.monotonically_increasing_id().alias(TAG)))
    placed, dealt = ranked(rows, "tree", ["id", "digest", TAG])
    leaves = stash(placed.select("tree", "lo", "n", "digest", F.struct("id", "found").alias("item")))
    unstash(rows, dealt)
    tables = build(leaves)
    # the languages' roots are leaves of one more tree; a row a language
    sub, every = stash(roots(tables)), Window.partitionBy(F.lit(0))
    top = build(stash(sub.select(F.lit("root").alias("tree"), (F.row_number().over(every.orderBy("tree")) - 1).cast("long").alias("lo"), F.count("*").over(every).alias("n"), "digest", F.col("tree").alias("item"))))
    start = top[-1].select("tree", F.col("digest").alias("ends"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    tops = stash(paths(top, start).select(F.col("item").alias("tree"), F.struct(F.col("digest").alias("subroot"), F.col("ends").alias("root")).alias("ends"), "path"))
    out = paths(tables, tops).select(F.col("item.id").alias("doc_id"), F.col("digest").alias("leaf"), "ends.subroot", "ends.root", "path", fold(F.col("item.found"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
