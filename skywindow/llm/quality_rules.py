"""Quality rules with adaptive thresholds.

Counts of every text (words, symbols, repeated lines and word windows) become three shares per 10,000. The distribution
of each share among the texts of a language and source that pass the base rules is kept as a mergeable quantile sketch:
counts in equal buckets of ``SKETCH_STEP``, so that any quantile is known to that step and sketches add up exactly, in any
order, across tasks, sources and languages. A share is too high above the greater of two points of its sketch: the outer
quartile fence ``q75 + 3 x max(q75 - q25, SKETCH_STEP)``, and the quantile that leaves ``MOST`` of the texts above it, so
that a rule that many sound texts break doesn't reject them. A source's threshold is drawn towards that of its language,
and a language's towards that of all texts, as if ``PRIOR`` more texts had it: the fewer texts, the more.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stash, tagged
from .textvec import SPACE, Words, numbered

SKETCH_STEP = 20
#: Of the texts of a language and source, the share (per cent) that each rule rejects at most, but for what ties and ``PRIOR`` shift.
MOST = {"symbol_share": 10, "line_share": 2, "repeat_share": 2}
#: Texts that the threshold of the next wider group counts for.
PRIOR = 50
SHARES = ("symbol_share", "line_share", "repeat_share")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _by_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text; null counts as empty."""
    w = Words(texts, plain=False)
    data, offs, n = w.data, w.offs, w.count
    out = {"n_words": n, "word_chars": _by_text(~SPACE[data] & ((data & 0xC0) != 0x80), offs), "n_symbols": _by_text(SYMBOLS[data], offs)}
    # lines: runs between line feeds, split also where texts meet; only lines with a word count
    docs = np.arange(len(n))
    ends = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], ends + 1])) if len(data) else np.zeros(0, np.int64)
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data))
    worded = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
    begin, stop = begin[worded], stop[worded]
    stop = stop - (data[stop - 1] == 0x0A)
    doc = np.searchsorted(offs, begin, "right") - 1
    if len(begin):
        line = numbered(data, begin, stop)
        order = np.lexsort((line, doc))
        same = (doc[order][1:] == doc[order][:-1]) & (line[order][1:] == line[order][:-1])
        out["n_dup_lines"] = np.bincount(doc[order][1:][same], minlength=len(n))
    else:
        out["n_dup_lines"] = np.zeros(len(n), np.int64)
    out["n_lines"] = np.bincount(doc, minlength=len(n))
    # words in three-word windows that the text has twice or more
    total = len(w.start)
    cover = np.zeros(total + 3, np.int64)
    if total >= 3:
        of = np.repeat(docs, n)
        at = np.flatnonzero(of[2:] == of[:-2])
        word = numbered(data, w.start, w.end)
        kinds = int(word.max()) + 1
        pair = word[:-1] * kinds + word[1:]
        if kinds >= 1 << 20:  # so that the product below has room
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[at] * kinds + word[at + 2]
        order = np.lexsort((key, of[at]))
        k, d = key[order], of[at][order]
        same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for j in range(3):
            cover[hit + j] = 1
    out["n_repeat_words"] = _by_text(cover[:total], w.first)
    return out


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        c = text_counts(b.column("text"))
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("doc_id", "lang", "source")), *(pa.array(c[k].astype(np.int64)) for k in COUNTS)], ["doc_id", "lang", "source", *COUNTS])


def _share(part: str, whole: str):
    return F.when(F.col(whole) > 0, F.expr(f"({part} * 10000) div {whole}")).otherwise(F.lit(0)).cast("long")


def _drawn(own: str, n: str, wider: str):
    return F.expr(f"coalesce(({n} * {own} + {PRIOR} * {wider}) div ({n} + {PRIOR}), {wider})")


def thresholds(stats: DataFrame) -> DataFrame:
    """From the shares of sound texts: ``lk, sk`` (language and source as keys) and one upper threshold for each share."""
    bars = (
        stats.select("lk", "sk", F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.expr(f"{s} div {SKETCH_STEP}").alias("bucket")) for s in SHARES])).alias("x"))
        .groupBy("lk", "sk", "x.share", "x.bucket")
        .agg(F.count("*").alias("n"))
    )
    # sketches add up: of a source, of a language, of all
    merged = bars.groupingSets([["lk", "sk", "share", "bucket"], ["lk", "share", "bucket"], ["share", "bucket"]], "lk", "sk", "share", "bucket").agg(
        F.sum("n").alias("n"), F.grouping_id().alias("level")
    )
    own = Window.partitionBy("level", "lk", "sk", "share")
    run = merged.withColumn("total", F.sum("n").over(own)).withColumn("below", F.sum("n").over(own.orderBy("bucket")))
    stay = 100 - F.element_at(F.create_map(*[F.lit(x) for kv in MOST.items() for x in kv]), F.col("share"))
    points = {"q1": F.lit(25), "q3": F.lit(75), "tail": stay}
    points = run.groupBy("level", "lk", "sk", "share").agg(
        F.max("total").alias("total"), *[F.min(F.when(F.col("below") * 100 >= F.col("total") * k, F.col("bucket"))).alias(q) for q, k in points.items()]
    )
    fence = F.col("q3") + 3 * F.greatest(F.col("q3") - F.col("q1"), F.lit(1))
    tops = points.select("level", "lk", "sk", "share", "total", F.greatest(fence * SKETCH_STEP, (F.col("tail") + 1) * SKETCH_STEP - 1).alias("t"))
    wide = tops.groupBy("level", "lk", "sk").agg(F.max("total").alias("n"), *[F.max(F.when(F.col("share") == s, F.col("t"))).alias(s) for s in SHARES])
    of_all = wide.where("level = 12").select(*[F.col(s).alias(f"all_{s}") for s in SHARES])
    by_lang = wide.where("level = 4").join(F.broadcast(of_all)).select("lk", *[_drawn(s, "n", f"all_{s}").alias(f"lang_{s}") for s in SHARES])  # one row
    return wide.where("level = 0").join(by_lang, "lk").select("lk", "sk", *[_drawn(s, "n", f"lang_{s}").alias(f"max_{s}") for s in SHARES])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, the counts, the shares per 10,000, ``base_failed`` and ``kept``.

    Words are ``[^\\x20\\x09-\\x0D]+``. Null texts count as empty (no words, so ``base_failed``); null languages and
    sources are groups of their own. Repeated rows count each time. An empty table gives an empty result; other columns
    are not looked at.
    """
    rows = tagged(docs, id_col, text_col, lang_col, source_col).select("doc_id", "text", F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(_count, f"doc_id {id_type}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    key = lambda c: F.concat(F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.lit("v")), F.coalesce(c, F.lit("")))
    stats = (
        counted.withColumns({"lk": key("lang"), "sk": key("source"), "symbol_share": _share("n_symbols", "word_chars"), "line_share": _share("n_dup_lines", "n_lines"), "repeat_share": _share("n_repeat_words", "n_words")})
    )
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stash(stats.withColumn("base_failed", base))
    # the thresholds are a row for each language and source; Spark broadcasts them only where their measured size allows it
    joined = stats.join(thresholds(stats.where("not base_failed")), ["lk", "sk"], "left")
    fine = (F.col("symbol_share") <= F.col("max_symbol_share")) & (F.col("line_share") <= F.col("max_line_share")) & (F.col("repeat_share") <= F.col("max_repeat_share"))
    return joined.select("doc_id", *COUNTS[:5], *SHARES, "base_failed", (~F.col("base_failed") & F.coalesce(fine, F.lit(False))).alias("kept"))
