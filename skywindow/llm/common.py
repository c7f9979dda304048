"""What the operators of this subpackage share: shared-folder tables, row tags, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import scratch

TAG = "__tag"
#: Text bytes that a task turns into numpy arrays at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def stash(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and reread it: cuts lineage, survives lost executors."""
    spark = spark or df.sparkSession
    path = scratch(spark, "stash")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(*tables: DataFrame) -> None:
    """Deletes tables of ``stash`` that nothing reads any more: whatever was made of them must be stored itself."""
    for table in tables:
        jvm, files = table.sparkSession._jvm, table.inputFiles()
        folders = {f.rsplit("/", 1)[0] for f in files}
        for folder in folders:
            if folder.rsplit("/", 1)[1].startswith("stash-"):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Plans of which a second reading gives the same rows in the same places: stored tables, filtered and projected.
PLAIN = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation", "DataSourceV2ScanRelation"}


def settled(docs: DataFrame) -> DataFrame:
    """``docs``, stored first unless it merely reads stored tables.

    Row tags are places in partitions. Behind a shuffle, rows may be dealt otherwise when other columns are asked for, so that
    an operator which reads its input twice would take one row's tag for another's.
    """
    todo = [docs._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in PLAIN:
            return stash(docs)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return docs


def tagged(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The used columns under fixed names plus a row tag, so that null or repeated ids and clashing extra columns do no harm.

    The tag is the row's place in its partition; a lost task finds the same place again because its input is a
    stored table.
    """
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in more]
    ).withColumn(TAG, F.monotonically_increasing_id())


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more entry at the end); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(offs):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy runs of rows with about ``limit`` bytes of text each, which bounds the memory of what is derived."""
    size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    group = (np.cumsum(size) - size) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *edges], [*edges, len(size)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def sliced(batches: Iterable[pa.RecordBatch], column: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, column, limit)


def binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array whose item k is ``values[starts[k]:starts[k + 1]]`` as bytes."""
    offs = (starts * values.dtype.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())
