"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder takes its place on a local master (tests); on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="skywindow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str = "scratch") -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and rereads it, so that branches share one computation and lost executors cost
    nothing but a reread."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "staged")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of ``shared``: the application, the plan, the state of the files that it reads, and the stored table.
_SHARED: list[tuple[str, DataFrame, list, DataFrame]] = []
#: How many of them are known at a time.
KNOWN = 32


def _files(df: DataFrame) -> list[tuple[str, int, int]]:
    """Path, length and time of each file that a plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    out = []
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((f, status.getLen(), status.getModificationTime()))
    return out


def shared(df: DataFrame) -> DataFrame:
    """``staged``, once in an application for each plan over the same files: the part that many queries begin with.

    Files that have changed make another table. For plans over a number of files that the driver can look at one by one.
    """
    app, files = df.sparkSession.sparkContext.applicationId, _files(df)
    for known_app, plan, then, table in _SHARED:
        if known_app == app and then == files and plan.sameSemantics(df):
            return table
    table = staged(df)
    _SHARED.append((app, df, files, table))
    del _SHARED[:-KNOWN]
    return table
