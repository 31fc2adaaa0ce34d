"""Session helpers: table reading, shared checkpoints and partition counts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> str:
    """The application's folder under ``spark.checkpoint.dir``.

    A local session without the setting (tests) gets a folder of its own; on a
    cluster that would lose data, so there it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"gritstone-{os.getuid()}"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder of ``spark.checkpoint.dir``.

    The rows are written to reliable storage, so a later stage survives the loss
    of any executor.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, but as a table in the shared folder.

    For loops: what the optimizer knows of a checkpoint's rows grows with every
    round that is built on the one before, while a table starts anew.
    """
    path = f"{_checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a checkpointed or written frame that no later frame reads, as of a finished round."""
    plan = df._jdf.queryExecution().logical()
    kind = plan.getClass().getSimpleName()
    paths = []
    if kind == "LogicalRDD" and plan.rdd().getCheckpointFile().isDefined():
        paths = [plan.rdd().getCheckpointFile().get()]
    elif kind == "LogicalRelation" or kind == "UnresolvedDataSource":
        paths = sorted({f.rpartition("/")[0] for f in df.inputFiles() if f.rpartition("/")[0].rpartition("/")[2].startswith("table-")})
    for path in paths:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Repartition to the session's shuffle width before Python work.

    A small file gives few scan splits; without this a few tasks would do all the
    Python work. A table of many files is read by many tasks anyway, and its rows
    are not moved. With columns given, equal values go to one partition.
    """
    n = shuffle_partitions(df.sparkSession)
    if not columns and 2 * len(df.inputFiles()) >= n:
        return df
    return df.repartition(n, *[F.col(c) for c in columns]) if columns else df.repartition(n)
