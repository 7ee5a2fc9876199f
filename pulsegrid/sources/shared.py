"""The folder that all executors share, and cutting lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the master is local (tests), a folder of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_path, "own", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared_path.own = found = f"file://{tempfile.mkdtemp(prefix='pulsegrid-')}"
    return found


def cut(df: DataFrame) -> DataFrame:
    """df written out by checkpoint(), in spark.checkpoint.dir; only where that is unset (tests) in a local folder.

    On a cluster a folder of one machine is of no use to the others, so there the setting must be there. checkpoint()
    keeps the estimated size of its plan. Joins multiply those, so that a loop of rounds would soon have the driver
    multiply numbers of millions of digits; made again from its rows, the table has no estimate."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_path(spark))
    rows = df.checkpoint()._jdf
    out = DataFrame(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)
    file = rows.queryExecution().logical().rdd().getCheckpointFile()
    out._cut_at = file.get() if file.isDefined() else None
    return out


def forget(df: DataFrame) -> None:
    """Deletes what ``cut`` wrote for df, which must not be read again."""
    spark, path = df.sparkSession, getattr(df, "_cut_at", None)
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
