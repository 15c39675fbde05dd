"""Tables written to the folder that all executors share, so that what was shuffled for them can go."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def with_checkpoints(spark: SparkSession) -> None:
    """Keeps the checkpoint folder the cluster names; only where none is set (as in tests) takes a new local one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "tessera-checkpoints"))


#: With this setting a plan's shuffle files are removed when it has run.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns it read from there; what was shuffled for it goes at once."""
    spark = df.sparkSession
    with_checkpoints(spark)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        own = df.select("*")  # takes the setting as its plan is made, and is run this once
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return own.checkpoint(eager=True)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a ``saved`` table that nothing reads any more."""
    rdd = df._jdf.queryExecution().analyzed().rdd()
    if rdd.getCheckpointFile().isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
