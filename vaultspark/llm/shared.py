"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new name below spark.checkpoint.dir; where that is unset, on one machine as in tests, below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = getattr(folder, "own", None)
        if not base:
            base = folder.own = tempfile.mkdtemp(prefix="vaultspark-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/vaultspark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, written once as Parquet and read back: what follows does not depend on executors that made them."""
    spark, schema = df.sparkSession, df.schema
    path = folder(spark)
    df.write.parquet(path)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # what no plan refers to any more: Spark removes its shuffle files and broadcasts
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a table from written() that nothing will read again."""
    spark = df.sparkSession
    for f in df.inputFiles():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        break
