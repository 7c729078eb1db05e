"""Sessions, and the package on executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch where the session does not say: rows here are whole texts, and a batch is held on both sides of the pipe.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def session(name: str = "vaultspark", **conf: str) -> SparkSession:
    """A session with the settings that results depend on; others keep Spark's defaults."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("_", "."), v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once for each context, and bound Arrow batches."""
    context = spark.sparkContext
    for key, value in BATCH.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    if not getattr(context, "_vaultspark_shipped", False):
        root = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp()).resolve()  # executors fetch the file from here as they start
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(folder / "vaultspark_package.zip", "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(str(folder / "vaultspark_package.zip"))
        context._vaultspark_shipped = True
    return spark


def scratch(spark: SparkSession) -> str:
    """A new name for a folder below spark.checkpoint.dir, which driver and executors share; where that is unset, as in tests, below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = getattr(scratch, "own", None)
        if not base:
            base = scratch.own = tempfile.mkdtemp(prefix="vaultspark-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once below scratch() and read back: for tables that a plan uses more than once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is stored() the first time a session asks for it by this name."""
    tables = spark.sparkContext.__dict__.setdefault("_vaultspark_tables", {})
    if name not in tables:
        tables[name] = stored(make())
    return tables[name]


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Marked for broadcast if it has at most so many rows; for narrow tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """Dealt to all cores if its files make fewer tasks than there are: for work that is heavy beside its input."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
