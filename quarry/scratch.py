"""Tables that only live as long as the session, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that is unset, in local mode, below a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="quarry-scratch-")
            atexit.register(shutil.rmtree, _OWN["dir"], True)
        base = f"file://{_OWN['dir']}"
    return f"{base.rstrip('/')}/quarry-scratch-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the command that wrote them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written there and read back: its lineage is cut, and its shuffle files are deleted."""
    spark, at = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    return out


def unstaged(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
