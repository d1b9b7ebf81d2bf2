"""Hand-over tables between stages.

A long chain of self-joins makes a plan that grows with every step and is recomputed for every use.
Stages therefore hand over Parquet tables, written to the shared folder the cluster names in
`spark.checkpoint.dir`: they survive lost executors, and readers still get column pruning and sizes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
# Columns of ids, positions and counts take 1 to 3 bytes a row in Parquet or a shuffle file and 60 to 120 in a join's hash table or an
# aggregate, so planned by file size a broadcast outgrows the driver, and a shuffle partition its task.
SIZES = {"spark.sql.sources.fileCompressionFactor": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"}
_LOCAL: dict[str, str] = {}


def _configured(spark: SparkSession) -> str | None:
    return spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None) or spark.sparkContext.getCheckpointDir()


def _own_folder(app: str) -> str:
    """A temporary folder for one application on this machine, removed when the driver ends."""
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="basketlens-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def scratch_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a folder of our own only where none is set and all tasks run on this machine.

    The caller's setting is never changed.
    """
    folder = _configured(spark)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def plan_by_memory(spark: SparkSession) -> None:
    """Let the planner judge tables by what they take in memory; a size that the caller has set stays."""
    for name, size in SIZES.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, size)


def stage(df: DataFrame, name: str | None = None, codec: str | None = None) -> DataFrame:
    """Write `df` as a table of this application, under a name of its own, and read it back. `codec` compresses a large one more than the session does."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name or 'step'}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def close(spark: SparkSession) -> None:
    """Delete every table that this application has staged."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
