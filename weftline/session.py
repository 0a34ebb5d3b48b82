"""Sessions with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "weftline", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``master`` and further settings only where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a table that is read in fewer parts than there are cores, dealt over all of them.

    A small file of one row group would keep one core at work. Tables of more parts, any large one, stay as read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir`` and all executors share.

    Only where none is set, and the driver runs the tasks itself, a temporary folder takes its place.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="weftline-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str = "table") -> str:
    """The path of a table that is needed until the application ends, in the shared folder; it is deleted then."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame) -> tuple[str, DataFrame]:
    """The path of ``df`` as a table in the shared folder, and the table."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that no later plan reads, before the application ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table written in the shared folder and read again: nothing before it is computed or planned once more.

    Unlike a checkpoint of rows it is columnar and compressed, a reader takes the columns that it needs, and no
    constraints of the former plan are carried on, which loops would multiply.
    """
    return written(df)[1]
