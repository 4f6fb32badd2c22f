"""The folder that all executors share, and intermediate tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.errors import QuarryError


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or the checkpoint folder that the program set.

    Without either, a session on one machine (tests) gets a temporary folder; on a cluster that is an error, since each executor
    would write its part to its own disk.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise QuarryError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder."""
    return f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, and the files outlive any executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``materialize`` made and nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.split(":", 1)[-1].lstrip("/").startswith(application_dir(df.sparkSession).split(":", 1)[-1].lstrip("/")):
            _remove(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, when its results are written."""
    _remove(spark, application_dir(spark))
