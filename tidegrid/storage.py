"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set: a local one if driver and executors are one process, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tidegrid-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when Python ends."""
    if not _made:
        atexit.register(delete)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def delete(*paths: str) -> None:
    """Deletes folders that new_path() named: these, or all."""
    for path in paths or list(_made):
        spark = _made.pop(path, None)
        if spark is not None:
            with contextlib.suppress(Exception):  # the session may have ended
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(uri: str):
    """pyarrow's file system of a URI, and the path in it: file, s3, gs and hdfs alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def written(df: DataFrame, name: str) -> DataFrame:
    """df, evaluated once, as a table of the shared folder: it survives lost executors and has no lineage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(table: DataFrame) -> None:
    """Deletes a table of written(), which nothing reads any more."""
    delete(table._stored_at)
