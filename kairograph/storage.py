"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, or beside the warehouse where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its own."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, own = file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(own)) if fs.exists(own) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, own = file_system(spark, path)
    fs.delete(own, True)
