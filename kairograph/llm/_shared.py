"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = re.compile(rb"[\x09-\x0d\x20]")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``,
    or a folder beside the warehouse where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    It cuts the lineage, survives the loss of any executor, and fixes values
    that a recomputation could change (such as generated row numbers).
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` has written and that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
        if path is not None:
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Words of a whole text (maximal runs without ``\\x20 \\x09-\\x0D``), A-Z
    lower-cased, as lists from blocks of about ``size`` bytes, so that a very
    long text never becomes one list of words."""
    start, n = 0, len(data)
    while start < n:
        end = start + size
        if end >= n:
            end = n
        else:
            found = _SPACE.search(data, end)
            end = found.start() if found else n
        words = data[start:end].lower().split()
        if words:
            yield words
        start = end


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
