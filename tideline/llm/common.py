"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the ASCII controls TAB to CR.
SPACES = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a folder of its own; a cluster is refused,
    because its machines would each see a different temporary folder.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("tideline.shared.dir", None)
    if found:
        return found
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="spark-tideline-")
    spark.conf.set("tideline.shared.dir", found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage and keeps the rows where a lost executor does not take them along.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    rows.staged_path = path
    return rows


def unstage(df: DataFrame) -> None:
    """Remove what :func:`staged` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times in ``body``.

    Catalyst may inline a projected column into each place that uses it; a lambda's variable is
    evaluated once a row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
