"""Durable cuts of lineage for plans that loop: tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it isn't set, a folder in the warehouse, or, if all of Spark runs in this process, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        alone = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
        found = "file://" + tempfile.mkdtemp(prefix="hearthledger-cuts-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/hearthledger-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df` from a written table: later plans neither repeat nor carry what made them, and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session's JVM may have gone already
            pass

    atexit.register(remove)
    again = spark.read.schema(df.schema).parquet(path)
    again.cut = path
    return again


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` gave and that no later plan reads."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.cut)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
