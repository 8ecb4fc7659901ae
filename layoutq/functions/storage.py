"""Cutting a long lineage where executors can find it again."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it names none, a session in one process (tests) gets a
    temporary one; on a cluster that is an error, as executors elsewhere couldn't read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """df, checkpointed to the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def bucketed(df: DataFrame, name: str, key: str, distinct: tuple[str, ...] = ()) -> DataFrame:
    """df, written once as a table in the shared folder, in buckets of a key: joins and groups by it need no exchange. With ``distinct``
    rows that agree in these columns, the key among them, are one, by the same exchange."""
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    x = df.repartition(n, key)
    x = x.dropDuplicates(list(distinct)) if distinct else x
    x.write.bucketBy(n, key).sortBy(key).option("path", f"{checkpoint_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)
