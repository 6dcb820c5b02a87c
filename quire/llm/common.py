"""What the corpus operators share: reading tables and cutting lineage."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only on a single machine, where it may be unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever file system its path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, read back from the shared checkpoint folder.

    Spark removes the files with the frame where the cluster sets
    spark.cleaner.referenceTracking.cleanCheckpoints; else they stay in that folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, which the optimizer can't inline into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name of theirs can clash; ``row.*`` brings them back."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def literal_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small fixed table as one literal, which no Python worker has to read."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), F.lit(f"array<struct<{ddl}>>"))))
