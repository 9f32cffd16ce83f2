"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumidex.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder, by whatever file system its path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/lumidex-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    This cuts lineage: what follows reads files that outlive any executor. The
    files stay until the shared folder is cleaned, as the result may be read lazily.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def forget(*tables: DataFrame) -> None:
    """Deletes the files of saved() tables, once all that was made from them is written too."""
    for df in tables:
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            folder, files = _folder(df.sparkSession, path)
            if folder.getName().startswith("lumidex-"):
                files.delete(folder, True)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that operators left in the shared folder; how many. For when no lazy result of theirs is needed any more."""
    folder, files = _folder(spark, shared_dir(spark))
    gone = [x.getPath() for x in files.listStatus(folder) if x.getPath().getName().startswith("lumidex-")] if files.exists(folder) else []
    for path in gone:
        files.delete(path, True)
    return len(gone)
