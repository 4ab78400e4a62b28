"""Stored tables: prepared data sets, features and experiment results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.features import clean_prefixes

REQUIRED_FEATURES = {"navigation_entropy_score_v2", "local_branching_entropy"}


def write_table(df: DataFrame, folder: str, name: str, file_format: str = "parquet", partition_by: Iterable[str] = ()) -> str:
    """Replace one table of a folder. ``file_format``: parquet or csv."""
    path = f"{folder.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite").format(file_format)
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    keys = list(partition_by)
    if keys:
        writer = writer.partitionBy(*keys)
    writer.save(path)
    return path


def read_table(spark: SparkSession, folder: str, name: str, file_format: str = "parquet") -> DataFrame:
    reader = spark.read.format(file_format)
    if file_format == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(f"{folder.rstrip('/')}/{name}")


def table_exists(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether a finished table is in the folder, on any file system Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def prefix_table_name(prefixes: Iterable[int]) -> str:
    """Features are stored per prefix list, so another list never reads a stale table."""
    return "prefix_features_" + "_".join(map(str, clean_prefixes(prefixes)))


def load_or_build(spark: SparkSession, folder: str, name: str, build) -> DataFrame:
    """The stored feature table when it holds the current features, else built and stored."""
    if table_exists(spark, folder, name):
        stored = read_table(spark, folder, name)
        if REQUIRED_FEATURES <= set(stored.columns):
            return stored
    write_table(build(), folder, name)
    return read_table(spark, folder, name)


def write_results(results: dict[str, DataFrame], folder: str) -> None:
    """One table per kind of result, partitioned by protocol where there is one."""
    for name, df in results.items():
        keys = ["protocol"] if "protocol" in df.columns else []
        write_table(df, folder, name, partition_by=keys)
