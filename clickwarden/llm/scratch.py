"""Intermediate tables in the shared checkpoint folder, removed as soon as they are not needed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clickwarden.session import ensure_checkpoint_dir


class Scratch:
    """Tables of one operator call: ``keep`` writes and rereads one, ``free`` deletes it.

    A written table cuts the lineage: a lost executor rereads files that every machine sees.
    """

    def __init__(self, spark: SparkSession, label: str):
        self._spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        self._paths: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.folder}/{self._count}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self._spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        self._paths.add(path)
        return kept

    def free(self, *tables: DataFrame) -> None:
        for table in tables:
            self.delete(table.scratch_path)

    def free_others(self, *needed: DataFrame) -> None:
        """Delete all tables but those that the result still reads."""
        for path in self._paths - {table.scratch_path for table in needed}:
            self.delete(path)

    def delete(self, name: str) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
        self._paths.discard(name)


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """Column names made of ``names`` that the table has none of, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
