"""CSV files whose quoted fields may hold line feeds, read in splits of the files.

Whether a line feed ends a record depends on the number of quotes before it, which is even outside
quoted fields. One narrow pass counts quotes per byte range of a file; a running sum over these few
rows gives every range its state at the start. Where no line has an odd number of quotes, lines
are records and Spark's own splittable reader takes over. Else only ranges with such lines are put in
order, and only the lines of records that run over several are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import materialized

_RANGE = ["_file", "_block"]
_OPTIONS = {"escape": '"', "mode": "FAILFAST"}


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files with one header, all columns as text.

    A quote inside a quoted field is doubled. Blank lines between records are skipped. A malformed
    record, or a file that ends within quotes, fails the job. Compressed files are one range each.
    """
    lines = _lines(spark, path)
    odd = F.col("_quotes") % 2 == 1
    ranges = materialized(lines.groupBy(*_RANGE).agg(
        (F.sum("_quotes") % 2).alias("_parity"), F.max(odd).alias("_has_odd")))
    if ranges.where("_has_odd").isEmpty():
        return spark.read.csv(path, header=True, **_OPTIONS)
    names = spark.read.csv(path, header=True, multiLine=True, **_OPTIONS).columns
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
    record = F.from_csv(F.regexp_replace("record", r"\r$", ""), schema, _OPTIONS)
    return _records(lines, ranges).select(record.alias("r")).select("r.*")


def _quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the start of their byte range, and a number that rises within it."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), _quotes(F.col("value")).alias("_quotes"))


def _records(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Column ``record``: the text of every record but the headers and blank lines."""
    along = Window.partitionBy("_file").orderBy("_block")
    before = F.coalesce(F.sum("_parity").over(along.rowsBetween(Window.unboundedPreceding, -1)) % 2, F.lit(0))
    ends_quoted = F.raise_error(F.concat(F.lit("file ends within quotes: "), F.col("_file"))).cast("bigint")
    whole = F.sum("_parity").over(Window.partitionBy("_file")) % 2
    states = ranges.select(*_RANGE, F.when(whole == 1, ends_quoted).otherwise(before).alias("_open"), (
        # the range of the header is put in order as well
        F.col("_has_odd") | (before == 1) | (F.col("_block") == 0)).alias("_ordered"))
    known = lines.join(states, _RANGE)
    single = known.where(~F.col("_ordered")).select("value")

    order = Window.partitionBy(*_RANGE).orderBy("_line")
    quotes_before = F.coalesce(F.sum("_quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ((F.col("_open") + quotes_before) % 2 == 0).cast("int")
    numbered = known.where("_ordered").select(
        *_RANGE, "_line", "value", "_quotes", starts.alias("_starts"), F.row_number().over(order).alias("_place"))
    numbered = materialized(numbered.withColumn("_record", F.sum("_starts").over(order)).where(
        # the header is the first record of the file
        ~((F.col("_block") == 0) & (F.col("_record") <= 1))))
    alone = (F.col("_starts") == 1) & (F.col("_quotes") % 2 == 0)

    # lines before the first start of a range go on with the last record that started in an earlier one
    last = numbered.groupBy(*_RANGE).agg(F.max("_record").alias("_last"))
    started = F.when(F.col("_last") > 0, F.struct("_block", F.col("_last").alias("_record")))
    owners = last.select(*_RANGE, F.last(started, ignorenulls=True).over(
        along.rowsBetween(Window.unboundedPreceding, -1)).alias("_owner"))
    own = F.struct("_block", "_record")
    # a header that runs on into a later range has no owner
    parts = numbered.where(~alone).join(owners, _RANGE).withColumn(
        "_key", F.when(F.col("_record") > 0, own).otherwise(F.col("_owner"))).where(F.col("_key").isNotNull())
    joined = parts.groupBy("_file", "_key").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_line", "value"))).alias("_parts"))
    multiple = joined.select(F.array_join(F.col("_parts.value"), "\n").alias("record"))
    plain = single.unionByName(numbered.where(alone).select("value")).where(F.trim(F.regexp_replace("value", r"\r$", "")) != "")
    return plain.select(F.col("value").alias("record")).unionByName(multiple)
