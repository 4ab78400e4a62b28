"""Readers for request logs: combined text, CSV and JSON lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..constants import COMBINED_LOG_PATTERN, REQUEST_COLUMN_ALIASES
from ..functions.paths import normalize_path, normalize_referrer, path_from_request_line
from ..functions.times import coerce_epoch_seconds, combined_log_epoch
from ..functions.values import int_or_null, stripped
from .csv_records import read_csv_records

Paths = str | Sequence[str]

REQUEST_SCHEMA = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("body_bytes_sent", T.LongType()),
    T.StructField("referrer", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("label", T.StringType()),
])


def read_requests(spark: SparkSession, paths: Paths, log_format: str = "auto", **options) -> DataFrame:
    """Normalised requests from log files. ``log_format``: auto, combined, csv or jsonl.

    With ``auto`` every path has its own format; what they have in common is put together. A
    malformed CSV or JSON record fails the job.
    """
    if log_format == "auto":
        by_format: dict[str, list[str]] = {}
        for path in [paths] if isinstance(paths, str) else paths:
            by_format.setdefault(infer_log_format(spark, path), []).append(path)
        if len(by_format) > 1:
            parts = [read_requests(spark, own, name, **options) for name, own in by_format.items()]
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        log_format = next(iter(by_format), "csv")
    if log_format == "combined":
        return parse_combined_log(read_lines(spark, paths), **options)
    if log_format == "csv":
        # one reader per file: each header names its own columns
        files = [paths] if isinstance(paths, str) else paths
        parts = [normalize_requests(read_csv_records(spark, path), **options) for path in files]
        return reduce(lambda a, b: a.unionByName(b), parts)
    if log_format == "jsonl":
        schema = options.pop("schema", None)
        reader = spark.read.schema(schema) if schema else spark.read
        return normalize_requests(reader.json(paths, mode="FAILFAST"), **options)
    raise ValueError(f"unsupported log format: {log_format}")


def read_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """Non-blank lines of the files as column ``value``."""
    return spark.read.text(paths).where(stripped(F.col("value")) != "")


def distinct_lines(spark: SparkSession, paths: Paths) -> DataFrame:
    """Lines of several logs, each distinct line once."""
    return dedupe_lines(spark.read.text(paths))


def dedupe_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("value") != "").dropDuplicates(["value"])


def infer_log_format(spark: SparkSession, paths: Paths) -> str:
    """By file extension, else by the first non-blank line."""
    first = paths if isinstance(paths, str) else paths[0]
    lowered = first.lower()
    if lowered.endswith(".csv"):
        return "csv"
    if lowered.endswith((".jsonl", ".ndjson")):
        return "jsonl"
    line = read_lines(spark, first).select(line_format(F.col("value")).alias("format")).head()
    return line["format"] if line else "csv"


def line_format(line: Column) -> Column:
    """Log format a single line looks like."""
    text = stripped(line)
    return (
        F.when(text.startswith("{"), F.lit("jsonl"))
        .when(text.rlike(COMBINED_LOG_PATTERN), F.lit("combined"))
        .otherwise(F.lit("csv"))
    )


def parse_combined_log(lines: DataFrame, on_error: str = "raise", keep: Sequence[str] = ()) -> DataFrame:
    """Requests from combined-format lines in column ``value``.

    The line is matched once: the pattern rewrites it to its fields, one per line feed, which a
    log line cannot contain. ``on_error``: ``raise`` fails the job on a bad line, ``keep`` returns
    it in column ``corrupt_line`` with the other columns NULL.
    """
    text = stripped(F.col("value"))
    rewritten = F.regexp_replace(
        text, COMBINED_LOG_PATTERN, "$1\n$2\n$3\n$4\n$6\n$7\n$8\n$9"
    )
    fields = lines.where(text != "").select(*keep, "value", F.split(rewritten, "\n").alias("f"))
    part = lambda i: F.get("f", F.lit(i))
    time = combined_log_epoch(part(1))
    dash_to_null = lambda value: F.when(value != "-", value)
    size = dash_to_null(part(5)).try_cast("bigint")
    good = (F.size("f") == 8) & time.isNotNull() & ((part(5) == "-") | size.isNotNull())
    columns = {
        "ip": part(0),
        "timestamp": time,
        "method": part(2),
        "path": normalize_path(part(3)),
        "status_code": part(4).try_cast("int"),
        "body_bytes_sent": size,
        "referrer": normalize_referrer(part(6)),
        "user_agent": dash_to_null(part(7)),
    }
    if on_error == "raise":
        message = F.concat(F.lit("could not parse log line: "), F.col("value"))
        columns["timestamp"] = F.when(good, time).otherwise(F.raise_error(message).cast("double"))
        selected = [value.alias(name) for name, value in columns.items()]
    elif on_error == "keep":
        selected = [F.when(good, value).alias(name) for name, value in columns.items()]
        selected.append(F.when(~good, F.col("value")).alias("corrupt_line"))
    else:
        raise ValueError("on_error must be 'raise' or 'keep'")
    return fields.select(*keep, *selected, F.lit(None).cast("string").alias("label"))


def _source_column(df: DataFrame, aliases: Sequence[str]) -> str | None:
    by_lower_name = {name.lower(): name for name in df.columns}
    return next((by_lower_name[a] for a in aliases if a in by_lower_name), None)


def normalize_requests(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Canonical request columns from any accepted column names; other columns only via ``keep``."""
    found = {name: _source_column(df, aliases) for name, aliases in REQUEST_COLUMN_ALIASES.items()}
    request_line = _source_column(df, ["request_line"])
    if found["timestamp"] is None:
        raise ValueError("requests need a timestamp column")
    if found["path"] is None and request_line is None:
        raise ValueError("requests need a path, url, request_uri or request_line column")

    column = lambda name: F.col(f"`{found[name]}`")
    text = lambda name, default=None: (
        column(name).cast("string") if found[name] else F.lit(default).cast("string")
    )
    time_type = df.schema[found["timestamp"]].dataType
    path = (
        normalize_path(column("path")) if found["path"]
        else path_from_request_line(F.col(f"`{request_line}`"))
    )
    normalized = df.select(
        *keep,
        coerce_epoch_seconds(column("timestamp"), time_type).alias("timestamp"),
        path.alias("path"),
        text("method", "GET").alias("method"),
        (int_or_null(column("status_code")) if found["status_code"] else F.lit(None).cast("int"))
        .alias("status_code"),
        text("user_agent").alias("user_agent"),
        (normalize_referrer(column("referrer")) if found["referrer"] else F.lit(None).cast("string"))
        .alias("referrer"),
        text("ip").alias("ip"),
        text("cookie_id").alias("cookie_id"),
        text("client_id").alias("client_id"),
        text("label").alias("label"),
    )
    return normalized.na.drop(subset=["timestamp", "path"])


def requests_since(requests: DataFrame, start: float) -> DataFrame:
    """Requests at or after an epoch second."""
    return requests.where(F.col("timestamp") >= F.lit(float(start)))
