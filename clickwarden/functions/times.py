"""Epoch seconds from and to text and timestamps. Naive times are read in the session zone (UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from ..constants import COMBINED_TIME_FORMAT


def epoch_seconds(instant: Column) -> Column:
    return F.unix_micros(instant.cast("timestamp")) / F.lit(1_000_000.0)


def coerce_epoch_seconds(value: Column, data_type: T.DataType) -> Column:
    """Seconds from a number or a date text, decided row by row; NULL when neither."""
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return epoch_seconds(value)
    number = value.try_cast("double")
    if isinstance(data_type, T.NumericType):
        return F.nanvl(number, F.lit(None).cast("double"))
    text = value.cast("string")
    number = F.when(~F.isnan(number), number)
    return F.coalesce(number, epoch_seconds(F.try_to_timestamp(text)))


def combined_log_epoch(text: Column) -> Column:
    return epoch_seconds(F.try_to_timestamp(text, F.lit(COMBINED_TIME_FORMAT)))


def utc_text(seconds: Column) -> Column:
    """ISO text of an epoch second; empty when NULL, fraction only when there is one."""
    micros = F.round(seconds * F.lit(1_000_000.0)).cast("bigint")
    instant = F.timestamp_micros(micros)
    whole = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(
        F.pmod(micros, F.lit(1_000_000)) != 0, F.date_format(instant, ".SSSSSS")
    ).otherwise(F.lit(""))
    return F.coalesce(F.concat(whole, fraction, F.lit("+00:00")), F.lit(""))
