"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known(value: Column) -> Column:
    """Null instead of NaN."""
    return F.when(~F.isnan(value), value)


def finite(value: Column) -> Column:
    """Null instead of NaN or an infinite value."""
    return F.when(F.abs(known(value)) < F.lit(float("inf")), value)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double; null when the divisor is zero or null."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def ratio0(top: Column, bottom: Column) -> Column:
    """Quotient as double; zero when the divisor is zero."""
    return F.coalesce(ratio(top, bottom), F.lit(0.0))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into null in every floating-point column of a scan."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[known(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def to_long(df: DataFrame, features: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """Rows ``(keep..., feature, value)``: one generator, not one expression per sensor and statistic."""
    names = F.array(*[F.lit(f) for f in features])
    values = F.array(*[known(F.col(f).cast("double")) for f in features])
    exploded = df.select(*keep, F.posexplode(values).alias("__pos", "value"))
    return exploded.withColumn("feature", F.element_at(names, F.col("__pos") + 1)).drop("__pos")


def to_long_text(df: DataFrame, features: Sequence[str], keep: Sequence[str | Column] = ()) -> DataFrame:
    """Long form of categorical features, with values as strings."""
    names = F.array(*[F.lit(f) for f in features])
    values = F.array(*[F.col(f).cast("string") for f in features])
    exploded = df.select(*keep, F.posexplode(values).alias("__pos", "value"))
    return exploded.withColumn("feature", F.element_at(names, F.col("__pos") + 1)).drop("__pos")


def parsed_time(column: str, fmt: str | None, dtype: T.DataType) -> Column:
    """Timestamp of a column: parsed with ``fmt`` when it is text, null when that fails."""
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(F.col(column), F.lit(fmt) if fmt else None).cast("timestamp_ntz")
    return F.col(column).cast("timestamp_ntz")


def event_time(df: DataFrame, column: str, fmt: str | None = None) -> Column:
    return parsed_time(column, fmt, df.schema[column].dataType)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double for display or comparison, with -0.0 shown as 0.0."""
    return df.select(*[
        (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])
