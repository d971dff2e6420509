"""Reading series and bringing their columns into the types that the smoothers take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_series(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Any format that Spark reads; CSV takes a header and numbers unless told otherwise."""
    if format == "csv":
        options = {"header": True, "inferSchema": True} | options
    return spark.read.format(format).options(**options).load(path)


def write_series(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    """Writes a result, CSV with a header; ``partition_by`` splits it into folders by key."""
    writer = df.write.format(format).mode(mode).options(**({"header": True} if format == "csv" else {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def stream_series(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet", **options) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def numeric(df: DataFrame, column: str) -> Column:
    """A column as double; timestamps and dates as seconds since 1970."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")).cast("double") / 1e6
    return c.cast("double")
