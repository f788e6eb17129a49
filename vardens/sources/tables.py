"""Loaders for the driver's Parquet tables and the inputs derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .points import documents_from, points_from_array, points_from_columns

# Fixed values of the event-point definition: days since 2024-01-01 and value / 10.
DAY_MICROS = 86400000000.0
DAY_OFFSET = 19723.0
VALUE_SCALE = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` -> 2-d points: x0 = days since 2024-01-01 (from ``ts``), x1 = value / 10.

    ``ts`` is TIMESTAMP_NTZ; the microsecond count is taken against an NTZ epoch, so the
    result does not depend on the session time zone.
    """
    ev = table(spark, sf_dir, "events")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    ev = ev.select(
        "event_id",
        (micros.cast("double") / F.lit(DAY_MICROS) - F.lit(DAY_OFFSET)).alias("px"),
        (F.col("value") / F.lit(VALUE_SCALE)).alias("py"),
    )
    return points_from_columns(ev, "event_id", ["px", "py"])


def embedding_points(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    return points_from_array(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", dim)


def documents(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    return documents_from(table(spark, sf_dir, "documents"), "doc_id", "text", keep)
