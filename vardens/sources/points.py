"""Turn tables into points and documents (A1-A3), and save assignments (A4).

Points are ``id BIGINT`` plus flat ``x0, x1[, x2] DOUBLE`` columns for the 2-3-d hot path,
or ``features ARRAY<DOUBLE>`` for high dimension, plus ``valid BOOLEAN``.  A row with a
NULL, NaN or infinite coordinate (or, for arrays, the wrong length) is kept with
``valid = false``: it is reported as ``invalid`` and never joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import coord_names, finite


def points_from_columns(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """A1: numeric columns -> ``id, x0..x{d-1}, valid``."""
    names = coord_names(len(cols))
    out = df.select(
        F.col(id_col).cast("long").alias("id"),
        *[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)],
    )
    valid = None
    for n in names:
        valid = finite(n) if valid is None else valid & finite(n)
    return out.withColumn("valid", F.coalesce(valid, F.lit(False)))


def points_from_array(df: DataFrame, id_col: str, col: str, dim: int) -> DataFrame:
    """A2: ``ARRAY<FLOAT|DOUBLE>`` -> ``id, features ARRAY<DOUBLE>, valid`` (length ``dim``)."""
    feats = F.transform(F.col(col), lambda v: v.cast("double"))
    out = df.select(F.col(id_col).cast("long").alias("id"), feats.alias("features"))
    ok = (
        F.col("features").isNotNull()
        & (F.size("features") == F.lit(dim))
        & F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    )
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def flatten_features(points: DataFrame, dim: int) -> DataFrame:
    """Array points -> flat ``x0..`` columns (for the grid operators, small ``dim``)."""
    names = coord_names(dim)
    return points.select("id", *[F.col("features")[i].alias(n) for i, n in enumerate(names)], "valid")


def documents_from(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """A3: text table -> ``id, text`` (NULL text becomes empty), plus carried columns."""
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *keep,
    )


def write_assignments(df: DataFrame, path: str) -> None:
    """A4: save an assignment as Parquet, replacing whatever is at ``path``."""
    df.write.mode("overwrite").parquet(path)
