"""Hot keys: spread keys that hold very many rows over several tasks (salting).

Any key we partition point data by (a grid cell, a term) may hold a third of all rows.
Tables keyed by such a key are partitioned by ``(key, salt)``: rows of a hot key get
``salt = pmod(xxhash64(id), nsalt)`` with ``nsalt = ceil(rows / hot_rows)``, every other
key gets salt 0.  The probe side of a join is replicated once per salt of the key it
looks up, so every ``(key, salt)`` task holds at most ``hot_rows`` rows of the big side.

The hot-key table has at most ``total_rows / hot_rows`` rows.  It is written to the
checkpoint folder, its row count is checked, and it is broadcast only when it has at most
``max_broadcast_rows`` rows; beyond that it is joined by shuffle and AQE's skew-join
splitting is the fallback.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

# Defaults, chosen for large clusters: a task holds at most this many rows of one key.
DEFAULT_HOT_ROWS = 2_000_000
# A broadcast hot-key table row is a few longs; 1M rows stay well under 100 MB.
DEFAULT_MAX_BROADCAST_ROWS = 1_000_000


@dataclass
class HotKeys:
    keys: list[str]
    table: DataFrame  # keys + nsalt, hot keys only
    n_hot: int
    max_broadcast_rows: int

    @property
    def broadcastable(self) -> bool:
        return self.n_hot <= self.max_broadcast_rows

    def _lookup(self, names: list[str]) -> DataFrame:
        t = self.table.select(*[F.col(k).alias(n) for k, n in zip(self.keys, names)], "nsalt")
        return F.broadcast(t) if self.broadcastable else t

    def salt_rows(self, df: DataFrame, id_col: str = "id", key_cols: list[str] | None = None) -> DataFrame:
        """Add ``salt`` to the rows of the big side (one salt per row)."""
        names = key_cols or self.keys
        if self.n_hot == 0:
            return df.withColumn("salt", F.lit(0))
        out = df.join(self._lookup(names), on=names, how="left")
        salt = F.pmod(F.xxhash64(F.col(id_col)), F.coalesce(F.col("nsalt"), F.lit(1)).cast("long")).cast("int")
        return out.withColumn("salt", salt).drop("nsalt")

    def expand(self, df: DataFrame, key_cols: list[str] | None = None) -> DataFrame:
        """Replicate each row of the probe side once per salt of its key (column ``salt``)."""
        names = key_cols or self.keys
        if self.n_hot == 0:
            return df.withColumn("salt", F.lit(0))
        out = df.join(self._lookup(names), on=names, how="left")
        n = F.coalesce(F.col("nsalt"), F.lit(1))
        return out.withColumn("salt", F.explode(F.sequence(F.lit(0), n - F.lit(1)))).drop("nsalt")


def find_hot_keys(
    counts: DataFrame,
    keys: list[str],
    count_col: str,
    hot_rows: int = DEFAULT_HOT_ROWS,
    max_broadcast_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
) -> HotKeys:
    """Keys of ``counts`` holding more than ``hot_rows`` rows, with their salt count."""
    hot_rows = max(int(hot_rows), 1)
    table = counts.filter(F.col(count_col) > F.lit(hot_rows)).select(
        *keys, F.ceil(F.col(count_col) / F.lit(float(hot_rows))).cast("int").alias("nsalt")
    )
    n_hot = table.count()
    if n_hot:
        table = checkpoint(table)
    return HotKeys(list(keys), table, n_hot, max_broadcast_rows)
