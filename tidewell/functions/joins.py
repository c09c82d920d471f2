"""Join hints behind a check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key table that may be broadcast (some ten bytes each).
BROADCAST_ROWS = 200_000


def small_side(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """keys with a broadcast hint if it has `rows` rows at most (counted), else as it is: the join then shuffles both sides."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys
