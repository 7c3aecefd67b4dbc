"""What may be broadcast: sides whose rows have been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of some tens of bytes that an executor can hold beside its work.
MOST_ROWS = 1_000_000


def small(df: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most_rows`` rows, else as it is, so that the join shuffles.

    Counting stops beyond the bound and reads only what the rows are made by, such as the grouping columns of sums. Streams aren't counted, nor broadcast.
    """
    return df if df.isStreaming or df.limit(most_rows + 1).count() > most_rows else F.broadcast(df)
