"""Left lookups that broadcast only what has been measured, and leave hot keys of the rest to skew joins."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

# A looked-up row is a key and a few numbers, so this is some tens of megabytes.
BROADCAST_ROWS = 500_000
ROW_KEY = ["batch_id", "row_id"]


def fits(df: DataFrame, max_rows: int) -> bool:
    """Measured, reading no further than the bound."""
    return df.limit(max_rows + 1).count() <= max_rows


@dataclass(frozen=True)
class LookupTable:
    """A table with unique keys and what its measured size allows."""
    rows: DataFrame
    keys: list[str]
    broadcast: bool


def measure(rows: DataFrame, keys: list[str], max_rows: int = BROADCAST_ROWS) -> LookupTable:
    """Measure a table once, for any number of lookups."""
    return LookupTable(rows, keys, fits(rows, max_rows))


def look_up(left: DataFrame, table: LookupTable) -> DataFrame:
    """Left join to a measured table.

    Within the bound the table is broadcast.  Beyond, both sides shuffle on the key; the rows of a hot key, measured as they are
    written, are split over tasks by the adaptive skew join, so nothing is copied for keys that aren't hot.
    """
    if table.broadcast:
        return left.join(F.broadcast(table.rows), table.keys, "left")
    return left.join(table.rows.hint("shuffle_merge"), table.keys, "left")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`measure` and `look_up` in one, for a table used once."""
    return look_up(left, measure(right, keys, max_rows))
