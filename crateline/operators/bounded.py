"""Driver-side lookups whose size is checked before they are shipped to executors."""

from __future__ import annotations

from pyspark.sql import DataFrame


def collect_if_small(df: DataFrame, max_rows: int) -> list | None:
    """The rows of ``df`` if there are at most ``max_rows`` of them, else ``None``.

    ``max_rows + 1`` rows are fetched at most, so a table that has outgrown its
    bound costs no more than the bound; callers must then take their join path.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
