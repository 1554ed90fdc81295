"""Join helper: the keys shared by tables partitioned by post date."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_keys(*dfs: DataFrame, key: str = "id") -> list[str]:
    """``[id]`` or ``[id, dt]`` when every side is partitioned by post date.

    Putting ``dt`` in the keys lets dynamic partition pruning reach all sides.
    """
    if all("dt" in d.columns for d in dfs):
        return [key, "dt"]
    return [key]
