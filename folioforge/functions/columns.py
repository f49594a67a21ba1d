"""Names of working columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(df: DataFrame, *names: str) -> list[str]:
    """`names`, with as many leading underscores as it takes to be no column of `df`."""
    taken, before = {c.lower() for c in df.columns}, "_"
    while taken & {f"{before}{n}".lower() for n in names}:
        before += "_"
    return [before + n for n in names]
