"""Work done once for equal rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with the columns that work() adds, where these follow from the keys alone.

    work gets the distinct keys (nulls count as equal) and gives one row for each;
    columns that it adds replace those of the same name.
    """
    done = work(df.select(*keys).distinct())
    added = [c for c in done.columns if c not in keys]
    same = [f"_key{k}" for k in range(len(keys))]
    done = done.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keys, same, strict=True)], *[f"`{c}`" for c in added])
    match = [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(keys, same, strict=True)]
    return df.drop(*added).join(done, match).drop(*same)
