"""Keep expensive columns from being computed more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fence(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pass ``columns`` through a one-row generator.

    The optimizer pushes a filter on a computed column below the projection that
    computes it, with the whole expression written out in the filter: a filter on
    a verdict would run every detector again, once per mention.  Filters on the
    output of a generator stay above it, while filters on the other columns still
    reach the scan.
    """
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline_outer(F.array(F.struct(*columns))))
