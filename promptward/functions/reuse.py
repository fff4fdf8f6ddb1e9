"""Build large column expressions once per Spark session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext


def built_once(build: Callable) -> Callable:
    """Cache the columns a function builds from hashable arguments.

    Column expressions name columns and are bound to no DataFrame, so one can be
    used again; building the larger ones takes hundreds of calls into the JVM.
    """
    columns: dict = {}

    @wraps(build)
    def cached(*args):
        context = SparkContext.getOrCreate()
        key = (context.applicationId, args)
        if key not in columns:
            for old in [k for k in columns if k[0] != context.applicationId]:
                del columns[old]
            columns[key] = build(*args)
        return columns[key]

    return cached
