"""Operators of a training-data pipeline: cleaning, de-duplication, encoding, sharding."""

import os
import sys
from pathlib import Path

from pyspark import cloudpickle

_ROOT = str(Path(__file__).resolve().parents[2])

# Executors import this package where PYTHONPATH leads to it.  Elsewhere, as in a
# session that was started without it, its functions travel with the tasks.
if _ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
