"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
