"""Shipping of Python kernels to executors."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    """Pickle the functions of a module by value, so that executors need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
