"""Registered queries: each name maps to a Spark job and, where SQL can say it, the same in SQL."""

from importlib import import_module

SECTIONS = ["q_reports", "q_standardize", "q_layout", "q_flows", "q_streams", "q_sources"]


def load_all() -> None:
    for section in SECTIONS:
        import_module(f"docfields.catalog.{section}")
