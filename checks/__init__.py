"""Queries over the driver tables, each with the SQL it must agree with."""

import importlib

from checks.base import ORACLES, QUERIES

for _name in ("evaluation", "texts", "records", "chat", "rules", "reports", "lookups",
              "generation", "streams", "files"):
    importlib.import_module(f"checks.{_name}")

__all__ = ["ORACLES", "QUERIES"]
