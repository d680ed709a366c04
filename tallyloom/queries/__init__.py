"""Query registry; importing this package registers every query."""

import importlib

from tallyloom.queries.registry import QUERIES, Query

MODULES = ["redistribution", "cells", "calibration", "compositions", "rates", "surveys", "regressions", "records", "storage"]

for _m in MODULES:
    importlib.import_module(f"tallyloom.queries.{_m}")

__all__ = ["QUERIES", "Query"]
