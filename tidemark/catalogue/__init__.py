"""Importing this package registers every named query."""

import importlib

MODULES = ("generic", "counters", "health", "cluster", "pg", "fleet", "streams", "functions")

for _name in MODULES:
    importlib.import_module(f"tidemark.catalogue.{_name}")
