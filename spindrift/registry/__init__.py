"""All registered queries; importing this package loads every module of them."""

from importlib import import_module

from spindrift.registry.base import ORACLES, QUERIES

MODULES = ("kpi", "marts", "voyages", "semantics", "retrieval", "models", "facts")
for _name in MODULES:
    import_module(f"spindrift.registry.{_name}")

__all__ = ["ORACLES", "QUERIES"]
