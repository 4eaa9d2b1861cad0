"""The named queries: for each key a Spark query over the driver tables and, where SQL can say it, the checking SQL."""
from importlib import import_module

from fleetcost.catalog.registry import REGISTRY, Query, query  # noqa: F401

for _m in ("lookups", "pricing", "pricecard", "sources", "basics", "sizing", "requests", "validation", "results", "calibration",
           "reconciliation"):
    import_module(f"fleetcost.catalog.{_m}")
