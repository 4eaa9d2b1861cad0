"""Equivalent SQL for the checking engine: each query is written by hand over shared named subqueries."""
from fleetcost.oracle.base import CTES, compose, fmt, r2, rn, rounded, values  # noqa: F401
