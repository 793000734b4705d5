"""The registered queries over the given tables, and their SQL."""

from tapeloom.plans.queries import QUERIES
from tapeloom.plans.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]
