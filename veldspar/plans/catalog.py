"""All registered queries."""

from veldspar.plans import files, io, lexical, maintenance, relational, rules, scalars, scripts  # noqa: F401
from veldspar.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
