"""Every query of the library by name, with the SQL that should give the same rows."""

from __future__ import annotations

from . import aggregates, checks, counting, filters, flags, io, printed, relations, rules, scalars, search, suppliers, tools, windows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
