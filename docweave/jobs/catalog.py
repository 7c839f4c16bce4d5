"""Registered queries over the given tables, and the SQL that checks them."""

from __future__ import annotations

from docweave.jobs import queries
from docweave.jobs.oracles import ORACLES

QUERIES = {name: getattr(queries, name) for name in queries.NAMES}

__all__ = ["ORACLES", "QUERIES"]
