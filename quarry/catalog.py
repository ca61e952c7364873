"""All queries of the engine, from the modules that register them."""

from __future__ import annotations

from . import queries, queries_campaign, queries_files, queries_geometry, queries_jobs, queries_lattice, queries_molgraph, queries_receptors, queries_shape  # noqa: F401
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
