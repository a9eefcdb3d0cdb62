"""Every query of the library proper and the SQL it is checked against."""

from __future__ import annotations

from tempora.plans import files, laws, networks, scenes, shapes, spatial, streams, temporal  # noqa: F401
from tempora.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
