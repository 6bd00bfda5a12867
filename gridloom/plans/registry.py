"""The library's queries over the driver tables, and the SQL that states the same results."""

from __future__ import annotations

from . import build_queries, extra_queries, field_queries, flow_queries, kernel_queries, measure_queries, more_queries, point_queries, source_queries, wider_queries  # noqa: F401
from .catalog import ORACLE_SQL, QUERIES  # noqa: F401
