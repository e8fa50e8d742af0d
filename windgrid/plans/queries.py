"""All registered queries of the engine's own operators."""

from windgrid.plans import aggregates, fields, projections, sequences, setops, sources, streams, tracks  # noqa: F401
from windgrid.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
