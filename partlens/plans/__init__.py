"""Registered queries of the library: importing this package fills the registry."""

from . import boxes, grids, neighbours, points, regions, results, streams, text  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
