"""Runnable query catalogue over the driver's tables, with SQL twins."""
from importlib import import_module

from sunloom.gallery.registry import ORACLES, QUERIES

MODULES = ("grid_queries", "source_queries", "landing_queries", "detection_queries", "validation_queries", "tracker_queries", "physics_queries", "report_queries", "stream_queries")

for _name in MODULES:
    import_module(f"sunloom.gallery.{_name}")

__all__ = ["ORACLES", "QUERIES"]
