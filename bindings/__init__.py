"""Query bindings: every operator on the driver's tables, with its SQL twin."""
from .base import ORACLES, QUERIES
from . import build, catalog, crawl, mixed, retain, scan  # noqa: F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES"]
