"""Queries by family; importing this package registers them all."""

from . import cohort, files, modelling, planted, statistics
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cohort", "files", "modelling", "planted", "statistics"]
