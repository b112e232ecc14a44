"""All registered queries."""

from . import files, genomes, tables  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
