"""Imports every query module so the registry is complete."""

from . import queries, queries_io, queries_quality, queries_stream  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
