"""Imports every plan module so that all queries are registered."""

from . import aggregations, fits, projections, windows, joins, ingest, texts, streams, models  # noqa: F401
from .registry import QUERIES, oracles  # noqa: F401
