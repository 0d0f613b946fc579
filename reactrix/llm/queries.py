"""Imports every operator module, so that all their queries are registered."""

from . import exact, kmeans, language, lines, merkle, minhash, mixing, packing, pii, ranking, secrets, simhash, toxicity  # noqa: F401
from .common import ORACLES, QUERIES  # noqa: F401
