"""The query catalogue over the benchmark tables."""

from kestrel.queries import coverage, features, files, invariants, joins, learners, modelling, profiles, quality, scalars, windows  # noqa: F401
from kestrel.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
