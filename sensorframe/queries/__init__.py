"""The registered queries: every operator run over the given tables, with its SQL twin."""

from sensorframe.queries.registry import ORACLES, QUERIES
from sensorframe.queries import series, summaries, profiles, files, live  # noqa: F401  (they register)

__all__ = ["QUERIES", "ORACLES"]
