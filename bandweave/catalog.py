"""The registered queries of the series, vector and graph operators, and the SQL that must give the same rows."""

from __future__ import annotations

from .queries import series, vectors

QUERIES: dict = {**series.QUERIES, **vectors.QUERIES}
ORACLES: dict = {**series.ORACLES, **vectors.ORACLES}
