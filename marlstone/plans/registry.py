"""The registered queries: name to callable, and name to the equivalent DuckDB SQL."""

from __future__ import annotations

from . import catalogue, layout, neighbours, sensory, spherical, updates

QUERIES = catalogue.QUERIES | neighbours.QUERIES | layout.QUERIES | sensory.QUERIES | spherical.QUERIES | updates.QUERIES
ORACLES = catalogue.ORACLES | neighbours.ORACLES | layout.ORACLES | sensory.ORACLES | spherical.ORACLES | updates.ORACLES
