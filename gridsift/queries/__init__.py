"""Registered queries of the panel engine and the SQL that checks them."""

from __future__ import annotations

from gridsift.queries import clusters, panels, tables, whole

QUERIES = panels.QUERIES | tables.QUERIES | clusters.QUERIES | whole.QUERIES
ORACLES = panels.ORACLES | tables.ORACLES | clusters.ORACLES | whole.ORACLES
