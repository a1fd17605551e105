"""Registered queries and their SQL."""

from periodica.plans import queries, reports, research

QUERIES = queries.QUERIES | research.QUERIES | reports.QUERIES
ORACLES = queries.ORACLES | research.ORACLES | reports.ORACLES
