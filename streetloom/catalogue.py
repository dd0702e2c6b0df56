"""All registered queries of the street-network engine and their SQL."""

from .plans import changes, joined, layers, network, oracle, rules

QUERIES = network.QUERIES | layers.QUERIES | joined.QUERIES | changes.QUERIES | rules.QUERIES
ORACLE_SQL = oracle.ORACLE_SQL | layers.ORACLE_SQL | joined.ORACLE_SQL | changes.ORACLE_SQL | rules.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
