"""Registered queries over the driver tables (each with a DuckDB twin).

Every query reads the driver's parquet tables (or rows Spark derives from
them) and runs one or more library operators over *all* rows.
"""

from fleetspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["QUERIES", "ORACLE_SQL"]
