"""All registered queries and their DuckDB twins."""

from __future__ import annotations

from fleetspark.plans import (q_audit, q_fill, q_folds, q_late, q_leases, q_lines, q_listings, q_many, q_policy, q_rdf, q_records,
                              q_retention, q_scan, q_stars, q_streaming, q_topology)

_MODULES = [q_leases, q_listings, q_policy, q_lines, q_audit, q_retention, q_topology, q_rdf, q_scan, q_streaming,
            q_many, q_stars, q_records, q_fill, q_folds, q_late]

QUERIES = {}
ORACLE_SQL = {}
for _m in _MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLE_SQL.update({k: v.strip() for k, v in _m.ORACLE.items()})
