"""The registered queries over the reference's own operators, and their SQL."""

from __future__ import annotations

from tessera.catalog import analysis, retrieval, tables, text

QUERIES = retrieval.QUERIES | text.QUERIES | analysis.QUERIES | tables.QUERIES
ORACLE_SQL = retrieval.ORACLE_SQL | text.ORACLE_SQL | analysis.ORACLE_SQL | tables.ORACLE_SQL
FLAGSHIP = "hybrid_pipeline"
