"""Registered queries with their DuckDB twins."""

from . import claim_queries, more_queries, program_queries, report_queries, sequence_queries, source_queries, state_queries, text_queries

_PARTS = (sequence_queries.R, report_queries.R, text_queries.R, more_queries.R, source_queries.R, claim_queries.R, state_queries.R, program_queries.R)
QUERIES = {name: f for part in _PARTS for name, f in part.queries.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.oracles.items()}
