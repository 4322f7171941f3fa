"""All queries of the library's own operators, with the SQL each is compared with."""

from __future__ import annotations

from evspark.plans import alignment_queries, diagnosis_queries, interval_queries, latent_queries, model_queries, practice_queries, progress_queries, proximity_queries, review_queries, search_queries, selection_queries, statistics_queries, table_queries, text_queries

_MODULES = (text_queries, statistics_queries, model_queries, table_queries, selection_queries, latent_queries, practice_queries, interval_queries, search_queries, diagnosis_queries, alignment_queries, proximity_queries, progress_queries, review_queries)

QUERIES: dict = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
