"""All queries of the engine's own operators, by name, with their SQL."""

from . import corpus_queries, experiment_queries, source_queries, token_queries

QUERIES: dict = {**corpus_queries.Q, **token_queries.Q, **source_queries.Q, **experiment_queries.Q}
ORACLES: dict = {**corpus_queries.SQL, **token_queries.SQL, **source_queries.SQL, **experiment_queries.SQL}
FLAGSHIP = "dedup_by_language"
