"""All queries of the library itself, and their SQL."""

from textloom.plans import correct_queries, graph_queries, likeness_queries, line_queries, metric_queries, record_queries, row_queries, vector_queries, wave_queries

MODULES = [graph_queries, correct_queries, record_queries, vector_queries, wave_queries, likeness_queries, line_queries, metric_queries, row_queries]
FLAGSHIP = "fuzzy_top1"
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
