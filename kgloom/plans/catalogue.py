"""All registered queries."""
from kgloom.plans import (  # noqa: F401
    corpus_queries, extraction_queries, graph_queries, ontology_queries, quality_queries, retrieval_queries, text_queries)
from kgloom.plans.registry import QUERIES, SQL  # noqa: F401
