"""All queries of the core and the SQL for them."""

from folio.plans import corpus_queries, evaluation_queries, pipeline_queries  # noqa: F401  (they register their queries)
from folio.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
