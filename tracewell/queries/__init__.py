"""The registered queries: one per operator, on the given tables."""

from tracewell.queries import anchors_q, approvals_q, batches_q, checks_q, contracts_q, documents_q, execution_q, flows_q, folds_q, graphs_q, meaning_q, overview_q, paths_q, regions_q, review_q, titles_q  # noqa: F401
from tracewell.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
