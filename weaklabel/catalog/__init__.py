"""The queries this repository registers over the test tables."""

from weaklabel.catalog import (
    aggregates,
    columns,
    evaluation_queries,
    feature_queries,
    joins,
    model_queries,
    planted_queries,
    rule_queries,
    scans,
    splits,
)
from weaklabel.catalog.registry import CATALOG

__all__ = ["CATALOG", "aggregates", "columns", "evaluation_queries", "feature_queries", "joins", "model_queries", "planted_queries", "rule_queries", "scans", "splits"]
