"""missaware: missingness-avoiding decision trees and forests as Spark DataFrame jobs.

Every split candidate's impurity score is penalised by ``alpha`` times the weighted share of
rows at the node for which the feature was missing before imputation.  Fitting runs
level by level: all open nodes (and, for forests, all trees) of one depth share a single
aggregation job over the cached training table.
"""

from missaware.plans.estimators import (  # noqa: F401
    MissAwareForestClassifier,
    MissAwareTreeClassifier,
)
from missaware.plans.model import ForestModel, TreeModel  # noqa: F401

__all__ = [
    "MissAwareTreeClassifier",
    "MissAwareForestClassifier",
    "TreeModel",
    "ForestModel",
]
