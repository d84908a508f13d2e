"""Fixed models for the scoring queries (FX_M, FX_MF) and their SQL ``CASE`` text."""

from __future__ import annotations

from missaware.catalog.fixtures import FX_A_FEATURES
from missaware.catalog.sqlsplit import lit
from missaware.plans.model import ForestModel, TreeModel

# fixed values: the FX_M tree (features of FX_A, zero-imputed, heap ids)
FX_M_SPLITS = {1: ("quantity", 26.5), 2: ("tax", 0.035), 3: ("discount", 0.065), 7: ("price_k", 60.5)}
FX_M_LEAVES = {4: [0.9, 0.1], 5: [0.5, 0.5], 6: [0.1, 0.9], 14: [0.7, 0.3], 15: [0.4, 0.6]}

# fixed values: the FX_MF forest of four stumps; the second votes 0 on its right side
FX_MF_STUMPS = [
    ("quantity", 26.5, [1.0, 0.0], [0.0, 1.0]),
    ("discount", 0.065, [0.0, 1.0], [1.0, 0.0]),
    ("tax", 0.035, [1.0, 0.0], [0.0, 1.0]),
    ("price_k", 60.5, [1.0, 0.0], [0.0, 1.0]),
]

# fixed values the oracles expect: class per leaf (a tie goes to the smallest) and rule texts
FX_M_CLASS = {4: 0, 5: 0, 6: 1, 14: 0, 15: 1}
FX_MF_CLASS = [{2: 0, 3: 1}, {2: 1, 3: 0}, {2: 0, 3: 1}, {2: 0, 3: 1}]
FX_M_RULES = {
    4: "quantity <= 26.5 AND tax <= 0.035",
    5: "quantity <= 26.5 AND tax > 0.035",
    6: "quantity > 26.5 AND discount <= 0.065",
    14: "quantity > 26.5 AND discount > 0.065 AND price_k <= 60.5",
    15: "quantity > 26.5 AND discount > 0.065 AND price_k > 60.5",
}


def fx_m() -> TreeModel:
    return TreeModel.literal(FX_A_FEATURES, FX_M_SPLITS, FX_M_LEAVES)


def fx_mf() -> ForestModel:
    trees = []
    for t, (f, thr, left, right) in enumerate(FX_MF_STUMPS):
        trees.append(TreeModel.literal(FX_A_FEATURES, {1: (f, thr)}, {2: left, 3: right}, tree=t))
    return ForestModel(trees)


# ---- SQL printers (oracle side) ----------------------------------------------------------

def case_sql(model: TreeModel, at_leaf, node: int = 1) -> str:
    n = model.nodes[node]
    if n.is_leaf:
        return at_leaf(n)
    f = model.features[n.feature_idx]
    left, right = case_sql(model, at_leaf, 2 * node), case_sql(model, at_leaf, 2 * node + 1)
    return f"(CASE WHEN {f} <= {lit(n.threshold)} THEN {left} ELSE {right} END)"


def reliance_sql(model: TreeModel, max_depth: int | None = None, node: int = 1) -> str:
    n = model.nodes[node]
    if n.is_leaf or (max_depth is not None and n.depth > max_depth):
        return "0"
    f = model.features[n.feature_idx]
    m = model.masks[n.feature_idx]
    left, right = reliance_sql(model, max_depth, 2 * node), reliance_sql(model, max_depth, 2 * node + 1)
    return (
        f"(CASE WHEN {f} IS NULL THEN {m} WHEN {f} <= {lit(n.threshold)} THEN greatest({m}, {left}) "
        f"ELSE greatest({m}, {right}) END)"
    )


def leaf_sql(model: TreeModel) -> str:
    return case_sql(model, lambda n: f"CAST({n.node} AS BIGINT)")


def predict_sql(model: TreeModel) -> str:
    classes = FX_M_CLASS if len(model.nodes) > 3 else FX_MF_CLASS[model.tree]
    return case_sql(model, lambda n: f"CAST({classes[n.node]} AS BIGINT)")


def proba_sql(model: TreeModel, k: int) -> str:
    return case_sql(model, lambda n: lit(FX_M_LEAVES[n.node][k]))
