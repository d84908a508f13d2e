"""Fitted trees and forests.

A tree is a set of nodes keyed by heap id (root 1, children ``2n`` / ``2n + 1``).  The node
set is small (at most ``2^(maxDepth+1)`` per tree) and lives on the driver; it is turned into
Spark column expressions for scoring (see ``missaware.operators.scoring``) and into a node
table DataFrame for persistence and reports.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NODE_SCHEMA = T.StructType(
    [
        T.StructField("tree", T.IntegerType(), False),
        T.StructField("node", T.LongType(), False),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("feature", T.StringType(), True),
        T.StructField("feature_idx", T.IntegerType(), True),
        T.StructField("threshold", T.DoubleType(), True),
        T.StructField("n", T.LongType(), True),
        T.StructField("weight", T.DoubleType(), True),
        T.StructField("class_weights", T.ArrayType(T.DoubleType()), True),
        T.StructField("prediction", T.IntegerType(), True),
        T.StructField("score", T.DoubleType(), True),
        T.StructField("missing_share", T.DoubleType(), True),
        T.StructField("is_leaf", T.BooleanType(), False),
    ]
)


@dataclass
class Node:
    node: int
    depth: int
    n: int
    weight: float
    class_weights: list[float]
    feature_idx: int | None = None
    threshold: float | None = None
    score: float | None = None
    missing_share: float | None = None

    @property
    def is_leaf(self) -> bool:
        return self.feature_idx is None

    @property
    def prediction(self) -> int | None:
        """Majority class by weight; a tie goes to the smallest label; None when empty."""
        if not self.class_weights or self.weight <= 0:
            return None
        best = max(self.class_weights)
        return self.class_weights.index(best)

    @property
    def probability(self) -> list[float]:
        if self.weight <= 0:
            return [0.0 for _ in self.class_weights]
        return [c / self.weight for c in self.class_weights]

    def make_leaf(self) -> None:
        self.feature_idx = None
        self.threshold = None
        self.score = None
        self.missing_share = None


@dataclass
class TreeModel:
    """One fitted tree over named features (columns) or positions of an array or vector column."""

    features: list[str]
    masks: list[str | None]
    n_classes: int
    nodes: dict[int, Node] = field(default_factory=dict)
    tree: int = 0
    array_col: str | None = None
    array_mask_col: str | None = None
    sparse: bool = False

    # ---- structure -------------------------------------------------------------------
    @property
    def root(self) -> Node:
        return self.nodes[1]

    @property
    def max_depth(self) -> int:
        return max(n.depth for n in self.nodes.values())

    def leaves(self) -> list[Node]:
        return [n for n in self.nodes.values() if n.is_leaf]

    def feature_name(self, idx: int | None) -> str | None:
        return None if idx is None else self.features[idx]

    def path(self, leaf: int) -> list[int]:
        """Proper ancestors of a node, root first."""
        out = []
        node = leaf >> 1
        while node >= 1:
            out.append(node)
            node >>= 1
        return out[::-1]

    def rule(self, leaf: int) -> str:
        """Conjunction of the tests on the way to a node, e.g. ``a <= 2.5 AND b > 4.0``."""
        parts = []
        for a in self.path(leaf)[1:] + [leaf] if leaf > 1 else []:
            parent = self.nodes[a >> 1]
            op = "<=" if a % 2 == 0 else ">"
            parts.append(f"{self.features[parent.feature_idx]} {op} {parent.threshold}")
        return " AND ".join(parts) if parts else "TRUE"

    # ---- persistence -----------------------------------------------------------------
    def node_rows(self) -> list[tuple]:
        rows = []
        for nid in sorted(self.nodes):
            n = self.nodes[nid]
            rows.append(
                (
                    self.tree,
                    nid,
                    n.depth,
                    self.feature_name(n.feature_idx),
                    n.feature_idx,
                    n.threshold,
                    n.n,
                    float(n.weight),
                    [float(c) for c in n.class_weights],
                    n.prediction,
                    n.score,
                    n.missing_share,
                    n.is_leaf,
                )
            )
        return rows

    def node_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.node_rows(), NODE_SCHEMA)

    def meta(self) -> dict:
        return {
            "features": self.features,
            "masks": self.masks,
            "n_classes": self.n_classes,
            "array_col": self.array_col,
            "array_mask_col": self.array_mask_col,
            "sparse": self.sparse,
        }

    def to_nested(self, node: int = 1) -> dict:
        """Nested export: ``{"If", "Left", "Else", "Right"}`` / ``{"Predict"}``."""
        n = self.nodes[node]
        if n.is_leaf:
            return {"Predict": n.prediction}
        f = self.feature_name(n.feature_idx)
        return {
            "If": f"{f} <= {n.threshold}",
            "Left": self.to_nested(2 * node),
            "Else": f"{f} > {n.threshold}",
            "Right": self.to_nested(2 * node + 1),
        }

    def to_json(self) -> str:
        return json.dumps(
            {"meta": self.meta(), "tree": self.tree, "nodes": [asdict(self.nodes[k]) for k in sorted(self.nodes)]}
        )

    @classmethod
    def from_node_rows(cls, rows, meta: dict, tree: int = 0) -> "TreeModel":
        nodes = {}
        for r in rows:
            d = r.asDict() if hasattr(r, "asDict") else dict(r)
            nodes[int(d["node"])] = Node(
                node=int(d["node"]),
                depth=int(d["depth"]),
                n=int(d["n"]) if d["n"] is not None else 0,
                weight=float(d["weight"]) if d["weight"] is not None else 0.0,
                class_weights=list(d["class_weights"] or []),
                feature_idx=None if d["is_leaf"] else int(d["feature_idx"]),
                threshold=None if d["is_leaf"] else float(d["threshold"]),
                score=d["score"],
                missing_share=d["missing_share"],
            )
        return cls(
            features=list(meta["features"]),
            masks=list(meta["masks"]),
            n_classes=int(meta["n_classes"]),
            nodes=nodes,
            tree=tree,
            array_col=meta.get("array_col"),
            array_mask_col=meta.get("array_mask_col"),
            sparse=bool(meta.get("sparse", False)),
        )

    @classmethod
    def literal(
        cls,
        features: list[str],
        splits: dict[int, tuple[str, float]],
        leaves: dict[int, list[float]],
        masks: list[str | None] | None = None,
        tree: int = 0,
    ) -> "TreeModel":
        """A hand-written tree: ``splits`` node -> (feature, threshold), ``leaves`` node ->
        class shares.  Used for fixed scoring fixtures and tests."""
        masks = masks if masks is not None else [f"missing_{f}" for f in features]
        n_classes = len(next(iter(leaves.values())))
        nodes = {}
        for nid, (f, t) in splits.items():
            nodes[nid] = Node(nid, nid.bit_length() - 1, 0, 0.0, [0.0] * n_classes, features.index(f), float(t))
        for nid, shares in leaves.items():
            nodes[nid] = Node(nid, nid.bit_length() - 1, 0, 1.0, [float(s) for s in shares])
        return cls(features, masks, n_classes, nodes, tree)


@dataclass
class ForestModel:
    trees: list[TreeModel]

    @property
    def n_classes(self) -> int:
        return max(t.n_classes for t in self.trees) if self.trees else 0

    def node_table(self, spark: SparkSession) -> DataFrame:
        rows = [r for t in self.trees for r in t.node_rows()]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    def to_nested(self) -> list[dict]:
        return [t.to_nested() for t in self.trees]
