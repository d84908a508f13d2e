"""Level-wise fitting of missingness-avoiding trees and forests.

One aggregation job per depth serves every open node of every tree:

    cached base --walk the trees so far (literal node arrays)--> (tree, node, row)
      --unpivot features--> (tree, node, feature, value, missing, label, weight)
      --hash aggregate--> histogram per (tree, node, feature, value)
      --window scan in value order--> running class weights --> scored cut points
      --max(struct) per (tree, node)--> one winning split per open node --> driver

Only the winners (at most one row per open node) reach the driver.  Places in the trees are
worked out again from the cached base at every level (a step of generated code per depth), so the
lineage does not grow with depth and a lost executor only recomputes one level's scan.  Node statistics
of the children come from the winning cut's left / right sums, so no extra job counts them.

Below the root only the smaller child of a split is unpivoted and aggregated: its sibling's histogram
is the parent's, kept from the level before, minus the child's.  Differences are exact where all
weights are whole numbers (and their sum below 2**53); with fractional weights both children are
aggregated from their rows, as they are where the values are nearly all distinct, so that the
parents' histograms are hardly smaller than the rows (``SPARSE``).  The trees do not depend on it.

Trees over the same rows (an alpha grid, per fold) share a node as long as all splits above it are
equal: its rows are walked, unpivoted and aggregated once, for one of the trees, and the penalties of all
of them are applied to the node's best cut per feature (the penalty is constant there).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missaware.functions.hashing import poisson_cdf, poisson_count, xxhash01
from missaware.functions import sparse
from missaware.functions.impurity import CRITERIA
from missaware.operators import binning, splits
from missaware.operators.scoring import node_values, route
from missaware.plans.model import Node, TreeModel
from missaware.session import ensure_checkpoint_dir


@dataclass
class FitParams:
    max_depth: int = 3
    alpha: float = 1.0
    criterion: str = "gini"
    near_equal: splits.NearEqual | None = None
    penalty: str = "weighted"
    merge_equal_siblings: bool = False
    bins: int | None = None
    exact_bins: bool = True
    max_window_bins: int | None = splits.DEFAULT_MAX_WINDOW_BINS
    # spread the prepared rows over this many partitions (None: as the input comes); useful where a
    # small input is read as fewer splits than the cluster has cores
    partitions: int | None = None
    # one tree per alpha, all grown in the same per-level jobs (tree t uses alphas[t])
    alphas: tuple[float, ...] | None = None
    # write the prepared rows to the checkpoint folder instead of caching them
    checkpoint: bool = False

    def alpha_of(self, tree: int) -> float:
        return self.alpha if self.alphas is None else self.alphas[tree]

    def validate(self) -> None:
        if self.criterion not in CRITERIA:
            raise ValueError(f"criterion must be one of {CRITERIA}, got {self.criterion!r}")
        if not isinstance(self.max_depth, int) or self.max_depth < 1:
            raise ValueError(f"max_depth must be an integer >= 1, got {self.max_depth!r}")
        if self.alpha is None or self.alpha < 0:
            raise ValueError(f"alpha must be >= 0, got {self.alpha!r}")
        if self.alphas is not None and (not self.alphas or min(self.alphas) < 0):
            raise ValueError("alphas must be a non-empty list of values >= 0")
        if self.bins is not None and self.bins < 2:
            raise ValueError("bins must be >= 2")
        if self.partitions is not None and self.partitions < 1:
            raise ValueError("partitions must be >= 1")


@dataclass
class FeatureSpec:
    """Features as named columns (with optional mask columns), as one array column, or as one column of
    MLlib vectors (``sparse``) of which only the entries that are not 0 are read."""

    features: list[str] = field(default_factory=list)
    masks: list[str | None] = field(default_factory=list)
    array_col: str | None = None
    array_mask_col: str | None = None
    array_size: int | None = None
    sparse: bool = False
    vector_cols: list[str] = field(default_factory=list)

    @staticmethod
    def columns(df: DataFrame, features: list[str], mask_prefix: str = "missing_") -> "FeatureSpec":
        present = set(df.columns)
        masks = [f"{mask_prefix}{f}" if f"{mask_prefix}{f}" in present else None for f in features]
        return FeatureSpec(list(features), masks)

    @staticmethod
    def array(df: DataFrame, values: str, mask: str | None = None) -> "FeatureSpec":
        size = df.agg(F.max(F.size(values))).first()[0] or 0
        names = [f"{values}[{i}]" for i in range(size)]
        return FeatureSpec(names, [None] * size, values, mask, size)

    @staticmethod
    def vectors(df: DataFrame, values: str, mask: str | None = None) -> "FeatureSpec":
        """Vectors, or structs of places ``i``, values ``v`` and length ``n``, read by their entries; ``mask``
        has 0 / 1 flags in the same form."""
        size = df.agg(F.max(sparse.entries_of(df, values)["n"])).first()[0] or 0
        return FeatureSpec([f"{values}[{i}]" for i in range(size)], [None] * size, values, mask, size, True, [c for c in (values, mask) if c and sparse.is_vector(df, c)])

    def entries(self, column: str) -> Column:
        return sparse.entries(F.col(column)) if column in self.vector_cols else F.col(column)

    def base_cols(self) -> list[Column]:
        if self.sparse:
            return [self.entries(c).alias(c) for c in (self.array_col, self.array_mask_col) if c is not None]
        if self.array_col is not None:
            cols = [F.col(self.array_col)]
            if self.array_mask_col is not None:
                cols.append(F.col(self.array_mask_col))
            return cols
        cols = [F.col(f).cast("double").alias(f) for f in self.features]
        cols += [F.col(m).cast("int").alias(m) for m in self.masks if m is not None]
        return cols

    def fault(self) -> Column:
        """Why a row cannot be used, null where it can: mask values other than 0 / 1, arrays of another length."""
        one = lambda m: m.isNull() | ~m.cast("double").isin(0.0, 1.0)
        wrong = F.lit(False)
        if self.sparse:
            size = lambda c: F.coalesce(self.entries(c)["n"], F.lit(-1)) != self.array_size
            out = F.when(size(self.array_col), FAULTS["size"])
            if self.array_mask_col is not None:
                out = out.when(size(self.array_mask_col), FAULTS["size"]).when(F.exists(self.entries(self.array_mask_col)["v"], one), FAULTS["mask"])
            return out
        if self.array_col is not None:
            n = F.lit(self.array_size)
            out = F.when(F.coalesce(F.size(self.array_col), F.lit(-1)) != n, FAULTS["size"])
            if self.array_mask_col is not None:
                m = F.col(self.array_mask_col)
                out = out.when(F.coalesce(F.size(m), F.lit(-1)) != n, FAULTS["size"]).when(F.exists(m, one), FAULTS["mask"])
            return out
        for m in self.masks:
            if m is not None:
                wrong = wrong | one(F.col(m))
        return F.when(wrong, FAULTS["mask"])

    def unpivot(self, df: DataFrame, keep: list[str]) -> DataFrame:
        if self.sparse:
            return sparse.long_form(df, self.array_col, self.array_mask_col, keep)
        if self.array_col is not None:
            return splits.unpivot_arrays(df, self.array_col, self.array_mask_col, keep)
        return splits.unpivot(df, self.features, self.masks, keep)

    def empty_model(self, n_classes: int, tree: int) -> TreeModel:
        return TreeModel(
            features=list(self.features),
            masks=list(self.masks),
            n_classes=n_classes,
            tree=tree,
            array_col=self.array_col,
            array_mask_col=self.array_mask_col,
            sparse=self.sparse,
        )


#: A histogram is used for the next level's larger children if it has fewer rows than this share of the rows
#: it saves from being unpivoted.
SPARSE = 0.25
#: Columns whose distinct values are counted (about) to tell that beforehand; more are taken as all distinct.
COUNTED = 64


def _is_pure(class_weights: list[float]) -> bool:
    return sum(1 for c in class_weights if c > 0) <= 1


FAULTS = {
    "label": "labels must be whole numbers without null",
    "weight": "row weights must not be null or negative",
    "mask": "missing flags must be 0 or 1 without null",
    "size": "all feature and mask arrays must have the same length",
}


def _label_stats(df: DataFrame, group: list[str], fault: list[str], distinct: list[str] = ()) -> list:
    """Rows and weight per label, whether a weight is fractional, faults, and about how many values columns have."""
    fraction = F.max((F.col("_w") != F.floor("_w")).cast("int")).alias("fraction")
    return (
        df.groupBy(*group, "_y")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), fraction, *[F.min(c).alias(c) for c in fault], *[F.approx_count_distinct(c).alias(f"_d{i}") for i, c in enumerate(distinct)])
        .collect()
    )


def check_labels(labels: set[int]) -> int:
    """Labels must be exactly 0 .. K-1; returns K."""
    if not labels:
        raise ValueError("cannot fit on an empty table")
    if None in labels:
        raise ValueError("labels must not be null")
    k = max(labels) + 1
    if sorted(labels) != list(range(k)):
        raise ValueError(f"labels must be all of 0 .. K-1, found {sorted(labels)}")
    return k


def fit_forest(
    df: DataFrame,
    spec: FeatureSpec,
    label: str,
    params: FitParams,
    *,
    weight: str | None = None,
    n_trees: int = 1,
    bootstrap: bool = False,
    seed: int = 0,
    key_cols: list[str] | None = None,
    bootstrap_u: Callable[[Column], Column] | None = None,
    tree_weight: Callable[[Column], Column] | None = None,
    same_rows: Callable[[int], int] | None = None,
) -> list[TreeModel]:
    """Fit ``n_trees`` trees level by level; all trees share each level's job.

    With ``bootstrap`` each row gets a Poisson(1) count per tree from a hash of its key
    (``key_cols``) and the tree index; the count multiplies the row weight, so no row is
    copied.  Rows of weight 0 stay in the row counts; null or negative weights, labels that are
    not whole numbers and flags other than 0 / 1 are refused.  ``bootstrap_u(tree_col)`` overrides the uniform draw.
    ``tree_weight(tree_col)`` multiplies the weight per (row, tree) too, e.g. 0 to hold a
    fold out of its own trees (``key_cols`` carry the columns it reads); ``same_rows(tree)`` is equal for
    trees with equal weights, which then share their work (an alpha grid without ``tree_weight`` does).
    """
    params.validate()
    if spec.sparse and params.bins is not None:
        raise ValueError("sparse vectors take the exact split search: no bins")
    if params.alphas is not None:
        if bootstrap:
            raise ValueError("an alpha grid grows one tree per alpha on the same rows; no bootstrap")
        n_trees = len(params.alphas)
    keys = list(key_cols or [])
    if bootstrap and not keys and bootstrap_u is None:
        raise ValueError("a bootstrap draws by row key: name the key columns")
    weight_col = F.col(weight).cast("double") if weight else F.lit(1.0)
    y, w = F.col(label).cast("double"), weight_col
    whole = y.isNotNull() & (y == F.floor(y)) & (F.abs(y) < 2**31)
    fault = F.when(~F.coalesce(whole, F.lit(False)), FAULTS["label"]).when(w.isNull() | ~(w >= 0) | F.isnan(w), FAULTS["weight"]).otherwise(spec.fault())
    base = df.select(
        *[F.col(k) for k in keys],
        *spec.base_cols(),
        F.when(whole, y).cast("int").alias("_y"),
        w.alias("_w"),
        fault.alias("_fault"),
    )
    if params.partitions is not None:
        base = base.repartition(params.partitions)
    drawn = bootstrap or tree_weight is not None
    group = list(map(same_rows, range(n_trees))) if same_rows else list(range(n_trees)) if drawn else [0] * n_trees

    def trees_of(rows: DataFrame, trees: list[int]) -> DataFrame:
        return _with_trees(rows, trees, bootstrap, seed, keys, bootstrap_u, tree_weight)

    if params.checkpoint:
        # reliable copy in the shared checkpoint folder: survives executor loss without
        # recomputing an expensive preparation
        ensure_checkpoint_dir(df.sparkSession)
        base = base.checkpoint(eager=True)
        return _fit_levels(base, spec, params, n_trees, trees_of, group, drawn)
    base = base.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit_levels(base, spec, params, n_trees, trees_of, group, drawn)
    finally:
        base.unpersist()


def _with_trees(base: DataFrame, trees: list[int], bootstrap: bool, seed: int, keys: list[str], bootstrap_u, tree_weight=None) -> DataFrame:
    """The rows of each of the trees, with the tree's number ``_t`` and its weights."""
    if len(trees) == 1:
        rows = base.withColumn("_t", F.lit(trees[0]))
    else:
        rows = base.withColumn("_t", F.explode(node_values(trees, "int")))
    if tree_weight is not None:
        rows = rows.withColumn("_share", tree_weight(F.col("_t")).cast("double")).filter(F.col("_share") > 0)
        rows = rows.withColumn("_w", F.col("_w") * F.col("_share")).drop("_share")
    if not bootstrap:
        return rows
    if bootstrap_u is not None:
        u = bootstrap_u(F.col("_t"))
    else:
        u = xxhash01(*[F.col(k) for k in keys], F.col("_t"), F.lit(seed))
    # the draw is a column of its own, so it is worked out once and not per step of the table
    cdf = poisson_cdf()
    rows = rows.withColumn("_u", u).filter(F.col("_u") >= cdf[0])  # a count of 1 or more
    return rows.withColumn("_w", F.col("_w") * poisson_count(F.col("_u"), cdf)).drop("_u")


def _fit_levels(base, spec, params, n_trees, trees_of, group, drawn) -> list[TreeModel]:
    binned = params.bins is not None
    columns = spec.features if spec.array_col is None and not binned and params.max_depth > 1 and len(spec.features) <= COUNTED else []
    stats = _label_stats(base, [], ["_fault"], columns)
    for r in stats:
        if r["_fault"] is not None:
            raise ValueError(r["_fault"])
    n_classes = check_labels({r["_y"] for r in stats})  # of all rows, drawn or not
    base = base.drop("_fault")
    n_rows = sum(int(r["n"]) for r in stats)
    # values per row and feature in the histogram of all rows: an upper bound
    bins = params.bins * len(spec.features) if binned else sum(min(n_rows, sum(r[f"_d{i}"] for r in stats)) for i in range(len(columns))) if columns else n_rows * len(spec.features)
    if binned:
        # every value is replaced by its bin's edge once; the levels read the binned rows
        cuts = binning.quantile_cuts(spec.unpivot(base, []), params.bins, exact=params.exact_bins, n_rows=n_rows).collect()  # features x bins
        by_feature = {int(r["_f"]): list(r["_cuts"]) for r in cuts}
        if spec.array_col is None:
            edges = {f: binning.bin_column(F.col(f), by_feature.get(i, [])) for i, f in enumerate(spec.features)}
        else:
            edges = {spec.array_col: binning.bin_array(F.col(spec.array_col), by_feature, len(spec.features), params.bins)}
        base = base.withColumns(edges).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _grow(base, spec, params, n_trees, trees_of, group, drawn, n_classes, binned, stats, bins < SPARSE * n_rows * len(spec.features) / 2)
    finally:
        if binned:
            base.unpersist()


def _grow(base, spec, params, n_trees, trees_of, group, drawn, n_classes, binned, stats, few_values) -> list[TreeModel]:
    if drawn:
        first = sorted({g: t for t, g in reversed(list(enumerate(group)))}.values())  # one tree of each group
        of_group = {group[t]: [] for t in first}
        for r in _label_stats(trees_of(base, first), ["_t"], []):
            of_group[group[r["_t"]]].append(r.asDict())
        stats = [{**r, "_t": t} for t in range(n_trees) for r in of_group[group[t]]]
    else:
        stats = [{**r.asDict(), "_t": t} for r in stats for t in range(n_trees)]
    models = [spec.empty_model(n_classes, t) for t in range(n_trees)]
    for t, m in enumerate(models):
        cw = [0.0] * n_classes
        n = 0
        for r in stats:
            if r["_t"] == t:
                cw[r["_y"]] += float(r["w"])
                n += int(r["n"])
        m.nodes[1] = Node(1, 0, n, float(sum(cw)), cw)

    roots: dict = {}
    for t, m in enumerate(models):
        if m.nodes[1].weight > 0 and not _is_pure(m.nodes[1].class_weights):
            roots.setdefault(group[t], []).append((t, 1))
    nodes = [_Open(members) for members in roots.values()]
    exact = few_values and not any(r["fraction"] for r in stats) and sum(float(r["w"]) for r in stats) < 2**53
    level = None
    try:
        for depth in range(params.max_depth):
            if not nodes:
                break
            last = level
            if last is not None and not last.useful():
                exact = False  # deeper levels would keep histograms in vain as well
            above = last if exact else None
            level = _Level(base, trees_of, models, nodes, spec, params, n_classes, binned, above, exact and depth + 1 < params.max_depth)
            winners = level.winners()
            if last is not None:
                last.release()
            split: dict = {}
            for w in winners:
                i = int(w["_i"])
                for t, nid in nodes[i].members:
                    if level.alphas[int(w["_a"])] != params.alpha_of(t):
                        continue
                    m = models[t]
                    node = m.nodes[nid]
                    node.feature_idx = int(w["_f"])
                    node.threshold = float(w["_thr"])
                    node.score = float(w["_ps"])
                    node.missing_share = float(w["_share"])
                    left = Node(2 * nid, depth + 1, int(w["_nl"]), float(w["_wl"]), [float(w[f"_l{k}"]) for k in range(n_classes)])
                    right = Node(2 * nid + 1, depth + 1, int(w["_nr"]), float(w["_wr"]), [float(w[f"_r{k}"]) for k in range(n_classes)])
                    for child in (left, right):
                        m.nodes[child.node] = child
                        split.setdefault((i, node.feature_idx, node.threshold, child is right), []).append((t, child.node))
            if depth + 1 == params.max_depth:
                break
            nodes = []
            for (i, f, thr, is_right), members in sorted(split.items()):
                t, nid = members[0]
                if not _is_pure(models[t].nodes[nid].class_weights):
                    nodes.append(_Open(members, i, split[i, f, thr, not is_right][0]))
    finally:
        if level is not None:
            level.release()

    if params.merge_equal_siblings:
        for m in models:
            merge_equal_siblings(m)
    return models


@dataclass
class _Open:
    """A node that all ``members`` (tree, node) share; ``parent``: its place in the level above;
    ``sibling``: the first member of the other child of the same split."""

    members: list[tuple[int, int]]
    parent: int | None = None
    sibling: tuple[int, int] | None = None

    @property
    def first(self) -> tuple[int, int]:
        return self.members[0]


class _Level:
    """The histograms of one level's open nodes, numbered ``_i`` by their place in ``nodes``, and their best splits."""

    def __init__(self, base, trees_of, models, nodes, spec, params, n_classes, binned, above: "_Level | None", keep: bool):
        self.base, self.trees_of, self.models, self.nodes, self.spec, self.params = base, trees_of, models, nodes, spec, params
        self.n_classes, self.binned, self.keep = n_classes, binned, keep
        self.alphas = sorted({params.alpha_of(t) for x in nodes for t, _ in x.members})
        # a (node, feature) group has at most as many bins as the node has rows, and every open
        # node's row count is known here: only look for oversized groups when one could exist
        self.wide = params.max_window_bins is not None and max(map(self.size, (x.first for x in nodes))) > params.max_window_bins
        self.hist = self._built([x.first for x in nodes]) if above is None else self._from(above)
        if self.keep or self.wide:
            self.hist = self.hist.persist(StorageLevel.MEMORY_AND_DISK)

    def size(self, node: tuple[int, int]) -> int:
        return self.models[node[0]].nodes[node[1]].n

    def _built(self, nodes: list[tuple[int, int]]) -> DataFrame:
        """Histograms of nodes from their rows.  Rows walk the trees so far by their node arrays, a narrow
        step without joins; rows in other nodes drop out before they are unpivoted."""
        rows = self.trees_of(self.base, sorted({t for t, _ in nodes}))
        long_df = self.spec.unpivot(route(rows, self.models, nodes), ["_i", "_y", "_w"])
        hist = splits.histogram(long_df, ["_i"], self.n_classes)
        if not self.spec.sparse:
            return hist
        of = [self.models[t].nodes[nid] for t, nid in nodes]
        total = lambda value, kind="double": F.get(node_values([value(n) for n in of], kind), F.col("_i"))
        classes = {f"_c{k}": total(lambda n, k=k: n.class_weights[k]) for k in range(self.n_classes)}
        return splits.with_zeros(hist, ["_i"], self.n_classes, {"_cnt": total(lambda n: n.n, "bigint"), "_wt": total(lambda n: n.weight), **classes})

    def _from(self, above: "_Level") -> DataFrame:
        """Histograms from the rows of each split's smaller child and the histograms of the level above."""
        number = {x.first: i for i, x in enumerate(self.nodes)}
        pairs = sorted({(x.parent, *sorted((x.first, x.sibling), key=lambda c: (self.size(c), c))) for x in self.nodes})
        larger: list[list[int]] = [[] for _ in above.nodes]
        for parent, _, large in pairs:
            if large in number:
                larger[parent].append(number[large])
        own, sibling = ([number.get(p[k], -1) for p in pairs] for k in (1, 2))
        sums = ["_cnt", "_wt", *splits.class_cols("_c", self.n_classes), "_mw"]
        # a child's row counts for its own node and, negated, for its sibling
        uses = F.array(*[F.struct(F.get(node_values(x, "int"), F.col("_i")).alias("_to"), F.lit(sign).alias("_sign")) for x, sign in ((own, 1), (sibling, -1))])
        built = self._built([small for _, small, _ in pairs]).select("_f", "_v", *sums, F.inline(uses))
        built = built.filter("_to >= 0").select(F.col("_to").alias("_i"), "_f", "_v", *[(F.col(c) * F.col("_sign")).alias(c) for c in sums])
        to = F.get(F.from_json(F.lit(json.dumps(larger)), "array<array<int>>"), F.col("_i"))
        parents = above.hist.select(F.explode(to).alias("_to"), "_f", "_v", *sums).withColumnRenamed("_to", "_i")
        both = built.unionByName(parents).repartition("_i", "_f")
        return both.groupBy("_i", "_f", "_v").agg(*[F.sum(c).alias(c) for c in sums]).filter("_cnt > 0")

    def useful(self) -> bool:
        """Whether the kept histograms are much smaller than the rows they save."""
        if not self.keep:
            return False
        saved = 0
        for x in self.nodes:
            t, nid = x.first
            children = [self.models[t].nodes.get(2 * nid + k) for k in (0, 1)]
            if all(children):
                saved += max(c.n for c in children)
        return self.hist.count() < SPARSE * saved * len(self.spec.features)

    def winners(self) -> list:
        """One row per node (``_i``) and penalty (``_a``, a place in ``alphas``) that has a valid cut."""
        p, criterion, k = self.params, self.params.criterion, self.n_classes
        cum = splits.cumulative(self.hist, ["_i"], k, max_window_bins=p.max_window_bins, n_groups=len(self.nodes) * len(self.spec.features), hot_groups=self.wide)
        cands = splits.candidates(cum, ["_i"], k, criterion, p.near_equal, threshold="value" if self.binned else "midpoint", penalty=p.penalty)
        if len(self.alphas) == 1:
            return splits.best_split(splits.penalised(cands, self.alphas[0]), ["_i"], criterion, k).withColumn("_a", F.lit(0)).collect()
        best = splits.best_per_feature(splits.penalised(cands, 0.0), ["_i"], criterion, k)
        own = [sorted({self.alphas.index(p.alpha_of(t)) for t, _ in x.members}) for x in self.nodes]
        of = F.explode(F.get(F.from_json(F.lit(json.dumps(own)), "array<array<int>>"), F.col("_i"))).alias("_a")
        each = best.select("*", of)
        each = splits.penalised(each, F.get(node_values(self.alphas, "double"), F.col("_a")))
        return splits.best_split(each, ["_i", "_a"], criterion, k).collect()

    def release(self) -> None:
        if self.keep or self.wide:
            self.hist.unpersist()


def merge_equal_siblings(model: TreeModel) -> TreeModel:
    """Bottom-up: a split whose two children are leaves with equal class shares becomes a
    leaf (its own counts are the merged counts)."""
    changed = True
    while changed:
        changed = False
        for nid in sorted(model.nodes, reverse=True):
            n = model.nodes.get(nid)
            if n is None or n.is_leaf:
                continue
            lc, rc = model.nodes.get(2 * nid), model.nodes.get(2 * nid + 1)
            if lc is None or rc is None or not (lc.is_leaf and rc.is_leaf):
                continue
            if lc.probability == rc.probability:
                del model.nodes[2 * nid]
                del model.nodes[2 * nid + 1]
                n.make_leaf()
                changed = True
    return model


def fit_tree(df: DataFrame, spec: FeatureSpec, label: str, params: FitParams, weight: str | None = None) -> TreeModel:
    return fit_forest(df, spec, label, params, weight=weight)[0]
