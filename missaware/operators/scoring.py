"""Set-oriented scoring: trees and forests as literal node arrays that every row walks.

All nodes of all trees stand in a few literal arrays (feature, threshold, left child, class, ...);
the right child follows the left one.  A row takes ``max_depth`` steps, each an array lookup and a
comparison.  ``Steps`` makes every step a projection of its own, with the place in the tree (and what reliance
needs) as plain columns: no lambda, so the whole walk is generated code, and its size depends on the
depth and the number of trees, not on the nodes.  One method serves a stump and a forest of deep trees:
narrow projections without a join, a row key or a shuffle, the same on batch and streaming DataFrames.  The
``..._col`` functions are the same walk as a single expression, for places where only a column
fits; it needs lambdas, which Spark interprets, so functions over DataFrames do not use it.  A value
that is null goes right, as SQL comparison gives; an array of the wrong length is an error.
"""

from __future__ import annotations

import json
from typing import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missaware.functions import sparse
from missaware.plans.model import ForestModel, Node, TreeModel


def node_values(values: list, kind: str) -> Column:
    """A literal array with a value per node; written as one text, which the optimizer folds, so size costs one call."""
    text = ",".join(repr(float(v)).replace("inf", "Infinity") if kind == "double" else str(int(v)) for v in values)
    return F.split(F.lit(text), ",").cast(f"array<{kind}>")


def _texts(values: list[str]) -> Column:
    return F.split(F.lit("\x1f".join(values)), "\x1f")


def _by_node(value: Callable[[Node], object]) -> Callable[[TreeModel, Node], object]:
    return lambda _, n: value(n)


class Walk:
    """The node arrays of some trees over the same features."""

    def __init__(self, trees: list[TreeModel]):
        self.trees, self.model = trees, trees[0]
        self.flat: list[tuple[TreeModel, Node]] = []
        roots, left = [], {}
        for t in trees:
            roots.append(len(self.flat))
            self.flat.append((t, t.nodes[1]))
            at = roots[-1]
            while at < len(self.flat):  # breadth first, children side by side
                n = self.flat[at][1]
                if not n.is_leaf:
                    left[at] = len(self.flat)
                    self.flat += [(t, t.nodes[2 * n.node]), (t, t.nodes[2 * n.node + 1])]
                at += 1
        self.depth = max(t.max_depth for t in trees)
        self.root = node_values(roots, "int")
        self.feature = node_values([-1 if n.is_leaf else n.feature_idx for _, n in self.flat], "int")
        self.threshold = node_values([0.0 if n.is_leaf else n.threshold for _, n in self.flat], "double")
        self.left = node_values([left.get(i, -1) for i in range(len(self.flat))], "int")

    def numbers(self, value: Callable[[TreeModel, Node], object], kind: str) -> Column:
        """One number per node (None becomes -1)."""
        return node_values([-1 if (v := value(t, n)) is None else v for t, n in self.flat], kind)

    def row(self, out: Callable[[Column, Column], Column], available: set[str] | None = None) -> Column:
        """``out(values, masks)`` with a row's two arrays worked out once."""
        bound = F.array(F.struct(values_of(self.model).alias("v"), masks_of(self.model, available).alias("m")))
        return F.get(F.transform(bound, lambda r: out(r["v"], r["m"])), F.lit(0))

    def _next(self, n: Column, x: Column) -> Column:
        first = F.get(self.left, n)
        return F.when(first < 0, n).when(x <= F.get(self.threshold, n), first).otherwise(first + 1)

    def _steps(self) -> Column:
        return F.array_repeat(F.lit(0), self.depth)

    def end(self, values: Column, tree: Column) -> Column:
        """Index of the leaf that the row reaches in a tree."""
        return F.aggregate(self._steps(), F.get(self.root, tree), lambda n, _: self._next(n, F.get(values, F.get(self.feature, n))))

    def reliant(self, values: Column, masks: Column, tree: Column, max_depth: int | None) -> Column:
        """1 when a tested feature is missing.  Splits deeper than ``max_depth`` do not count; after a
        null value the node's own flag still counts and nothing below does."""
        counts = self.numbers(_by_node(lambda n: 0 if n.is_leaf or (max_depth is not None and n.depth > max_depth) else 1), "int")
        start = F.struct(F.get(self.root, tree).alias("n"), F.lit(0).alias("r"), F.lit(False).alias("stop"))

        def step(a, _):
            f = F.get(self.feature, a["n"])
            x = F.get(values, f)
            flag = F.coalesce(F.get(masks, f), F.lit(0))
            r = F.when((F.get(counts, a["n"]) == 1) & ~a["stop"], F.greatest(a["r"], flag)).otherwise(a["r"])
            return F.struct(self._next(a["n"], x).alias("n"), r.alias("r"), (a["stop"] | ((f >= 0) & x.isNull())).alias("stop"))

        return F.aggregate(self._steps(), start, step, lambda a: a["r"])


def values_of(model: TreeModel) -> Column:
    """All feature values of a row as ``array<double>``."""
    if model.array_col is None:
        return F.array(*[F.col(f).cast("double") for f in model.features])
    v, n = vector_to_array(model.array_col) if model.sparse else F.col(model.array_col), len(model.features)
    wrong = F.raise_error(F.concat(F.lit(f"{model.array_col} must hold {n} features, found "), F.coalesce(F.size(v).cast("string"), F.lit("null"))))
    return F.when(F.size(v) == n, v.cast("array<double>")).otherwise(wrong.cast("array<double>"))


def masks_of(model: TreeModel, available: set[str] | None = None) -> Column:
    """All 0/1 missing flags of a row; a feature without a mask column is never missing."""
    if model.array_col is not None:
        if model.array_mask_col is None:
            return F.lit(None).cast("array<int>")
        return (vector_to_array(model.array_mask_col) if model.sparse else F.col(model.array_mask_col)).cast("array<int>")
    here = [m is not None and (available is None or m in available) for m in model.masks]
    return F.array(*[F.col(m).cast("int") if ok else F.lit(0) for m, ok in zip(model.masks, here, strict=True)])


def _kept_below(value: Column) -> Column:
    """The same value, marked so that no filter above is rewritten in terms of what lies below: a filter on
    a score would otherwise be pushed through all steps and copy each step's expression several times over."""
    return F.when(F.spark_partition_id() >= 0, value)


class Steps:
    """Rows that walk trees, one projection per step.

    ``rows`` has the table's columns and the states in hidden columns (``hidden``); ``ends`` are the places
    of the leaves in the node arrays and ``reliant`` the 0/1 reliance flags, one list per depth limit.
    Every row walks all trees, or only the tree that ``tree`` numbers.  Splits deeper than a limit
    do not count for reliance; after a null value the node's own flag still counts and nothing below does.
    """

    def __init__(self, df: DataFrame, trees: list[TreeModel], tree: Column | None = None, limits: tuple[int | None, ...] = ()):
        self.walk, self.prefix = Walk(trees), "_walk"
        while any(c.lower().startswith(self.prefix) for c in df.columns):
            self.prefix += "_"
        p, w, many = self.prefix, self.walk, range(1 if tree is not None else len(trees))
        start = {"f": w.feature, "t": w.threshold, "l": w.left, **self._values(df, bool(limits))}
        self.at = (lambda c, place: sparse.value_at(f"{p}{c}i", f"{p}{c}", place)) if w.model.sparse else (lambda c, place: f"get({p}{c}, {place})")
        for j, limit in enumerate(limits):
            start[f"c{j}"] = w.numbers(_by_node(lambda n, limit=limit: 0 if n.is_leaf or (limit is not None and n.depth > limit) else 1), "int")
        for i in many:
            start[f"n{i}"] = F.get(w.root, tree if tree is not None else F.lit(i))
            if limits:
                start[f"s{i}"] = F.lit(False)
            start |= {f"r{i}_{j}": F.lit(0) for j in range(len(limits))}
        step = {}
        for i in many:
            n, x = f"{p}n{i}", self.at("v", f"get({p}f, {p}n{i})")
            step[n] = F.expr(f"CASE WHEN get({p}l, {n}) < 0 THEN {n} WHEN {x} <= get({p}t, {n}) THEN get({p}l, {n}) ELSE get({p}l, {n}) + 1 END")
            if limits:
                step[f"{p}s{i}"] = F.expr(f"{p}s{i} OR (get({p}f, {n}) >= 0 AND {x} IS NULL)")
            for j in range(len(limits)):
                r = f"{p}r{i}_{j}"
                step[r] = F.expr(f"CASE WHEN get({p}c{j}, {n}) = 1 AND NOT {p}s{i} THEN greatest({r}, coalesce(CAST({self.at("m", f"get({p}f, {n})")} AS INT), 0)) ELSE {r} END")
        rows = df.withColumns({p + c: x for c, x in start.items()})
        for i in range(w.depth):
            rows = rows.withColumns(step if i < w.depth - 1 else {c: _kept_below(x) for c, x in step.items()})
        self.rows, self.hidden = rows, [p + c for c in start]
        self.ends = [F.col(f"{p}n{i}") for i in many]
        self.reliant = [[F.col(f"{p}r{i}_{j}") for i in many] for j in range(len(limits))]

    def _values(self, df: DataFrame, masks: bool) -> dict[str, Column]:
        """Columns of a row's values (``v``) and flags (``m``); places beside them where vectors are read by their entries."""
        model = self.walk.model
        if not model.sparse:
            return {"v": values_of(model)} | ({"m": masks_of(model, set(df.columns))} if masks else {})
        n = len(model.features)
        v = sparse.entries_of(df, model.array_col)
        wrong = F.raise_error(F.concat(F.lit(f"{model.array_col} must hold {n} features, found "), F.coalesce(v["n"].cast("string"), F.lit("null"))))
        out = {"v": F.when(v["n"] == n, v["v"]).otherwise(wrong.cast("array<double>")), "vi": v["i"]}
        if masks:
            m = None if model.array_mask_col is None else sparse.entries_of(df, model.array_mask_col)
            out |= {"m": F.lit(None).cast("array<double>") if m is None else m["v"], "mi": F.lit(None).cast("array<int>") if m is None else m["i"]}
        return out

    def with_columns(self, columns: dict[str, Column]) -> DataFrame:
        """The table with further columns, without the hidden ones."""
        return self.rows.select("*", *[c.alias(name) for name, c in columns.items()]).drop(*self.hidden)

    def numbers_at(self, value: Callable[[Node], object], kind: str, tree: int = 0) -> Column:
        """A number of the leaf that the row reached; null where it is None."""
        return F.nullif(F.get(self.walk.numbers(_by_node(value), kind), self.ends[tree]), F.lit(-1).cast(kind))

    def classes(self) -> list[Column]:
        return [self.numbers_at(lambda n: n.prediction if n.is_leaf else None, "int", i) for i in range(len(self.ends))]

    def node(self) -> Column:
        return self.numbers_at(lambda n: n.node, "bigint")

    def shares(self) -> Column:
        """Class shares of the leaf."""
        k = self.walk.model.n_classes
        flat = node_values([p for _, n in self.walk.flat for p in (n.probability if n.is_leaf else [0.0] * k)], "double")
        return F.slice(flat, self.ends[0] * k + 1, k)

    def path(self, max_depth: int | None = None, once: bool = False) -> Column:
        """Numbers of the features tested on the way to the leaf (``once``: without repeats)."""
        model, out = self.walk.model, []
        for _, n in self.walk.flat:
            tested = [model.nodes[a].feature_idx for a in model.path(n.node) if max_depth is None or model.nodes[a].depth <= max_depth]
            out.append((list(dict.fromkeys(tested)) if once else tested) if n.is_leaf else [])
        return F.get(F.from_json(F.lit(json.dumps(out)), "array<array<int>>"), self.ends[0])  # folded once


def _at_leaf(model: TreeModel, value: Callable[[Walk, Column], Column]) -> Column:
    w = Walk([model])
    return w.row(lambda v, _: value(w, w.end(v, F.lit(0))))


def _class_at(w: Walk, at: Column) -> Column:
    return F.nullif(F.get(w.numbers(_by_node(lambda n: n.prediction if n.is_leaf else None), "int"), at), F.lit(-1))


def predict_col(model: TreeModel) -> Column:
    """Class of the leaf (null for an empty tree)."""
    return _at_leaf(model, _class_at)


def leaf_col(model: TreeModel) -> Column:
    return _at_leaf(model, lambda w, at: F.get(w.numbers(_by_node(lambda n: n.node), "bigint"), at))


def proba_col(model: TreeModel) -> Column:
    k = model.n_classes

    def shares(w: Walk, at: Column) -> Column:
        flat = node_values([p for _, n in w.flat for p in (n.probability if n.is_leaf else [0.0] * k)], "double")
        return F.slice(flat, at * k + 1, k)

    return _at_leaf(model, shares)


def argmax_col(proba: Column) -> Column:
    """Index of the largest probability; a tie goes to the smallest class."""
    return (F.array_position(proba, F.array_max(proba)) - 1).cast("int")


def _paths(model: TreeModel, w: Walk, max_depth: int | None, once: bool) -> Column:
    """Per node the feature indices on the way to it, as texts like ``0,3,1``."""
    out = []
    for _, n in w.flat:
        tested = [model.nodes[a].feature_idx for a in model.path(n.node) if max_depth is None or model.nodes[a].depth <= max_depth]
        out.append(",".join(map(str, dict.fromkeys(tested) if once else tested)) if n.is_leaf else "")
    return _texts(out)


def _path_at(paths: Column, at: Column) -> Column:
    text = F.get(paths, at)
    return F.when(text == "", F.array().cast("array<int>")).otherwise(F.split(text, ",").cast("array<int>"))


def path_features_col(model: TreeModel, max_depth: int | None = None) -> Column:
    """Names of the features tested on the way to the leaf (the leaf itself excluded)."""
    names = _texts(model.features)
    return _at_leaf(model, lambda w, at: F.transform(_path_at(_paths(model, w, max_depth, False), at), lambda i: F.get(names, i)))


def reliance_col(
    model: TreeModel, max_depth: int | None = None, available: set[str] | None = None
) -> Column:
    """1 when the decision path tests a feature that is missing for the row, else 0.

    Nodes deeper than ``max_depth`` are not counted (``depth <= max_depth`` is, so 0 still
    counts the root).  When the tested value itself is null, the node's flag is added and
    the walk stops there.
    """
    w = Walk([model])
    return w.row(lambda v, m: w.reliant(v, m, F.lit(0), max_depth), available)


def transform(
    df: DataFrame,
    model: TreeModel,
    prediction: str | None = "prediction",
    probability: str | None = None,
    leaf: str | None = None,
    rho: str | None = None,
) -> DataFrame:
    """Append scoring columns; one narrow projection, no shuffle."""
    steps = Steps(df, [model], limits=(None,) if rho else ())
    columns = {}
    if prediction:
        columns[prediction] = steps.classes()[0]
    if probability:
        columns[probability] = steps.shares()
    if leaf:
        columns[leaf] = steps.node()
    if rho:
        columns[rho] = steps.reliant[0][0]
    return steps.with_columns(columns)


def decision_path(df: DataFrame, model: TreeModel, keep: list[str], max_depth: int | None = None) -> DataFrame:
    """(keep, step, feature): a row per feature tested on the way to the leaf."""
    steps = Steps(df, [model])
    long = steps.rows.select(*keep, F.posexplode(steps.path(max_depth)).alias("step", "_f"))
    return long.select(*keep, "step", F.get(_texts(model.features), F.col("_f")).alias("feature"))


def reliance_by_depth(df: DataFrame, model: TreeModel, max_depths: list[int | None], sample_mask: Column | None = None) -> DataFrame:
    """One row: ``rho0``, ``rho1``, ... for each depth limit, in one walk."""
    steps = Steps(df, [model], limits=tuple(max_depths))
    flags = [r[0] if sample_mask is None else F.when(sample_mask, r[0]).otherwise(F.lit(0)) for r in steps.reliant]
    return steps.rows.agg(*[F.coalesce(F.avg(r.cast("double")), F.lit(0.0)).alias(f"rho{i}") for i, r in enumerate(flags)])


def reliance(df: DataFrame, model: TreeModel, max_depth: int | None = None, sample_mask: Column | None = None) -> DataFrame:
    """One row: ``rho`` = share of rows whose path tests a feature missing for them.

    With ``sample_mask`` the masked-out rows count as 0 but stay in the denominator.
    An empty input gives 0.0.
    """
    return reliance_by_depth(df, model, [max_depth], sample_mask).withColumnRenamed("rho0", "rho")


def reliance_matrix(df: DataFrame, model: TreeModel, keys: list[str], max_depth: int | None = None) -> DataFrame:
    """Long reliance matrix: (keys, feature, missing) for each feature on the row's path.

    A feature tested twice on a path is one cell: repeats are dropped while the leaf's path is built,
    so rows need no grouping and rows with equal keys stay apart.
    """
    steps = Steps(df, [model], limits=(max_depth,))
    flags = [f"{steps.prefix}{c}" for c in ("m", "mi") if f"{steps.prefix}{c}" in steps.rows.columns]
    long = steps.rows.select(*keys, *flags, F.explode(steps.path(max_depth, once=True)).alias("_f"))
    missing = F.expr(f"coalesce(CAST({steps.at('m', '_f')} AS INT), 0)")
    return long.select(*keys, F.get(_texts(model.features), F.col("_f")).alias("feature"), missing.alias("missing"))


# ---- forests ---------------------------------------------------------------------------

#: Trees that a table is walked through by steps of generated code.
STEPPED_TREES = 64


def _each_tree(w: Walk, out: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(len(w.trees) - 1)), out)


def forest_votes_col(forest: ForestModel) -> Column:
    """Array of per-tree predicted classes (null for an empty tree)."""
    w = Walk(forest.trees)
    return w.row(lambda v, _: _each_tree(w, lambda t: _class_at(w, w.end(v, t))))


def vote_counts(votes: Column, n_classes: int) -> Column:
    """Votes per class; null votes do not count."""
    classes = F.sequence(F.lit(0), F.lit(max(1, n_classes) - 1))
    return F.transform(classes, lambda k: F.size(F.filter(votes, lambda v: v == k)))


def vote_col(votes: Column, n_classes: int) -> Column:
    """Majority of an array of class votes; a tie goes to the smallest class; null without votes."""
    counts = vote_counts(votes, n_classes)
    return F.when(F.array_max(counts) > 0, argmax_col(counts))


def vote_shares_col(forest: ForestModel) -> Column:
    return vote_shares(forest_votes_col(forest), forest.n_classes)


def vote_shares(votes: Column, n_classes: int) -> Column:
    """Share of the votes per class (zeros without votes)."""
    counts = vote_counts(votes, n_classes)
    total = F.aggregate(counts, F.lit(0), lambda a, c: a + c)
    return F.transform(counts, lambda c: c / F.greatest(total, F.lit(1)))


def forest_predict_col(forest: ForestModel) -> Column:
    if not forest.trees:
        return F.lit(None).cast("int")
    return vote_col(forest_votes_col(forest), forest.n_classes)


def mean_of(per_tree: list[Column]) -> Column:
    total = F.aggregate(F.array(*[F.coalesce(c, F.lit(0.0)) for c in per_tree]), F.lit(0.0), lambda a, c: a + c)
    return total / F.lit(float(len(per_tree)))


def forest_reliance_col(forest: ForestModel, available: set[str] | None = None) -> Column:
    """Share of the trees whose path for the row tests a missing feature; 0.0 without trees."""
    if not forest.trees:
        return F.lit(0.0)
    return _reliant_share(Walk(forest.trees), available)


def _reliant_share(w: Walk, available: set[str] | None) -> Column:
    flags = w.row(lambda v, m: _each_tree(w, lambda t: w.reliant(v, m, t, None)), available)
    return F.aggregate(flags, F.lit(0), lambda a, r: a + r) / F.lit(float(len(w.trees)))


def _sum(terms: list[Column]) -> Column:
    """A balanced sum, so that many terms do not nest deeply."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def forest_transform(df: DataFrame, forest: ForestModel, prediction: str | None = "prediction", probability: str | None = None, rho: str | None = None, votes: str | None = None) -> DataFrame:
    """Majority vote (a tie goes to the smallest class, null without votes), shares of the votes, share of the
    trees whose path tests a missing feature, and the array of votes.

    Up to ``STEPPED_TREES`` trees are walked by generated steps, a column per tree; more by one
    expression over the node arrays, so that the plan does not grow with the forest.  Results are equal.
    """
    if not forest.trees:
        empty = {prediction: F.lit(None).cast("int"), probability: F.array().cast("array<double>"), rho: F.lit(0.0), votes: F.array().cast("array<int>")}
        return df.select("*", *[c.alias(name) for name, c in empty.items() if name])
    if len(forest.trees) > STEPPED_TREES:
        w = Walk(forest.trees)
        made = {}
        if prediction or probability or votes:
            made["_votes"] = w.row(lambda v, _: _each_tree(w, lambda t: _class_at(w, w.end(v, t))))
        scored = df.withColumns(made) if made else df
        columns = {}
        if prediction:
            columns[prediction] = vote_col(F.col("_votes"), forest.n_classes)
        if probability:
            columns[probability] = vote_shares(F.col("_votes"), forest.n_classes)
        if rho:
            columns[rho] = _reliant_share(w, set(df.columns))
        if votes:
            columns[votes] = F.col("_votes")
        return scored.select("*", *[c.alias(name) for name, c in columns.items()]).drop(*made)
    steps = Steps(df, forest.trees, limits=(None,) if rho else ())
    p, n_trees = steps.prefix, len(forest.trees)
    classes, found = {f"{p}k{i}": c for i, c in enumerate(steps.classes())}, steps.rows
    found = found.withColumns(classes)
    counts = {f"{p}q{k}": _sum([F.when(F.col(c) == k, 1).otherwise(0) for c in classes]) for k in range(max(1, forest.n_classes))}
    found = found.withColumns(counts)
    q = F.array(*[F.col(c) for c in counts])
    columns = {}
    if prediction:
        columns[prediction] = F.when(F.array_max(q) > 0, argmax_col(q))
    if probability:
        columns[probability] = F.array(*[F.col(c) / F.greatest(_sum([F.col(x) for x in counts]), F.lit(1)) for c in counts])
    if rho:
        columns[rho] = _sum(steps.reliant[0]) / F.lit(float(n_trees))
    if votes:
        columns[votes] = F.array(*[F.col(c) for c in classes])
    return found.select("*", *[c.alias(name) for name, c in columns.items()]).drop(*steps.hidden, *classes, *counts)


def forest_reliance_by_tree(df: DataFrame, forest: ForestModel) -> DataFrame:
    """One row: ``rho_t0``, ``rho_t1``, ... per tree, in one pass over ``df``; 0.0 without rows."""
    steps = Steps(df, forest.trees, limits=(None,))
    return steps.rows.agg(*[F.coalesce(F.avg(r.cast("double")), F.lit(0.0)).alias(f"rho_t{i}") for i, r in enumerate(steps.reliant[0])])


def forest_reliance(df: DataFrame, forest: ForestModel) -> DataFrame:
    """Mean over trees of each tree's reliance, one pass over ``df``; 0.0 without trees or rows."""
    if not forest.trees:
        return df.agg(F.lit(0.0).alias("rho"))
    scored = forest_transform(df, forest, prediction=None, rho="_rho")
    return scored.agg(F.coalesce(F.avg("_rho"), F.lit(0.0)).alias("rho"))


def walk_forest(rows: DataFrame, forest: ForestModel) -> DataFrame:
    """Score rows that carry a tree index ``_t`` by that tree alone: adds ``_n`` (the leaf), ``_p``
    (its class) and ``_r`` (reliance)."""
    steps = Steps(rows, forest.trees, tree=F.col("_t"), limits=(None,))
    return steps.with_columns({"_n": steps.node(), "_p": steps.classes()[0], "_r": steps.reliant[0][0]})


def route(rows: DataFrame, models: list[TreeModel], nodes: list[tuple[int, int]]) -> DataFrame:
    """Rows with a tree index ``_t`` that reach one of the (tree, node) ``nodes``, with its place there as ``_i``."""
    steps, at = Steps(rows, models, tree=F.col("_t")), {x: i for i, x in enumerate(nodes)}
    ids = steps.walk.numbers(lambda t, n: at.get((t.tree, n.node)), "int")
    return steps.rows.withColumn("_i", F.get(ids, steps.ends[0])).filter("_i >= 0").drop(*steps.hidden)


def leaf_report(df: DataFrame, model: TreeModel, label: str = "label") -> DataFrame:
    """Per leaf of the scored table: rule text, rows, positives, positive share and reliance.

    One ``groupBy(leaf)`` with map-side partial aggregation; the rule text comes from a
    literal leaf -> text map (one entry per leaf).
    """
    rules = F.create_map(*[x for n in model.leaves() for x in (F.lit(n.node), F.lit(model.rule(n.node)))])
    steps = Steps(df, [model], limits=(None,))
    scored = steps.rows.select(steps.node().alias("leaf"), steps.reliant[0][0].alias("_r"), F.col(label).alias("_y"))
    out = scored.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).cast("bigint").alias("positives"),
        F.round(F.avg(F.col("_y").cast("double")), 6).alias("positive_share"),
        F.round(F.avg(F.col("_r").cast("double")), 6).alias("rho"),
    )
    return out.select("leaf", F.element_at(rules, F.col("leaf")).alias("rule"), "n", "positives", "positive_share", "rho")
