"""Estimator surface as ``pyspark.ml`` Estimators and Models (usable in Pipelines).

    clf = MissAwareTreeClassifier(featureCols=[...], labelCol="label", maxDepth=4, alpha=0.1)
    model = clf.fit(train)              # one Spark job per depth
    scored = model.transform(test)      # adds prediction / probability / rho columns
    model.reliance(test)                # one-row DataFrame: share of rows relying on missing values

Array features (``featuresCol`` of ``ARRAY<DOUBLE>``, ``missingnessCol`` of ``ARRAY<INT>``, or MLlib
vectors for either) are the wide-table variant; with ``sparseFeatures`` vectors are read by their entries
that are not 0, without an array of all features; predictions are DOUBLE as MLlib evaluators expect;
estimators and models have ``save`` / ``load`` and ``write`` / ``read``; ``maxBins`` switches to quantile-binned split search.
``impurity`` ("gini" / "entropy") is accepted as the MLlib name of ``criterion``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missaware.functions.sparse import is_vector
from missaware.operators import prep, scoring
from missaware.operators.splits import NearEqual
from missaware.plans.model import ForestModel, TreeModel
from missaware.plans.tree import FeatureSpec, FitParams, fit_forest
from missaware.sources.models import load_forest, save_forest

_IMPURITY = {"gini": "gini", "entropy": "info_gain", "info_gain": "info_gain"}


def _p(name: str, doc: str, conv) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=conv)


class _OutputParams(Params):
    predictionCol = _p("predictionCol", "prediction column", TypeConverters.toString)
    probabilityCol = _p("probabilityCol", "class probability column (empty: none)", TypeConverters.toString)
    missingnessRelianceCol = _p("missingnessRelianceCol", "per-row reliance column (empty: none)", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(predictionCol="prediction", probabilityCol="probability", missingnessRelianceCol="rho")


class _TreeParams(_OutputParams):
    featureCols = _p("featureCols", "feature columns; default every column but label, weight and masks", TypeConverters.toListString)
    labelCol = _p("labelCol", "label column with classes 0..K-1", TypeConverters.toString)
    weightCol = _p("weightCol", "row weight column; default sample_weight if present, else 1", TypeConverters.toString)
    maskPrefix = _p("maskPrefix", "prefix of the 0/1 missingness columns", TypeConverters.toString)
    featuresCol = _p("featuresCol", "ARRAY<DOUBLE> features column (wide variant)", TypeConverters.toString)
    missingnessCol = _p("missingnessCol", "ARRAY<INT> mask column of featuresCol", TypeConverters.toString)
    sparseFeatures = _p("sparseFeatures", "read vectors in featuresCol and missingnessCol by their entries that are not 0", TypeConverters.toBoolean)
    maxDepth = _p("maxDepth", "maximum depth (>= 1)", TypeConverters.toInt)
    alpha = _p("alpha", "missingness penalty strength (>= 0)", TypeConverters.toFloat)
    criterion = _p("criterion", "gini or info_gain", TypeConverters.toString)
    impurity = _p("impurity", "MLlib name of criterion: gini or entropy", TypeConverters.toString)
    maxBins = _p("maxBins", "quantile bins per feature (0: exact split search)", TypeConverters.toInt)
    exactBins = _p("exactBins", "exact percentiles for bin edges (off: approximate ones)", TypeConverters.toBoolean)
    mergeEqualSiblings = _p("mergeEqualSiblings", "merge sibling leaves with equal class shares", TypeConverters.toBoolean)
    penalty = _p("penalty", "weighted or row_mean missing share", TypeConverters.toString)
    nearEqualRtol = _p("nearEqualRtol", "skip cuts between near-equal values (with nearEqualAtol; <0: off)", TypeConverters.toFloat)
    nearEqualAtol = _p("nearEqualAtol", "absolute tolerance for near-equal values", TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(
            labelCol="label", maskPrefix=prep.MASK_PREFIX, maxDepth=3, alpha=1.0, criterion="gini",
            maxBins=0, exactBins=True, mergeEqualSiblings=False, penalty="weighted",
            nearEqualRtol=-1.0, nearEqualAtol=1e-8, sparseFeatures=False,
        )

    def _opt(self, p: Param):
        return self.getOrDefault(p) if self.isDefined(p) else None

    def fit_params(self) -> FitParams:
        crit = self.getOrDefault(self.criterion)
        if self.isSet(self.impurity):
            crit = self.getOrDefault(self.impurity)
            if crit not in _IMPURITY:
                raise ValueError(f"impurity must be gini or entropy, got {crit!r}")
            crit = _IMPURITY[crit]
        rtol = self.getOrDefault(self.nearEqualRtol)
        params = FitParams(
            max_depth=self.getOrDefault(self.maxDepth),
            alpha=self.getOrDefault(self.alpha),
            criterion=crit,
            near_equal=NearEqual(rtol, self.getOrDefault(self.nearEqualAtol)) if rtol >= 0 else None,
            penalty=self.getOrDefault(self.penalty),
            merge_equal_siblings=self.getOrDefault(self.mergeEqualSiblings),
            bins=self.getOrDefault(self.maxBins) or None,
            exact_bins=self.getOrDefault(self.exactBins),
        )
        params.validate()
        return params

    def weight_of(self, df: DataFrame) -> str | None:
        w = self._opt(self.weightCol)
        if w:
            return w
        return "sample_weight" if "sample_weight" in df.columns else None

    def arrays(self, df: DataFrame) -> DataFrame:
        """The input with vector columns as arrays, unless they are read by their entries."""
        if self.getOrDefault(self.sparseFeatures):
            return df
        return df.withColumns({c: vector_to_array(c) for c in (self._opt(self.featuresCol), self._opt(self.missingnessCol)) if c and is_vector(df, c)})

    def spec_of(self, df: DataFrame) -> FeatureSpec:
        arr = self._opt(self.featuresCol)
        if arr and self.getOrDefault(self.sparseFeatures):
            return FeatureSpec.vectors(df, arr, self._opt(self.missingnessCol))
        if arr:
            return FeatureSpec.array(df, arr, self._opt(self.missingnessCol))
        label = self.getOrDefault(self.labelCol)
        prefix = self.getOrDefault(self.maskPrefix)
        feats = self._opt(self.featureCols) or prep.discover_features(df, label, self.weight_of(df) or "sample_weight", prefix)
        return FeatureSpec.columns(df, feats, prefix)


class MissAwareTreeClassifier(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Missingness-avoiding decision tree (CART split search with a missing-share penalty)."""

    @keyword_only
    def __init__(self, *, featureCols=None, labelCol="label", weightCol=None, maskPrefix="missing_",
                 featuresCol=None, missingnessCol=None, sparseFeatures=None, maxDepth=3, alpha=1.0, criterion="gini",
                 impurity=None, maxBins=0, exactBins=True, mergeEqualSiblings=False, penalty="weighted",
                 nearEqualRtol=-1.0, nearEqualAtol=1e-8, predictionCol="prediction",
                 probabilityCol="probability", missingnessRelianceCol="rho"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.fit_params()

    def _fit(self, dataset: DataFrame) -> "TreeClassifierModel":
        dataset = self.arrays(dataset)
        models = fit_forest(dataset, self.spec_of(dataset), self.getOrDefault(self.labelCol), self.fit_params(), weight=self.weight_of(dataset))
        return self._copyValues(TreeClassifierModel(models[0]))


class MissAwareForestClassifier(Estimator, _TreeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Bagged missingness-avoiding trees; all trees grow together, one job per depth."""

    numTrees = _p("numTrees", "number of trees", TypeConverters.toInt)
    bootstrap = _p("bootstrap", "Poisson(1) bootstrap weights per tree", TypeConverters.toBoolean)
    seed = _p("seed", "seed of the bootstrap draws", TypeConverters.toInt)
    keyCols = _p("keyCols", "columns identifying a row (for the bootstrap draw)", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, numTrees=100, bootstrap=True, seed=0, keyCols=None, featureCols=None, labelCol="label",
                 weightCol=None, maskPrefix="missing_", featuresCol=None, missingnessCol=None, sparseFeatures=None, maxDepth=10,
                 alpha=1.0, criterion="gini", impurity=None, maxBins=0, exactBins=True,
                 mergeEqualSiblings=False, penalty="weighted", nearEqualRtol=-1.0, nearEqualAtol=1e-8,
                 predictionCol="prediction", probabilityCol="probability", missingnessRelianceCol="rho"):
        super().__init__()
        self._setDefault(numTrees=100, bootstrap=True, seed=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self.fit_params()

    def _fit(self, dataset: DataFrame, bootstrap_u=None) -> "ForestClassifierModel":
        dataset = self.arrays(dataset)
        models = fit_forest(
            dataset,
            self.spec_of(dataset),
            self.getOrDefault(self.labelCol),
            self.fit_params(),
            weight=self.weight_of(dataset),
            n_trees=self.getOrDefault(self.numTrees),
            bootstrap=self.getOrDefault(self.bootstrap),
            seed=self.getOrDefault(self.seed),
            key_cols=self._opt(self.keyCols),
            bootstrap_u=bootstrap_u,
        )
        return self._copyValues(ForestClassifierModel(ForestModel(models)))


class _ModelWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        save_forest(self.sparkSession, self.instance.as_forest(), f"{path}/model")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = self.cls.of_forest(load_forest(self.sparkSession, f"{path}/model"))
        out._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(out, metadata)
        return out


class _FittedModel(Model, _OutputParams, MLWritable, MLReadable):
    """Scoring columns for tree and forest models; one narrow projection."""

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)

    def _array_model(self, dataset: DataFrame):
        """(dataset, forest, extra columns): vector columns read through array columns beside them."""
        forest = self.as_forest()
        first = forest.trees[0] if forest.trees else None
        used = [c for c in (first.array_col, first.array_mask_col) if c] if first and not first.sparse else []
        beside = {c: f"_array_{c}" for c in used if is_vector(dataset, c)}
        if not beside:
            return dataset, forest, []
        dataset = dataset.withColumns({new: vector_to_array(c) for c, new in beside.items()})
        trees = [replace(t, array_col=beside.get(t.array_col, t.array_col), array_mask_col=beside.get(t.array_mask_col, t.array_mask_col)) for t in forest.trees]
        return dataset, ForestModel(trees), list(beside.values())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows, forest, extra = self._array_model(dataset)
        names = [self.getOrDefault(p) for p in (self.predictionCol, self.probabilityCol, self.missingnessRelianceCol)]
        out = self.scored(rows, forest, *names)
        return (out.withColumn(names[0], F.col(names[0]).cast("double")) if names[0] else out).drop(*extra)

    def node_table(self, spark) -> DataFrame:
        return self.as_forest().node_table(spark)


class TreeClassifierModel(_FittedModel):
    def __init__(self, model: TreeModel):
        super().__init__()
        self.model = model

    @classmethod
    def of_forest(cls, forest: ForestModel) -> "TreeClassifierModel":
        return cls(forest.trees[0])

    def as_forest(self) -> ForestModel:
        return ForestModel([self.model])

    def scored(self, rows: DataFrame, forest: ForestModel, prediction: str, probability: str, rho: str) -> DataFrame:
        return scoring.transform(rows, forest.trees[0], prediction, probability, rho=rho)

    def reliance(self, df: DataFrame, max_depth: int | None = None, sample_mask=None) -> DataFrame:
        rows, forest, _ = self._array_model(df)
        return scoring.reliance(rows, forest.trees[0], max_depth=max_depth, sample_mask=sample_mask)


class ForestClassifierModel(_FittedModel):
    """Majority vote; the probability is the share of votes, ``rho`` the share of trees whose path
    tests a missing feature."""

    def __init__(self, forest: ForestModel):
        super().__init__()
        self.forest = forest

    @classmethod
    def of_forest(cls, forest: ForestModel) -> "ForestClassifierModel":
        return cls(forest)

    def as_forest(self) -> ForestModel:
        return self.forest

    def scored(self, rows: DataFrame, forest: ForestModel, prediction: str, probability: str, rho: str) -> DataFrame:
        return scoring.forest_transform(rows, forest, prediction, probability, rho)

    def reliance(self, df: DataFrame) -> DataFrame:
        rows, forest, _ = self._array_model(df)
        return scoring.forest_reliance(rows, forest)


def accuracy(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return scored.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))
