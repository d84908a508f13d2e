"""Benchmark: headline fits and scoring at $BENCH_SF_DIR on local[$BENCH_CPUS].

Mirrors the reference's experiments: the rows sweep (4 lineitem features, depth 4,
alpha 1, and 20 features at the largest size), the features sweep (embedding arrays tiled to 64 / 640 / 6400
features, and as set entries among 100,000; depth 4)
and the alpha sweep (5 alphas x 5 folds), plus a 10-tree forest and set-oriented scoring.
Each query: one warm-up, then the median of $BENCH_REPS runs.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from missaware.catalog import fixtures as fx  # noqa: E402
from missaware.catalog import fxmodel as fm  # noqa: E402
from missaware.catalog.registry import QUERIES  # noqa: E402
from missaware.operators import scoring  # noqa: E402
from missaware.plans.tree import FeatureSpec, FitParams, fit_forest  # noqa: E402
from missaware.session import local_session, table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPS = int(os.environ.get("BENCH_REPS", "3"))


def _sf(path: str) -> float | str:
    tail = os.path.basename(os.path.normpath(path))
    try:
        return float(tail.removeprefix("sf"))
    except ValueError:
        return tail


def fit_rows(spark, bins=None, sf_dir=None):
    df = fx.fx_a_prepared(spark, sf_dir or SF_DIR)
    spec = FeatureSpec.columns(df, fx.FX_A_FEATURES)
    fit_forest(df, spec, "label", FitParams(max_depth=4, alpha=1.0, bins=bins, partitions=int(CPUS)))


def fit_rows20(spark):
    """The published rows sweep has 20 features: the four of FX_A and 16 from the keys, some missing."""
    df = fx.fx_a_prepared(spark, SF_DIR)
    key = F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey") * 3
    more = {f"f{i}": (F.pmod(F.xxhash64(key, F.lit(i)), F.lit(40 + 20 * i)) + F.col("label") * (i % 3)).cast("double") for i in range(16)}
    masks = {f"missing_f{i}": (F.pmod(F.xxhash64(key, F.lit(100 + i)), F.lit(100)) < 2 * i).cast("int") for i in range(16)}
    df = df.withColumns(more | masks).withColumns({f"f{i}": F.when(F.col(f"missing_f{i}") == 1, 0.0).otherwise(F.col(f"f{i}")) for i in range(16)})
    spec = FeatureSpec.columns(df, fx.FX_A_FEATURES + list(more))
    fit_forest(df, spec, "label", FitParams(max_depth=4, alpha=1.0, partitions=int(CPUS)))


def fit_sparse(spark, size: int = 100_000):
    """The published features sweep ends at 100,000 features: embeddings as 64 set entries of so many."""
    e = table(spark, SF_DIR, "embeddings")
    places = F.transform("embedding", lambda x, i: (i * (size // 64) + F.pmod(F.xxhash64("vec_id", i), F.lit(size // 64))).cast("int"))
    flags = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") * 7 + i * 13) % 100 < 5 + (i * 3) % 35, 1.0).otherwise(0.0))
    values = F.transform("embedding", lambda x: x.cast("double"))
    struct = lambda v: F.struct(places.alias("i"), v.alias("v"), F.lit(size).alias("n"))
    df = e.select(struct(values).alias("x"), struct(flags).alias("m"), "label")
    fit_forest(df, FeatureSpec.vectors(df, "x", "m"), "label", FitParams(max_depth=4, alpha=1.0, partitions=int(CPUS)))


def fit_features(spark, tiles: int):
    e = table(spark, SF_DIR, "embeddings")
    vid = F.col("vec_id")
    wide = F.flatten(F.array_repeat(F.transform("embedding", lambda x: x.cast("double")), tiles))
    mask = F.transform(wide, lambda x, i: F.when((vid * 7 + i * 13) % 100 < 5 + (i * 3) % 35, 1).otherwise(0))
    df = e.select(wide.alias("features"), mask.alias("missing"), "label")
    spec = FeatureSpec.array(df, "features", "missing")
    fit_forest(df, spec, "label", FitParams(max_depth=4, alpha=1.0, bins=32, partitions=int(CPUS)))


def fit_forest10(spark):
    df = fx.fx_a_prepared(spark, SF_DIR)
    spec = FeatureSpec.columns(df, fx.FX_A_FEATURES)
    fit_forest(df, spec, "label", FitParams(max_depth=4, alpha=1.0, partitions=int(CPUS)), n_trees=10, bootstrap=True, key_cols=fx.FX_A_KEYS)


def alpha_sweep(spark):
    QUERIES["sweep_summary"](spark, SF_DIR).collect()


def alpha_sweep_d4(spark):
    QUERIES["alpha_sweep_trees"](spark, SF_DIR).collect()


def score(spark):
    df = fx.fx_a_prepared(spark, SF_DIR)
    scored = scoring.transform(df, fm.fx_m(), prediction="p", rho="r")
    scored.agg(F.avg((F.col("p") == F.col("label")).cast("double")), F.avg(F.col("r").cast("double"))).collect()


SMALLER = [d for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01") if os.path.isdir(d) and os.path.normpath(d) != os.path.normpath(SF_DIR)]

BENCH = {
    # rows sweep (the reference's first experiment): the same fit at growing scale factors
    **{f"fit_rows_d4_exact_{os.path.basename(d)}": (lambda s, d=d: fit_rows(s, sf_dir=d)) for d in SMALLER},
    "fit_rows_d4_exact": lambda s: fit_rows(s),
    "fit_rows_d4_binned32": lambda s: fit_rows(s, bins=32),
    "fit_rows_20_features_d4_exact": fit_rows20,
    "fit_features_64": lambda s: fit_features(s, 1),
    "fit_features_640": lambda s: fit_features(s, 10),
    "fit_features_6400": lambda s: fit_features(s, 100),
    "fit_sparse_features_100000": fit_sparse,
    "fit_forest_10x_d4": fit_forest10,
    "alpha_sweep_5x5": alpha_sweep,
    "alpha_sweep_5x5_d4": alpha_sweep_d4,
    "score_predict_rho": score,
}


def main():
    spark = local_session(CPUS, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    sc = spark.sparkContext
    only = set(sys.argv[1:])
    times, jobs = {}, {}
    for name, fn in BENCH.items():
        if only and name not in only:
            continue
        fn(spark)  # warm-up
        runs = []
        for i in range(REPS):
            group = f"{name}-{i}"
            sc.setJobGroup(group, name)
            t0 = time.perf_counter()
            fn(spark)
            runs.append(time.perf_counter() - t0)
            jobs[name] = len(sc.statusTracker().getJobIdsForGroup(group))
        times[name] = round(statistics.median(runs), 3)
    sweep = {}
    if not only or "alpha_sweep_5x5_d4" in only:
        # the reference's third experiment: accuracy and reliance per alpha, depth 4
        for r in QUERIES["alpha_sweep_trees"](spark, SF_DIR).orderBy("alpha").collect():
            sweep[str(r["alpha"])] = {"accuracy": r["accuracy_mean"], "rho": r["rho_mean"]}
    out = {
        "metric": "median_seconds_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "spark_jobs": jobs,
        "alpha_sweep": sweep,
        "sf": _sf(SF_DIR),
        "cpus": CPUS,
        "reps": REPS,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
