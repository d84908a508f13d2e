"""Fixtures over the given tables, as Spark DataFrames and as the equivalent SQL text.

The test tables have no nulls, so missingness is injected by integer arithmetic on keys
that Spark and DuckDB compute alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missaware.operators import prep
from missaware.session import table

# ---- FX_A: lineitem, binary label with signal, four features ---------------------------
FX_A_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
FX_A_FEATURES = ["quantity", "discount", "tax", "price_k"]

FX_A_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN (l_orderkey*7 + l_linenumber*13 + l_partkey*3) % 100 < 30 THEN NULL ELSE l_quantity END AS quantity,
  CASE WHEN (l_orderkey*11 + l_linenumber*5 + l_partkey*17) % 100 < 10 THEN NULL ELSE l_discount END AS discount,
  CASE WHEN (l_orderkey*3 + l_linenumber*29 + l_suppkey*7) % 100 < 20 THEN NULL ELSE l_tax END AS tax,
  CASE WHEN (l_orderkey*13 + l_linenumber*19 + l_suppkey*11) % 100 < 5 THEN NULL
       ELSE CAST(floor(l_extendedprice/1000) AS DOUBLE) END AS price_k,
  CASE WHEN l_quantity*(1 - l_discount*4) > 20 THEN 1 ELSE 0 END AS label
FROM lineitem"""


def _null_if(cond, value):
    return F.when(cond, F.lit(None).cast("double")).otherwise(value.cast("double"))


def fx_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_a_from(table(spark, sf_dir, "lineitem"))


def fx_a_from(li: DataFrame) -> DataFrame:
    """FX_A over any lineitem DataFrame (batch or streaming)."""
    ok, ln, pk, sk = (F.col(c) for c in FX_A_KEYS)
    return li.select(
        *FX_A_KEYS,
        _null_if((ok * 7 + ln * 13 + pk * 3) % 100 < 30, F.col("l_quantity")).alias("quantity"),
        _null_if((ok * 11 + ln * 5 + pk * 17) % 100 < 10, F.col("l_discount")).alias("discount"),
        _null_if((ok * 3 + ln * 29 + sk * 7) % 100 < 20, F.col("l_tax")).alias("tax"),
        _null_if(
            (ok * 13 + ln * 19 + sk * 11) % 100 < 5, F.floor(F.col("l_extendedprice") / 1000)
        ).alias("price_k"),
        F.when(F.col("l_quantity") * (1 - F.col("l_discount") * 4) > 20, 1).otherwise(0).alias("label"),
    )


def fx_a_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.prepare(fx_a(spark, sf_dir), FX_A_FEATURES, impute="zero")


# ---- FX_B: orders join customer, three classes -----------------------------------------
FX_B_FEATURES = ["total_5k", "bal_100", "nation"]

FX_B_SQL = """SELECT o_orderkey,
  CASE WHEN (o_orderkey*7 + o_custkey*3) % 100 < 25 THEN NULL ELSE CAST(floor(o_totalprice/5000) AS DOUBLE) END AS total_5k,
  CASE WHEN (o_orderkey*11 + o_custkey*17) % 100 < 10 THEN NULL ELSE CAST(floor(c_acctbal/100) AS DOUBLE) END AS bal_100,
  CASE WHEN (o_orderkey*3 + o_custkey*29) % 100 < 40 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS nation,
  CASE WHEN o_totalprice < 150000 THEN 0 WHEN o_totalprice + c_acctbal*10 < 320000 THEN 1 ELSE 2 END AS label
FROM orders JOIN customer ON o_custkey = c_custkey"""


def fx_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    price, bal = F.col("o_totalprice"), F.col("c_acctbal")
    return j.select(
        "o_orderkey",
        _null_if((ok * 7 + ck * 3) % 100 < 25, F.floor(price / 5000)).alias("total_5k"),
        _null_if((ok * 11 + ck * 17) % 100 < 10, F.floor(bal / 100)).alias("bal_100"),
        _null_if((ok * 3 + ck * 29) % 100 < 40, F.col("c_nationkey")).alias("nation"),
        F.when(price < 150000, 0).when(price + bal * 10 < 320000, 1).otherwise(2).alias("label"),
    )


def fx_b_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.prepare(fx_b(spark, sf_dir), FX_B_FEATURES, impute="zero")


# ---- FX_C: events, weighted, label without signal --------------------------------------
FX_C_FEATURES = ["user_num", "hour_num"]

FX_C_SQL = """SELECT event_id, value,
  CASE WHEN (event_id*7 + user_id*3) % 100 < 15 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS user_num,
  CASE WHEN (event_id*11 + user_id*5) % 100 < 35 THEN NULL ELSE CAST(hour(ts) AS DOUBLE) END AS hour_num,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
  CAST(1 + event_id % 3 AS DOUBLE) AS sample_weight
FROM events"""


def fx_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    return e.select(
        "event_id",
        "value",
        _null_if((eid * 7 + uid * 3) % 100 < 15, uid).alias("user_num"),
        _null_if((eid * 11 + uid * 5) % 100 < 35, F.hour("ts")).alias("hour_num"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("label"),
        (1 + eid % 3).cast("double").alias("sample_weight"),
    )


def fx_c_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.prepare(fx_c(spark, sf_dir), FX_C_FEATURES, impute="zero")


# ---- FX_D: embeddings as wide array features, ten classes ------------------------------
def fx_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id``, ``embedding`` ARRAY<DOUBLE>, ``missing`` ARRAY<INT>, ``label``.

    Position i is missing where ``(vec_id*7 + i*13) % 100 < 5 + (i*3) % 35``; masked
    positions are zero-imputed.
    """
    e = table(spark, sf_dir, "embeddings")
    vid = F.col("vec_id")
    mask = F.transform(
        F.col("embedding"),
        lambda x, i: F.when((vid * 7 + i * 13) % 100 < 5 + (i * 3) % 35, 1).otherwise(0),
    )
    values = F.zip_with(
        F.transform(F.col("embedding"), lambda x: x.cast("double")),
        mask,
        lambda x, m: F.when(m == 1, F.lit(0.0)).otherwise(x),
    )
    return e.select("vec_id", values.alias("embedding"), mask.alias("missing"), "label")


# ---- FX_F: Poisson(1) bootstrap draw per (lineitem row, tree) ---------------------------
FX_F_MULTS = {"l_orderkey": 48271, "l_linenumber": 69621, "l_partkey": 16807}
FX_F_TREE_MULT = 40692
FX_F_MODULUS = 2147483


def fx_f_u(tree_col):
    acc = (
        F.col("l_orderkey") * FX_F_MULTS["l_orderkey"]
        + F.col("l_linenumber") * FX_F_MULTS["l_linenumber"]
        + F.col("l_partkey") * FX_F_MULTS["l_partkey"]
        + tree_col.cast("bigint") * FX_F_TREE_MULT
    )
    return (acc % FX_F_MODULUS) / F.lit(float(FX_F_MODULUS))


def fx_f_u_sql(tree: str) -> str:
    return (
        f"((l_orderkey*{FX_F_MULTS['l_orderkey']} + l_linenumber*{FX_F_MULTS['l_linenumber']}"
        f" + l_partkey*{FX_F_MULTS['l_partkey']} + {tree}*{FX_F_TREE_MULT}) % {FX_F_MODULUS})"
        f" / {float(FX_F_MODULUS)!r}"
    )


# ---- prepared-table SQL (mask then zero imputation) ------------------------------------
def prepared_sql(raw_sql: str, keys: list[str], features: list[str], extra: list[str] | None = None, impute: str = "zero") -> str:
    cols = list(keys)
    for f in features:
        if impute == "zero":
            cols.append(f"COALESCE({f}, CAST(0.0 AS DOUBLE)) AS {f}")
        elif impute == "mean":
            cols.append(f"COALESCE({f}, (SELECT avg({f}) FROM raw)) AS {f}")
        else:
            cols.append(f)
    cols += [f"CAST({f} IS NULL AS INTEGER) AS missing_{f}" for f in features]
    cols += list(extra or []) + ["label"]
    return f"WITH raw AS ({raw_sql}) SELECT {', '.join(cols)} FROM raw"


FX_A_PREP_SQL = prepared_sql(FX_A_SQL, FX_A_KEYS, FX_A_FEATURES)
FX_B_PREP_SQL = prepared_sql(FX_B_SQL, ["o_orderkey"], FX_B_FEATURES)
FX_C_PREP_SQL = prepared_sql(FX_C_SQL, ["event_id", "value"], FX_C_FEATURES, extra=["sample_weight"])
