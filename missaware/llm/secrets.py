"""Secret scan with corpus-wide ownership frequency.

Candidates are regular-expression matches with their code-point spans.  The three base kinds
(``assign``, ``access``, ``hex``) are always reported.  Two more kinds (``vendor``: key formats of
well-known services, web tokens and passwords in URLs; ``opaque``: long mixed-case runs with
digits) are only reported where the corpus says so: the hash of every candidate's value is
aggregated by distinct owners (sources) and repositories (distinct texts, as documents name no
other).  A text that several sources copy has one owner, the smallest.  A value that many owners
share, or that many distinct texts of one owner hold, is an example copied around, while a
varied value that one or two owners hold in few texts looks live.

Positions need no Python: a text cut at a pattern gives the gaps between its matches, and the
running sum of gaps and match lengths gives each start.  The text is read once; what follows works
on the candidates alone.

Defined results: a null text is empty; null ids and repeated rows are rows of their own; a null
source is an owner of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missaware.llm.common import text_or_empty, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group that is the value, least length of that group; the first three are the base.
KINDS = [
    ("assign", ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    (
        "vendor",
        r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}"
        r"|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}"
        r"|://[^\s/:@]{1,256}:[^\s/@]{1,256}@",
        0,
        12,
    ),
    ("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+={0,2}", 0, 32),
]
BASE = 3
#: A value is a copied example from this many owners on, or this many distinct texts of one owner.
EXAMPLE_OWNERS = 3
EXAMPLE_TEXTS = 10
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|\*\*\*\*|(.)\1{7}"


def _hits(text: Column, k: int, pattern: str) -> Column:
    """Array of (kind, number, gap before the match, match); empty where nothing matches."""
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.lit(k).alias("kind"), F.length(g).alias("gap"), m.alias("match")))
    none = F.array().cast("array<struct<kind:int,gap:int,match:string>>")
    return F.when(text.rlike(pattern), zipped).otherwise(none)


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """One row per document: ``row, doc, owner, repo, hits``."""
    text = text_or_empty(F.col(text_col))
    hits = F.concat(*[_hits(text, k, pattern) for k, (_, pattern, _, _) in enumerate(KINDS)])
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc"),
        F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("owner"),
        F.xxhash64(text).alias("repo"),
        hits.alias("hits"),
    )


def spans(rows: DataFrame) -> DataFrame:
    """One row per candidate that is long enough: ``row, owner, repo, kind, start, end, value``."""
    one = rows.filter(F.size("hits") > 0).select("row", "owner", "repo", F.posexplode("hits").alias("i", "hit")).select("row", "owner", "repo", "i", "hit.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match")
    one = one.withColumn("end", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("end") - size)
    value, least = F.col("match"), F.lit(0)
    for k, (_, pattern, group, at_least) in enumerate(KINDS):
        if group:
            value = F.when(F.col("kind") == k, F.regexp_extract("match", pattern, group)).otherwise(value)
        least = F.when(F.col("kind") == k, at_least).otherwise(least)
    return one.withColumn("value", value).filter(F.length("value") >= least).select("row", "owner", "repo", "kind", "start", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """One row per value hash: ``hash, owners, repos`` (the most distinct texts of an owner), in three
    aggregations that all combine early.  Copies of a text hold the same values, so its owner is the same for each."""
    texts = found.groupBy("hash", "repo").agg(F.min("owner").alias("owner"))
    owned = texts.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owned.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.max("repos").alias("repos"))


def _varied(value: Column) -> Column:
    """Letters and digits, enough different characters, no placeholder."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= 8) & ~value.rlike(PLACEHOLDER)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_texts: int = EXAMPLE_TEXTS) -> DataFrame:
    """Per document the reported spans and their class counts; see ``op10`` for the columns.

    ``found`` is an array of (start, kind, end, live): ``live`` marks owner-specific values.
    """
    rows = written(candidates(docs, id_col, text_col, owner_col), "secrets-rows")
    found = spans(rows).withColumn("hash", F.sha2("value", 256)).withColumn("varied", _varied(F.col("value"))).drop("value")
    found = written(found, "secrets-found")
    judged = found.join(ownership(found), "hash")  # a value on very many rows is split by the skew join
    judged = judged.withColumn("live", F.col("varied") & (F.col("owners") < example_owners) & (F.col("repos") < example_texts))
    # an added span must not touch a base span: look at the furthest base end before it and the
    # nearest base start after it (read backwards, so both sums run on)
    before = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("kind") < BASE
    judged = judged.withColumn("b", F.max(F.when(base, F.col("end"))).over(before)).withColumn("a", F.min(F.when(base, F.col("start"))).over(after))
    clear = (F.col("b").isNull() | (F.col("b") <= F.col("start"))) & (F.col("a").isNull() | (F.col("a") >= F.col("end")))
    mixed = F.col("live") & clear
    kept = judged.filter(base | mixed).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("found"))
    none = F.array().cast(kept.schema["found"].dataType)
    return rows.drop("hits").join(kept, "row", "left").select(F.col("doc").alias(id_col), F.coalesce("found", none).alias("found"))


def _joined(found: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def op10(spark, sf_dir):
    got = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = F.col("found")
    count = lambda test: F.size(F.filter(found, test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k  # noqa: E731  (a second parameter, even one with a default, would be the place)
    kinds = [count(of_kind(k)).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS[:BASE])]
    base = F.sha2(_joined(F.filter(found, lambda s: s["kind"] < BASE)).cast("binary"), 256)
    return got.select(
        "doc_id", *kinds, base.alias("base_sha256"), _joined(found).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_example"),
    )
