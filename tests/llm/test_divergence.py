import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_fixtures import no_docs, odd_docs  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from missaware.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs=3, first=200):
    """The audit of (lang, source, text) rows with Python's whole numbers."""
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= min_docs]
        v = len(kept)
        whole, by = Counter(), defaultdict(Counter)
        for _, s, ts in own:
            by[s]  # every group counts
            for t in ts:
                if df[t] >= min_docs:
                    by[s][t] += 1
                    whole[t] += 1

        def share(counts, t):
            return 1 + 10**9 * (counts[t] + 1) // (sum(counts.values()) + v)

        p = {s: {t: share(c, t) for t in kept} for s, c in by.items()}
        q = {t: share(whole, t) for t in kept}
        for s in by:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in by if o != s]
            own_terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", own_terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, i, f, r) for r, (f, i) in enumerate(items, 1) if part == "pair" or r <= first}
    return out


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed, n, sources, langs=("en", "de")):
    rng = random.Random(seed)
    words = [a + b for a in ("ba", "é", "Zo", "ñu", "x") for b in ("", "ka", "Ri", "日", "öö", "no")]
    rows = []
    for _ in range(n):
        s = rng.randrange(sources)
        rows.append((rng.choice(langs), f"s{s}", " ".join(rng.choice(words[: 5 + (s * 7) % 25]) + rng.choice(["", ".", " 7", "-"]) for _ in range(rng.randrange(30)))))
    return rows


@pytest.mark.parametrize("first", [1, 3, 200])
def test_audit_equals_brute_force(spark, first):
    rows = corpus(1, 300, 6) + [("en", "empty", None), ("en", "empty", "12 34"), (None, None, "only here twice"), ("", "s1", "only here twice"), ("xx", "a", "rare"), ("xx", "b", "word"), ("yy", "one", "w w w")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert got(divergence.audit(df, first=first)) == brute(rows, first=first)


def test_audit_in_many_buckets_and_blocks(spark, monkeypatch):
    for name, value in (("TERMS", 3), ("SOURCES", 2), ("MERGE", 3), ("CHUNK", 5), ("STEP", 3), ("CELLS", 40), ("HELD", 20), ("PIECE", 16)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(2, 250, 7)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    assert got(divergence.audit(df, first=4)) == brute(rows, first=4)


@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 9)), max_size=250), st.integers(1, 7), st.integers(1, 100), st.sampled_from([(256, 1 << 20), (7, 1 << 20), (16, 0), (5, 30)]))
@settings(max_examples=200, deadline=None)
def test_band_is_the_skyband(points, k, step, data):
    before = divergence.STEP, divergence.CELLS
    band, kept = divergence.Band(k), []
    divergence.STEP, divergence.CELLS = data
    for i in range(0, len(points), step):
        high, low = (np.array([p[j] for p in points[i : i + step]], np.int64) for j in (0, 1))
        kept += (band.add(high, low) + i).tolist()
    want = [i for i, (g, x) in enumerate(points) if sum(a >= g and b <= x for a, b in points[:i]) < k]
    divergence.STEP, divergence.CELLS = before
    assert kept == want


@given(st.integers(0, 10**12), st.integers(0, 10**15))
@settings(max_examples=200, deadline=None)
def test_shares_are_exact(count, more):
    total = count + 1 + more
    assert int(divergence.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total


def test_share_columns_are_exact(spark):
    from pyspark.sql import functions as F

    rows = [(c, c + 1 + t) for c in (0, 1, 7, 10**9, 10**12 + 7) for t in (0, 1, 12345, 10**15 + 3)]
    out = spark.createDataFrame(rows, "c long, t long").select("c", "t", divergence.share(F.col("c"), F.col("t")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 1) // r["t"] for r in out)


def test_audit_of_odd_documents(spark, odd_docs, no_docs):
    rows = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
    assert got(divergence.audit(odd_docs)) == brute(rows)
    assert divergence.audit(no_docs).count() == 0


def test_terms_of_long_texts_are_whole(monkeypatch):
    text = ("Abc déf " * 50 + "x" * 100).encode()
    want = text.translate(divergence.LETTERS).split()
    monkeypatch.setattr(divergence, "PIECE", 7)
    assert [t for some in divergence.terms(text) for t in some] == want


def test_tally_equals_plain_counts(monkeypatch):
    import pyarrow as pa

    rows = corpus(3, 120, 4) + [("en", "s0", t) for t in ("", "Ab", "cd", "", "7", "x", "x x", "é", "é")] + [("zz", "none", ""), ("zz", "last", " 1 ")]
    rows = [(a, s, t.encode()) for a, s, t in rows]
    want: Counter = Counter()
    for a, s, t in rows:
        own = Counter(x.lower() for x in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t))
        want.update({(a, s, b"", "n"): 0, (a, s, b"", "d"): 0})
        for x, n in own.items():
            want.update({(a, s, x, "n"): n, (a, s, x, "d"): 1})
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), divergence.KINDS)]
    for cut in (0, 5, len(rows) - 1):  # arrays that start inside their buffers
        out = divergence.tally(*[c.slice(cut) for c in columns])
        if cut == 0:
            assert out.schema.names == divergence.NAMES and len(out) == len({k[:3] for k in want})
            assert {(*r[:3], k): r[i] for r in zip(*[c.to_pylist() for c in out.columns]) for i, k in ((3, "n"), (4, "d"))} == dict(want)
        alone = Counter()
        for r in rows[cut:]:
            for *g, n, d in zip(*[c.to_pylist() for c in divergence.tally_long(*r).columns]):
                alone.update({(*g, "n"): n, (*g, "d"): d})
        assert {(*r[:3], k): r[i] for r in zip(*[c.to_pylist() for c in out.columns]) for i, k in ((3, "n"), (4, "d"))} == dict(alone)


def test_terms_are_counted_in_one_shuffle(spark):
    rows = corpus(4, 60, 3)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert divergence.counted(df)._jdf.queryExecution().toString().count("Exchange") <= 1  # only the table's own; audit() deals the counts by term
    assert got(divergence.audit(df)) == brute(rows)
