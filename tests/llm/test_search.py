import math
import random
import re
from collections import Counter

import numpy as np
from corpus_fixtures import no_docs, odd_docs  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from missaware.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def cut(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """[(item, rank, doc, score)] by scoring every document; docs and items are (id, text)."""
    tf = [Counter(cut(t)) for _, t in docs]
    n_all, l_all = sum(1 for c in tf if c), sum(sum(c.values()) for c in tf)
    df = Counter(t for c in tf for t in c)
    of = {}
    for i, t in items:
        of.setdefault(i, set()).update(cut(t))
    out = []
    for item, ts in of.items():
        scored = []
        for (doc, _), c in zip(docs, tf, strict=True):
            m = 10 + 90 * sum(c.values()) * n_all // l_all if c else 0
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, doc is not None, doc, s))
        out += [(item, r, doc, s) for r, (_, _, doc, s) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] if x[1] else 0,))[:k], 1)]
    return sorted(out, key=str)


def got(index, items, **options):
    return sorted(map(tuple, search.search(index, items, **options).collect()), key=str)


def corpus(n, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "日本", "x1", "THE", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i * 7 % n, " ".join(rng.choices(words, weights, k=rng.randrange(60)))) for i in range(n)]
    docs += [(n + i, docs[i % 5][1]) for i in range(40)]  # copies: equal scores
    items = [(i, ", ".join(rng.choices(words, k=rng.randrange(12)))) for i in range(30)] + [(90, None), (91, "--"), (92, "nowhere"), (93, "the THE The")]
    return docs, items


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_search_equals_scoring_everything(spark):
    docs, items = corpus(400)
    d, i = tables(spark, docs, items)
    index = search.build(d)
    for k in (1, 10, 1000):
        assert got(index, i, k=k) == brute(docs, items, k)


def test_search_in_many_shards_blocks_and_small_leaves(spark, monkeypatch):
    for name, value in (("SHARD_TERMS", 900), ("BLOCK_TERMS", 40), ("LEAF", 1), ("ROWS", 50), ("PIECE", 20)):
        monkeypatch.setattr(search, name, value)
    docs, items = corpus(300, 6)
    d, i = tables(spark, docs, items)
    index = search.build(d)
    assert index.select("shard").distinct().count() > 8
    assert got(index, i) == brute(docs, items)


@given(st.data())
@settings(max_examples=150, deadline=None)
def test_best_first_equals_sorting(data):
    n = data.draw(st.integers(1, 90))
    lists = data.draw(st.lists(st.dictionaries(st.integers(0, n - 1), st.integers(0, 5), min_size=1), min_size=1, max_size=5))
    k, leaf = data.draw(st.integers(1, 12)), data.draw(st.integers(1, 9))
    docs = np.array([d for x in lists for d in sorted(x)], np.int64)
    impact = np.array([x[d] for x in lists for d in sorted(x)], np.int64)
    made = search.Lists(np.cumsum([0, *map(len, lists)]), docs, impact, n)
    of = sorted(data.draw(st.sets(st.integers(0, len(lists) - 1), min_size=1)))
    score = Counter()
    for x in of:
        score.update(lists[x])
    want = sorted(((s, d) for d, s in score.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    before, search.LEAF = search.LEAF, leaf
    try:
        assert made.best(np.array(of), k) == want
    finally:
        search.LEAF = before
    for lo, hi in data.draw(st.lists(st.tuples(st.integers(0, len(lists[0]) - 1), st.integers(1, len(lists[0]))).filter(lambda x: x[0] < x[1]), max_size=5)):
        assert impact[made.largest(np.array([lo]), np.array([hi]))[0]] == impact[lo:hi].max()


def test_best_first_leaves_most_documents_alone():
    rng = np.random.default_rng(1)
    n = 1 << 14
    docs = [np.sort(rng.choice(n, 4000, replace=False)) for _ in range(4)]
    impact = [(rng.pareto(1.5, 4000) * 100).astype(np.int64) + 1 for _ in docs]
    made = search.Lists(np.arange(5) * 4000, np.concatenate(docs), np.concatenate(impact), n)
    seen, sums = [], made.sums
    made.sums = lambda lo, hi, first, m: seen.append(m) or sums(lo, hi, first, m)
    top = made.best(np.arange(4), 10)
    whole = np.zeros(n, np.int64)
    for d, x in zip(docs, impact, strict=True):
        whole[d] += x
    assert [s for s, _ in top] == np.sort(whole)[::-1][:10].tolist() and sum(seen) < n // 4


def test_sizes_beyond_64_bits():
    n = np.array([5, 10**9], np.int64)
    assert search.sizes_factor(n, 10**12, 10**15).tolist() == [10 + 90 * x * 10**12 // 10**15 for x in n.tolist()]


def test_search_of_odd_documents(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "w3 w77 one"), (1, "end"), (None, "a w12"), (None, None), (2, "İ"), (3, "")]
    i = spark.createDataFrame(items, "item_id long, text string")
    index = search.build(odd_docs)
    assert got(index, i) == brute(docs, items)
    assert search.search(search.build(no_docs), i).count() == 0 and search.search(index, i.limit(0)).count() == 0


def test_search_with_text_ids(spark):
    docs, items = corpus(60, 8)
    docs, items = [(f"d{i:03d}", t) for i, t in docs], [(f"q{i}", t) for i, t in items]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    assert got(search.build(d), spark.createDataFrame(items, "item_id string, text string")) == brute(docs, items)
