"""Substring dedup, near-duplicate groups, components and decontamination against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from brute import near_dedup, substring_dedup
from corpus_fixtures import no_docs, odd_docs, words  # noqa: F401
from missaware.llm import leaks, neardup, substrings
from missaware.llm.components import components
from pyspark.sql import functions as F


def planted(seed, n=120):
    """Documents of random words with shared passages of 18 to 60 words and near copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40)}" if rng.random() < 0.3 else f"x{rng.randrange(10**6)}"
    passages = [[word() for _ in range(rng.choice((18, 19, 20, 21, 33, 60)))] for _ in range(8)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.3:
            w = rng.choice(out).split()
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                if w:
                    w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice((3, 12, 40, 90)))]
            for _ in range(rng.choice((0, 1, 2))):
                at = rng.randrange(len(w) + 1)
                w[at:at] = rng.choice(passages)
        out.append((" " if rng.random() < 0.8 else " \n").join(w))
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, out, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_brute_force(spark, seed):
    rows = planted(seed)
    want = {rows[i][0]: v for i, v in substring_dedup(rows).items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_bytes in (1 << 30, 500):
        got = substrings.dedup(docs, block_bytes=block_bytes).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
        assert {r[0]: tuple(r[1:]) for r in got} == want


def test_substrings_of_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = substrings.dedup(odd_docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert Counter(map(tuple, got)) == Counter((rows[i][0], *v) for i, v in substring_dedup(rows).items())
    assert substrings.dedup(no_docs).count() == 0


def test_cover_meets_every_difference():
    at = np.flatnonzero(substrings.COVER)
    assert {(a - b) % substrings.PERIOD for a in at for b in at} == set(range(substrings.PERIOD))


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rows = planted(seed, 150)
    want = {rows[i][0]: v for i, v in near_dedup(rows).items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.groups(docs).collect()}
    assert got == want
    kept = neardup.keep_first(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in want.values()})


def test_chain_of_near_copies_is_one_group(spark):
    """Neighbours are similar, the ends are not; most pairs only meet off the star."""
    w = [f"t{k}" for k in range(400)]
    rows = []
    for i in range(25):
        rows.append((100 - i, " ".join(w)))
        w = w[12:] + [f"u{i}_{k}" for k in range(12)]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {76} and not neardup.similar(*[neardup.shingle_set(rows[k][1].encode(), neardup.WordHashes()) for k in (0, -1)], 75)


def test_left_over_finds_what_the_star_misses(spark, monkeypatch):
    """Three families in one band; the hub's own family is one group already."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = np.random.default_rng(5)
    family = [np.sort(rng.integers(0, 2**63, 200, dtype=np.uint64)) for _ in range(3)]
    grams = [np.sort(np.concatenate((family[n % 3], rng.integers(0, 2**63, 10, dtype=np.uint64)))) for n in range(12)]
    sigs = (neardup.mix(neardup.super_min_hash(grams)) & np.uint64(0xFF)).astype(np.uint8)
    nodes = spark.createDataFrame([(n, bytearray(sigs[n].tobytes())) for n in range(12)], "node long, sig binary")
    sets = spark.createDataFrame([(n, bytearray(grams[n].tobytes())) for n in range(12)], "node long, grams binary")
    met = nodes.select("node", F.lit(0).alias("band"), F.lit(7).cast("long").alias("key"), F.lit(0).cast("long").alias("hub"))
    root = spark.createDataFrame([(n, 0) for n in (3, 6, 9)], "node long, root long")
    links = neardup.left_over(met, nodes, sets, root, 75)
    assert {(r["a"] % 3, r["b"] % 3) for r in links.collect()} == {(1, 1), (2, 2)}
    assert {r["node"]: r["root"] for r in components(links).collect()} == {4: 1, 7: 1, 10: 1, 5: 2, 8: 2, 11: 2}


def test_groups_of_odd_rows(odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    some = [(i, t) for i, t in rows if i is not None]
    want = Counter((some[k][0], *v) for k, v in near_dedup(some).items())
    got = neardup.groups(odd_docs).collect()
    assert len(got) == 18
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == want
    assert neardup.groups(no_docs).count() == 0 and neardup.keep_first(no_docs).count() == 0
    kept = neardup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {1, 4, 5, 6, 7} <= {r["doc_id"] for r in kept.collect()} and not {2, 3, 8} & {r["doc_id"] for r in kept.collect()}


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", words(40, 1))], "doc_id string, text string")
    for refused in (substrings.dedup, neardup.groups, neardup.keep_first):
        with pytest.raises(ValueError, match="whole number"):
            refused(docs)


def test_of_equal_ids_and_texts_the_same_row_stays(spark):
    rows = [(1, words(60, 1), f"s{k}", k) for k in range(9)] + [(2, words(60, 2), None, 1), (2, words(60, 2), "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    runs = {tuple(sorted(map(str, neardup.keep_first(docs.repartition(k)).collect()))) for k in (1, 3, 7)}
    assert len(runs) == 1 and len(next(iter(runs))) == 2


def test_signature_estimates_the_similarity():
    rng = np.random.default_rng(2)
    off = []
    for share in (0.5, 0.75, 0.9):
        for n in (5, 60, 2000):
            both = int(n * share)
            x = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = x[:n], np.concatenate((x[:both], x[n:]))
            s = neardup.super_min_hash([np.sort(a), np.sort(b)])
            off.append((s[0] == s[1]).mean() - both / (2 * n - both))
    assert max(map(abs, off)) < 0.15 and abs(np.mean(off)) < 0.06


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def leak_truth(docs, items):
    """(doc, item) pairs whose item has 75 % of its 5-word shingles in the document."""
    out = set()
    for i, t in items:
        w = leaks.terms((t or "").encode())
        g = leaks.grams(w, 5)
        for d, x in docs:
            if g and len(g & leaks.grams(leaks.terms((x or "").encode()), 5)) >= 0.75 * len(g):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark, odd_docs, no_docs):
    rng = random.Random(6)
    word = lambda: rng.choice(("the", "of", "in", "to")) if rng.random() < 0.4 else f"k{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((5, 12, 40, 64, 65, 150)))).capitalize() + ". The answer is " + word() + ".") for i in range(60)]
    items += [(60, None), (61, ""), (62, "yes"), (63, items[0][1])]
    docs = []
    for d in range(150):
        w = [word() for _ in range(rng.choice((0, 30, 200, 700)))]
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(items[:60])[1].upper().split()
        docs.append((d, " ".join(w)))
    doc_rows, item_rows = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leak_truth(docs, items)
    got = leaks.find(doc_rows, item_rows).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 40
    small = [ix for ix in leaks.indexes(item_rows, "item_id", "text", index_words=800)]
    assert len(small) > 4 and sum(len(ix.ids) for ix in small) == 62
    in_parts = leaks.find(doc_rows, item_rows, index_words=800).collect()
    rounded = lambda rows: {(r["doc_id"], r["item_id"], r["passage_start"], round(r["score"], 9)) for r in rows}
    assert rounded(in_parts) == rounded(got)
    kept = leaks.clean(doc_rows, item_rows)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert leaks.find(no_docs, item_rows).count() == 0 and leaks.find(odd_docs, item_rows).count() == 0
    assert leaks.clean(odd_docs, item_rows.limit(0)).count() == 18


def test_short_items_are_found_as_whole_sentences_or_lines(spark):
    items = spark.createDataFrame([(1, "Blue whale."), (2, "42"), (3, " -- "), (4, "the blue whale"), (5, "BLUE WHALE")], "item_id long, text string")
    texts = ["A blue whale swims.", "First. Blue whale! Then more.", "x y\n  blue  WHALE \n42", "42 is it", "", None, "--", "The (blue) whale?"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["passage_start"]) for r in leaks.find(docs, items).collect())
    assert got == [(1, 1, 1), (1, 5, 1), (2, 1, 2), (2, 2, 4), (2, 5, 2), (7, 4, 0)]
    assert sorted(r["doc_id"] for r in leaks.clean(docs, items).collect()) == [0, 3, 4, 5, 6]
    assert got == sorted((r["doc_id"], r["item_id"], r["passage_start"]) for r in leaks.find(docs, items, index_words=2).collect())


def test_index_returns_every_item_above_the_threshold():
    """Block bounds against plain scoring of all items."""
    rng = random.Random(8)
    word = lambda: f"k{int(rng.paretovariate(0.6)) % 200}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(6, 50))).encode()) for i in range(90)]
    ix = leaks.Index.build(items, 64)
    ix.verify = lambda item, words: (1.0, 1.0)
    docs = [[w.encode() for w in (word() for _ in range(rng.randrange(0, 400)))] for _ in range(30)]
    got = {(d, i, s) for d, i, s, *_ in ix.search(docs)}
    want = set()
    for d, w in enumerate(docs):
        for s in range(0, len(w), 64):
            present = np.zeros(ix.n_terms, bool)
            present[[ix.vocabulary[x] for x in w[s : s + 128] if x in ix.vocabulary]] = True
            total = np.bincount(ix.post_item, ix.post_impact * present[ix.post_term], len(items))
            want |= {(d, int(i), s) for i in np.flatnonzero(total >= leaks.THRESHOLD - 1e-9)}
    assert got == want and len(want) > 20
