"""The pipeline against its stages done by plain means, on a small table with planted cases."""

import random

import corpus_pipeline
from brute import near_dedup
from missaware.llm import leaks, mixing, rules, sharding


def rows(seed=9):
    rng = random.Random(seed)
    prose = lambda n: ". ".join(" ".join(f"word{rng.randrange(4000)}" for _ in range(9)).capitalize() for _ in range(n)) + "."
    items = [(k, prose(4)) for k in range(12)]
    out = []
    for i in range(160):
        kind, text = i % 8, prose(rng.randrange(8, 30))
        if kind == 1:
            text = "\n".join(" ".join(f"SALE{rng.randrange(99)}!!" for _ in range(10)) for _ in range(8))
        elif kind == 2 and out:
            text = out[rng.randrange(len(out))][1] + " tail"
        elif kind == 3:
            text += " " + items[rng.randrange(12)][1] + " " + prose(2)
        elif kind == 4 and i > 20:
            text = out[i - 8][1]
        out.append((i, text, "en", f"s{i % 3}" if i % 5 else None, len(text or "")))
    out += [(160, None, None, None, None), (161, "", "en", "s1", 0), (None, prose(20), "en", "s1", 1)]
    return out, items


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    docs, items = rows()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in docs if rules.measure(r[1])[-1]]
    assert len(kept) < len(docs) - 15
    known = [r for r in kept if r[0] is not None]
    first = {c for _, c in near_dedup([(r[0], r[1]) for r in known]).values()}
    kept = [r for r in kept if r[0] is None or r[0] in first]
    grams = [leaks.grams(leaks.terms(t.encode()), 5) for _, t in items]

    def leaks_item(text):
        g = leaks.grams(leaks.terms(text.encode()), 5)
        return any(len(x & g) >= 0.75 * len(x) for x in grams)

    kept = [r for r in kept if not leaks_item(r[1])]
    table = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")
    by_source = {r["source"]: r["target"] for r in mixing.mix(table).collect()}

    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = corpus_pipeline.written(stage(spark, got, str(tmp_path)), name)
        counts.append(got.count())
        if name == "decontaminate":
            assert sorted(map(tuple, got.collect()), key=str) == sorted(kept, key=str)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    words = lambda t: len((t or "").encode().split())
    for s, target in by_source.items():
        taken = sum(words(r["text"]) for r in got.collect() if r["source"] == s)
        assert abs(taken - target) <= 3 * max(words(r[1]) for r in kept)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == counts[-1] and len({(r["shard"], r["slot"]) for r in out}) == len(out)
    assert {r["shard"] for r in out} <= set(range(16)) and out[0]["law"] == "key" and sharding.tree(4) == [[[0, 1], [2, 3]]]
