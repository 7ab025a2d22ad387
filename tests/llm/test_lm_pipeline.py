import math
import os
import random
import zlib
from collections import Counter

import numpy as np

from examloom.llm import lm, quality
from examloom.llm.common import remainder

import __spark_entry__
import corpus_pipeline


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def language_docs(n=150):
    rng = random.Random(6)
    tongues = [["the", "cat", "sat", "on", "mats"], ["der", "hund", "lief", "im", "wald"]]
    docs = []
    for k in range(n):
        ws = tongues[k % 2]
        docs.append((k, " ".join(ws[j % 5] if rng.random() < 0.9 else f"r{rng.randrange(300)}" for j in range(rng.randint(0, 40))), None))
    return [*docs, (500, None, None), (501, "The the THE", None), (None, "cat cat", None), (7, docs[7][1], None), (502, "zz " * 30_000, None)]


def test_scores_against_plain_counts(frame):
    docs = language_docs()
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t, _ in docs]
    c = Counter(w for i, ws in tokens if i is not None and not held(i) for w in ws)
    total, v = sum(c.values()), len(c)
    learn = remainder("doc_id", 5) != 1
    for size in (200_000, 8):  # a small dictionary sends most words through the join
        got = lm.score(frame(docs), ["doc_id"], "text", learn, dictionary=size).collect()
        assert len(got) == len(docs)
        mine = Counter((str(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in tokens)
        assert Counter((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == mine
        assert {r.train_tokens for r in got} == {total}
        tests = [r for r in got if r.doc_id is not None and r.doc_id < 150 and held(r.doc_id) and r.n_tokens > 10]
        assert sum(r.score for r in tests) > sum(r.base_score for r in tests)


def test_probabilities_add_up():
    rng = np.random.default_rng(0)
    key = rng.integers(0, lm.CLASSES**3, 500)
    table = lm.class_log10(lm.train(key, rng.integers(1, 9, 500).astype(float), steps=30))
    assert np.allclose((10.0 ** table.astype(float)).sum(2), 1, atol=1e-4)


def test_scores_of_empty_tables(frame):
    learn = remainder("doc_id", 5) != 1
    assert lm.score(frame([]), ["doc_id"], "text", learn).count() == 0
    only_held = [i for i in range(50) if held(i)][:2]
    got = lm.score(frame([(only_held[0], "a b", None), (only_held[1], None, None)]), ["doc_id"], "text", learn).collect()
    assert [(r.n_known, r.train_tokens) for r in got] == [(0, 0)] * 2 and all(np.isfinite(r.score) for r in got)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against what it should do to the stage before, on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding",
    ]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(path := os.path.join(tmp_path, str(k)))
        seen.append(spark.read.parquet(path))
        assert seen[-1].columns == (columns if k < 4 else [*columns, "shard"])
    ids = [[r[0] for r in x.select("doc_id").collect()] for x in seen]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert not [i for i in ids[1] if labels.get(i) == 0] and all(i in ids[1] for i, q in labels.items() if q == 1)
    # near copies: all pairs
    text = {r.doc_id: r.text for r in docs.collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.encode().lower().split()] for i in range(max(1, len(w) - 4))}
    sets = {i: shingles(text[i]) for i in ids[1]}
    near = {(a, b) for a in ids[1] for b in ids[1] if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    group = {i: i for i in ids[1]}
    for _ in ids[1]:
        change = [(a, b) for a, b in near if group[a] != group[b]]
        for a, b in change:
            group[a] = group[b] = min(group[a], group[b])
        if not change:
            break
    assert sorted(ids[2]) == sorted(set(group.values()))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    from test_text_search import words

    windows = {tuple(w[k : k + 10]) for r in bench for w in [words(r.text)] for k in range(max(1, len(w) - 9) if w else 0)}
    dirty = {i for i in ids[2] for w in [words(text[i])] if any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))}
    assert sorted(ids[3]) == sorted(set(ids[2]) - dirty)
    assert set(ids[4]) <= set(ids[3]) and max(Counter(ids[4]).values()) <= 2
    sizes = {r.doc_id: (r.source, len(r.text.encode().split())) for r in seen[3].collect()}
    assert abs(sum(sizes[i][1] for i in ids[4]) / sum(s for _, s in sizes.values()) - 1.5) < 0.05
    assert sorted(ids[5]) == sorted(ids[4])
    run = corpus_pipeline.run(spark, sf).select("doc_id", "shard").collect()
    assert Counter(map(tuple, run)) == Counter(map(tuple, seen[5].select("doc_id", "shard").collect()))


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries() and len(quality.FEATURES) == len(set(quality.FEATURES))
