import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from examloom.llm import ann, decontam, licenses
from examloom.llm.fmindex import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    for _ in range(60):
        t = rng.integers(0, rng.integers(2, 6), rng.integers(1, 60))
        t = np.append(np.concatenate([t] * int(rng.integers(1, 4))), 0)
        assert sorted(suffix_order(t)) == list(range(len(t)))
        index = FMIndex(t, int(rng.integers(1, 9)))
        for n in (1, 2, 4):
            patterns = rng.integers(1, 7, (15, n))
            for p, a, b in zip(patterns, *index.search(patterns), strict=True):
                want = [k for k in range(len(t) - n + 1) if (t[k : k + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_against_a_scan(spark, frame, corpus):
    rng = random.Random(9)
    texts = [t for _, t, _ in corpus if t]
    items = [(k, " ".join(rng.choice(texts).split()[k : k + rng.randint(1, 25)])) for k in range(20)]
    items += [(50, None), (51, "..."), (None, items[0][1]), (0, items[0][1]), (52, texts[5].upper())]
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    docs = frame(corpus)
    for options in ({}, {"block_bytes": 100, "shard_bytes": 500}):
        got = decontam.report(docs, ["doc_id", "text"], "text", bench, **options).collect()
        assert len(got) == len(corpus)
        for r in got:
            w = words(r.text)
            hit, ids = [False] * len(w), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    found = windows.get(tuple(w[k : k + n]))
                    if found:
                        ids |= found
                        hit[k : k + n] = [True] * n
            assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), sum(hit), len(ids), any(hit))
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_decontamination_of_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.report(frame([]), ["doc_id"], "text", none).count() == 0
    docs = frame([(1, "a b", None), (2, None, None)])
    assert [r.n_hit for r in decontam.report(docs, ["doc_id"], "text", none).collect()] == [0, 0]
    assert decontam.clean(docs, "text", none).columns == docs.columns


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:600] = x[300] + rng.normal(size=(300, 16)) * 0.01
    x[700:720] = x[700]  # equal vectors
    rows = [(k, v.tolist(), k) for k, v in enumerate(x)]
    bad = [(1000, None, 0), (1100, [0.0] * 16, 0), (1200, [float("nan")] * 16, 0), (1300, [1.0] * 15 + [None], 0),
           (1400, [1.0, 2.0], 0), (None, x[0].tolist(), 0), (1500, [float("inf")] * 16, 0), (5, x[5].tolist(), 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score int")
    got = ann.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, chunk_rows=100, block_rows=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(by) == list(range(0, 900, 50))
    d64, recall = x.astype(float), []
    for q, found in by.items():
        d = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        order = [k for k in np.lexsort((np.arange(900), d)) if k != q][:10]
        assert sorted(found) == list(range(1, 11))
        pairs = [(s, v) for v, s in (found[k] for k in range(1, 11))]
        assert pairs == sorted(pairs) and all(abs(s - d[v]) < 1e-9 for s, v in pairs)
        recall.append(len({v for _, v in pairs} & set(order)) / 10)
    assert np.mean(recall) >= 0.9
    assert [by[700][k][0] for k in range(1, 11)] == list(range(701, 711))


def test_every_copy_of_a_vector_is_asked(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 8))
    x[200:700] = x[200]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, chunk_rows=100, block_rows=5).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(by) == list(range(0, 900, 50)) and all(sorted(f) == list(range(1, 11)) for f in by.values())
    for q in range(200, 700, 50):
        assert [by[q][k] for k in range(1, 11)] == [(v, 0.0) for v in range(200, 212) if v != q][:10]


def test_search_of_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    every = F.lit(True)
    assert ann.search(spark.createDataFrame([], kind), "vec_id", "embedding", every).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0])], kind)
    assert ann.search(one, "vec_id", "embedding", every).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 0.0])], kind)
    got = ann.search(three, "vec_id", "embedding", every).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in got] == [(0, 2, 0.0), (0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 0, 0.0), (2, 1, 1.0)]


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        n, start, stop = licenses.align(a, b, -20, 20)
        assert n == longest_common(b, a)
        if n:
            assert n == longest_common(b, a[start:stop])


def test_license_scan(frame):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
    templates = [("mit", mit), ("cc", "Licensed under CC BY 4.0"), ("none", "...")]
    edited = mit.replace("hereby", "now").replace("charge", "any charge")
    docs = [
        (1, f"some words before. {mit} and after", None), (2, f"x {edited} y", None), (3, "licensed UNDER cc-by 4.0! licensed under cc by 4.0", None),
        (4, "Permission is hereby refused", None), (5, None, None), (6, "", None), (7, "word " * 50_000 + mit, None), (1, mit, None),
    ]
    got = {(r.doc_id, r.n_words): r for r in licenses.report(frame(docs), ["doc_id"], "text", templates).collect()}
    assert len(got) == 8
    n = len(words(mit))
    assert got[1, n].spans == f"mit:0-{n}" and got[1, n + 5].spans == f"mit:3-{3 + n}"
    two = next(r for (i, _), r in got.items() if i == 2)
    assert two.licenses == "mit" and 0.8 <= two.coverage < 1 and two.matched_words == n - 1
    three = next(r for (i, _), r in got.items() if i == 3)
    assert three.spans == "cc:0-6,cc:6-12" and three.n_matches == 2
    assert got[7, 50_000 + n].spans == f"mit:50000-{50_000 + n}"
    assert all(r.n_matches == 0 and r.coverage == 0 for (i, _), r in got.items() if i in (4, 5, 6))
    assert licenses.report(frame([]), ["doc_id"], "text", templates).count() == 0
