import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from examloom.llm import graph, linededup, ngramjoin


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def shingles(t, k):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def expected(docs, k, percent):
    sets = [shingles(t, k) for _, t, _ in docs]
    same = Sets()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                same.join(i, j)
    least = {}
    for i, (d, _, _) in enumerate(docs):
        if d is not None and sets[i]:
            r = same.find(i)
            least[r] = min(least.get(r, d), d)
    return sorted((str(d), len(s), str(least.get(same.find(i)) if s else d)) for i, ((d, _, _), s) in enumerate(zip(docs, sets, strict=True)))


@pytest.mark.parametrize(("k", "percent", "block_rows"), [(3, 90, 200), (2, 60, 3)])
def test_join_against_all_pairs(frame, corpus, monkeypatch, k, percent, block_rows):
    if block_rows == 3:
        plain = ngramjoin.link
        monkeypatch.setattr(ngramjoin, "link", lambda *a, **b: plain(*a, **b, block_rows=3))
        monkeypatch.setattr(ngramjoin, "PRUNE_ROWS", 2)
    got = ngramjoin.report(frame(corpus), "doc_id", "text", k, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == expected(corpus, k, percent)


def test_trees_against_all_pairs():
    rng = np.random.default_rng(2)
    for trial in range(150):
        base = rng.choice(60, 25, replace=False)
        sets = []
        for _ in range(14):
            s = np.setdiff1d(base, rng.choice(base, rng.integers(0, 6)))
            sets.append(np.union1d(s, rng.choice(200, rng.integers(0, 6))).astype(np.uint64))
        percent = int(rng.integers(50, 100))
        same = Sets()
        for i, a in enumerate(sets):
            for j in range(i):
                n = len(np.intersect1d(a, sets[j]))
                if 100 * n >= percent * (len(a) + len(sets[j]) - n):
                    same.join(i, j)
        sids = list(range(14))
        roots, _ = ngramjoin.join_block(sids, sets, percent, {s: s for s in sids}, [False] * 14)
        assert all((roots[i] == roots[j]) == (same.find(i) == same.find(j)) for i in sids for j in sids), trial


def test_pruning_keeps_every_link():
    rng = np.random.default_rng(1)
    n = rng.integers(5, 60, 300)
    group = np.sort(rng.integers(0, 60, 300))
    pos = (rng.random(300) * n * 0.2).astype(int)
    before = (rng.random(300) * (pos + 1)).astype(int)
    every = before + rng.integers(1, 9, 300)
    ok = ngramjoin.could_link(n, pos, before, every, group, 80)
    for i in range(300):
        fits = any(
            i != j and group[i] == group[j] and 100 * min(n[i], n[j]) >= 80 * max(n[i], n[j])
            and min(before[i], before[j]) + min(n[i] - pos[i], n[j] - pos[j]) >= ngramjoin.needed(n[i], n[j], 80)
            and min(every[i], every[j]) + -(-80 * max(n[i], n[j]) // 100) - 1 >= ngramjoin.needed(n[i], n[j], 80)
            for j in range(300)
        )
        assert ok[i] == fits


@pytest.mark.parametrize("percent", [60, 80, 90, 99])
def test_least_shared_prefix_over_all_sizes(spark, percent):
    def shared(n, m):
        return ngramjoin.needed(n, m, percent) + percent * -max(n, m) // 100 + 1

    rows = [(n, a, b) for n in range(1, 45) for a in range(1, 60) for b in range(a, 60)]
    rows = [(n, a, b) for n, a, b in rows if 100 * a >= percent * n and 100 * n >= percent * b]
    df = spark.createDataFrame(rows, "n long, low long, high long")
    got = df.select("n", "low", "high", ngramjoin.shared_least(F.col("n"), F.col("low"), F.col("high"), percent)).collect()
    assert [tuple(r) for r in got] == [(n, a, b, min(shared(n, m) for m in range(a, b + 1))) for n, a, b in rows]


@pytest.mark.parametrize(("k", "percent", "small"), [(5, 80, 13), (3, 90, 28)])
def test_pairs_at_the_threshold(frame, monkeypatch, k, percent, small):
    plain = ngramjoin.link
    monkeypatch.setattr(ngramjoin, "link", lambda *a, **b: plain(*a, **b, block_rows=2))
    texts, filler, rng = [], [], random.Random(k)
    for family in range(120):
        new = lambda n: [f"u{rng.randrange(1 << 40)}" for _ in range(n)]
        # a pair just at the threshold: all but one of the smaller's shingles, all but two of the larger's
        base = new(small - 1 + k - 1)
        # a linked pair of sizes on both sides of these, with half of its shingles from there
        other = base[: small // 2 + k - 1]
        other += new(small + 2 + k - 1 - len(other))
        texts += [" ".join(t) for t in (new(1) + base, base + new(2), other, other[: len(other) - 3 + family % 2])]
        filler += base + other
    texts += [" ".join(filler)] * 8  # so that these shingles are equally common, and prefixes hold few of them
    docs = [(i, t, None) for i, t in enumerate(texts)]
    got = ngramjoin.report(frame(docs), "doc_id", "text", k, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == expected(docs, k, percent)


def test_join_of_odd_tables(frame):
    assert ngramjoin.report(frame([]), "doc_id", "text").count() == 0
    docs = frame([(1, None, None), (2, "", None)])
    assert sorted(map(tuple, ngramjoin.report(docs, "doc_id", "text").collect())) == [(1, 0, 1), (2, 0, 2)]


def test_one_document_of_each_group_stays(frame, corpus):
    docs = frame(corpus)
    got = ngramjoin.distinct(docs, "doc_id", "text")
    assert got.columns == docs.columns
    rows = [r.doc_id for r in got.collect()]
    groups = defaultdict(list)
    for d, n, c in expected(corpus, 5, 80):
        groups[c if n else (d, "empty")].append(d)
    assert sorted(map(str, rows)) == sorted(str(k[0] if isinstance(k, tuple) else k) for k in groups)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    same = Sets()
    for a, b in edges:
        same.join(a, b)
    least = {}
    for v in {x for e in edges for x in e}:
        least[same.find(v)] = min(least.get(same.find(v), v), v)
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert all(got.get(v, v) == least[same.find(v)] for e in edges for v in e)


NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(line):
    return NOT_WORD.sub(" ", line.lower()).strip(" ")


def simhash(norm):
    seed = xxhash.xxh64_intdigest(b"word", seed=42)
    ws = norm.split(" ")
    h = np.array([xxhash.xxh64_intdigest(w.encode(), seed=seed) for w in ws], np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=int)
    return int(np.packbits((2 * ones > len(ws)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(now[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = now
    return row[-1]


def line_docs():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(80)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(25)]
    for k in range(10):  # near copies of one line, and a bag of words in another order
        ws = lines[0].split() * 3
        ws[rng.randrange(len(ws))] = f"v{k}"
        lines.append(" ".join(ws))
    lines.append(" ".join(reversed(lines[-1].split())))
    lines += ["", "  ", "!!", "\u00c9t\u00e9", "LINE, one", "line one", " ".join(rng.choice(words) for _ in range(300))]
    docs = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))), None) for k in range(40)]
    return [*docs, (90, None, None), (91, "", None), (None, lines[0], None), (3, docs[3][1], None)]


def test_lines_against_all_pairs(frame):
    docs = line_docs()
    places = defaultdict(list)
    for i, t, _ in docs:
        for k, line in enumerate(t.split("\n") if t is not None else []):
            if normal(line):
                places[normal(line)].append((i is None, i or 0, k))
    norms, same = list(places), Sets()
    sims = [simhash(n) for n in norms]
    for i, a in enumerate(norms):
        for j in range(i):
            b = norms[j]
            if (sims[i] ^ sims[j]).bit_count() <= 3 and distance(a, b) <= max(len(a), len(b)) // 10:
                same.join(i, j)
    first = {}
    for i, n in enumerate(norms):
        r = same.find(i)
        first[r] = min(first.get(r, (True, 1 << 60, 0)), min(places[n]))
    assert len(first) < len(norms)
    got = linededup.report(frame(docs), "doc_id", "text").collect()
    assert len(got) == len(docs)
    kept = defaultdict(int)
    for r in got:
        for k in r.kept_lines.split(","):
            if k:
                kept[(r.doc_id is None, r.doc_id or 0, int(k))] += 1
    blank = {(i is None, i or 0, k) for i, t, _ in docs if t is not None for k, x in enumerate(t.split("\n")) if not normal(x)}
    assert set(kept) == set(first.values()) | blank
    assert all(kept[x] == 1 for x in first.values())
    by = {r.doc_id: r for r in got}
    assert (by[90].n_lines, by[90].n_kept, by[91].n_lines, by[91].n_blank) == (0, 0, 1, 1)


def test_cleaned_lines(frame):
    docs = frame([(1, "a b\n\nc d", None), (2, "C, D\ne f", None), (3, None, None), (4, "a b", None)])
    got = linededup.clean(docs, "doc_id", "text")
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == {1: "a b\n\nc d", 2: "e f", 3: None, 4: ""}
    assert linededup.report(frame([]), "doc_id", "text").count() == 0


def test_long_lines_have_the_same_simhash(frame):
    rng = random.Random(3)
    lines = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (1, 127, 128, 1000)]
    docs = frame([(k, x, None) for k, x in enumerate(lines)])
    got = linededup.simhashes(docs, "text", ["doc_id"]).select("doc_id", F.col("sim")).collect()
    assert {r[0]: r[1] & (1 << 64) - 1 for r in got} == {k: simhash(x) for k, x in enumerate(lines)}


def test_near_lines_by_their_texts(spark):
    rng, texts = random.Random(5), []
    for k in range(60):
        words = ["".join(rng.choice("ab\u00e9\U0001f600 ") for _ in range(rng.randint(1, 8))).replace(" ", "c") for _ in range(rng.randint(1, 30))]
        texts.append(" ".join(words))
        for _ in range(3):
            line = list(texts[-1])
            for _ in range(rng.randint(0, max(1, len(line) // 8))):
                line[rng.randrange(len(line)) : rng.randrange(len(line)) + 1] = rng.choice(["", "a", "\u00e9b", " "])[: 1 + k % 2]
                line = line or ["a"]
            texts.append("".join(line))
    rows = spark.createDataFrame(list(enumerate(texts)), "lid long, norm string")
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, min(a + 6, len(texts)))]
    got = linededup.alike(spark.createDataFrame(pairs, "a long, b long"), rows, 90).collect()
    near = [(a, b) for a, b in pairs if distance(texts[a], texts[b]) <= max(len(texts[a]), len(texts[b])) // 10]
    assert sorted(map(tuple, got)) == near and 0 < len(near) < len(pairs)


def test_lengths_that_may_link_share_a_band(spark):
    for percent in (90, 75, 30):
        rows = spark.range(1, 3000).select("id", linededup.bands(F.col("id"), percent).alias("b")).collect()
        held = {r.id: set(r.b) for r in rows}
        assert all(len(b) <= 2 for b in held.values())
        for n in held:
            for m in {n - n * (100 - percent) // 100, n - n * (100 - percent) // 200, n - 1} & set(held):
                assert held[n] & held[m] or 100 * m < percent * n


@pytest.mark.parametrize("direct", [1, 2, 64])
def test_lines_under_large_and_small_keys(frame, monkeypatch, direct):
    docs = [(k, t, None) for k, t, _ in line_docs() if k is not None]
    want = sorted(map(tuple, linededup.report(frame(docs), "doc_id", "text").collect()), key=repr)
    monkeypatch.setattr(linededup, "DIRECT", direct)
    assert sorted(map(tuple, linededup.report(frame(docs), "doc_id", "text").collect()), key=repr) == want


def test_lines_of_unlike_lengths_are_no_pairs(spark):
    rows = spark.createDataFrame([(k, 7, 100 + 50 * (k % 20)) for k in range(200)], "lid long, sim long, len int")
    got = linededup.met(rows, 3, 90)
    assert got._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL") == 5
    pairs = [(r.a, r.b) for r in got.where("key is null").collect()]
    assert len(pairs) == len(set(pairs))
    sizes = [100 + 50 * (k % 20) for k in range(200)]
    near = {(a, b) for a in range(200) for b in range(a + 1, 200) if abs(sizes[a] - sizes[b]) <= max(sizes[a], sizes[b]) // 10}
    assert set(pairs) <= near and all(r.a != r.b or r.key is not None for r in got.collect())
