import math
import zlib
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
from pyspark.sql import functions as F

from examloom.llm import mixing, sharding


def shard(key, weights):
    def cost(s, w):
        u = (int(md5(f"{key}#{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return -math.log(u) / w

    return min(((cost(s, w), s) for s, w in weights.items() if w > 0))[1]


def test_layout_follows_the_definition(frame, corpus):
    got = sharding.layout(frame(corpus), ["doc_id"], "text", 7).collect()
    assert len(got) == len(corpus)
    expect = Counter()
    for i, t, _ in corpus:
        key = "~" if i is None else f"={i}"
        raw = None if t is None else t.encode()
        old, new = (shard(key, sharding.even(n)) for n in (7, 8))
        expect[(i, len(raw or b"") + 16, None if raw is None else zlib.crc32(raw), "key", old, new)] += 1
        assert new in (old, 7)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == expect
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weights_share_the_keys(spark):
    df = sharding.assign(spark.range(20_000), ["id"], {0: 1.0, 1: 3.0, 2: 0.0})
    n = dict(df.groupBy("shard").count().collect())
    assert set(n) == {0, 1} and abs(n[1] / 20_000 - 0.75) < 0.02


def test_sharding_empty_and_clashing(frame):
    assert sharding.layout(frame([]), ["doc_id"], "text", 3).count() == 0
    out = sharding.assign(frame([(1, "a", "s")]), ["doc_id"], sharding.even(3))
    assert out.columns == frame([]).columns and dict(out.dtypes)["shard"] == "int"


def brute_targets(sizes, weights, budget, cap):
    """Share by weight; fix what is above its limit; share the rest again."""
    names = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    w = {k: weights[n % len(weights)] for n, k in enumerate(names)}
    left, fixed = sum(sizes.values()) * budget, {}
    while True:
        open_ = [k for k in names if k not in fixed]
        share = {k: left * w[k] / sum(w[x] for x in open_) for k in open_}
        over = [k for k in open_ if share[k] > cap * sizes[k]]
        if not over:
            return fixed | share
        for k in over:
            fixed[k] = cap * sizes[k]
            left -= fixed[k]


def test_mix_meets_targets(frame, corpus):
    df = frame(corpus)
    got = mixing.report(df, ["doc_id"], "source", "text", bucket_rows=8, fan_in=2).collect()
    again = mixing.report(df.repartition(5), ["doc_id"], "source", "text", bucket_rows=8, fan_in=2).collect()
    plain = lambda rows: sorted(map(str, rows))
    assert plain(got) == plain(again)
    size = lambda t: len((t or "").encode().split())
    total, longest = Counter(), Counter()
    for _, t, s in corpus:
        total[s] += size(t)
        longest[s] = max(longest[s], size(t))
    want = brute_targets(total, (5, 2, 1), 1.5, 2.0)
    by_size = {v: k for k, v in total.items()}
    assert len(by_size) == len(total)
    taken = Counter()
    for r in got:
        s = by_size[r.source_size]
        assert abs(r.target - want[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in total)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in corpus)


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 50, 40).astype(float), rng.random(40)
    mean = np.zeros(40)
    for _ in range(3000):
        q = mixing.pivotal(p, size, rng.random(40))
        assert abs((q * size).sum() - (p * size).sum()) < 1e-6
        assert ((q > 1e-12) & (q < 1 - 1e-12)).sum() <= 1
        mean += q
    assert abs(mean / 3000 - p).max() < 0.05


def test_mix_of_odd_tables(frame):
    assert mixing.report(frame([]), ["doc_id"], "source", "text").count() == 0
    empty = mixing.report(frame([(1, "", "a"), (2, None, None)]), ["doc_id"], "source", "text").collect()
    assert [(r.size, r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 2
    docs = frame([(1, "x y", "a"), (1, "x y", "a"), (2, "z", None)])
    out = mixing.mixed(docs, "source", mixing.words(F.col("text")), ["doc_id"])
    assert out.columns == docs.columns and set(out.select("doc_id", "copies").collect()) <= {(1, 3), (2, 3)}
