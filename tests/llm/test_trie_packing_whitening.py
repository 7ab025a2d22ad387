import hashlib
import json
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from examloom.llm import convtrie, packing, whiten

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

# ---- conversations -------------------------------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string, i long, c long, name string, s long, w long, depth int, rep long"


def turn_rows(rows):
    return [(*r, 1, 2, "n", 3, 4, 5, 6) for r in rows]


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    trunc = lambda c: c - int(math.fmod(c, 20))
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(trunc(c), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[tuple(full[c][:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        n = len(members[k])
        own_words = len(k[-1][1].encode().split()) if k else 0
        leaves = sum(out[x]["n_leaves"] for x in kids[k]) or 1
        saved = (n - 1) * own_words + sum(out[x]["saved_tokens"] for x in kids[k])
        ends = ",".join(str(c) for c in members[k] if len(full[c]) == len(k))
        out[k] = {
            "conv_id": members[k][0], "depth": len(k), "parent_conv_id": members[k[:-1]][0] if k else None, "n_convs": n,
            "n_children": len(kids[k]), "n_leaves": leaves, "saved_tokens": saved,
            "ends_sha256": hashlib.sha256(ends.encode()).hexdigest(),
        }
    return sorted(map(repr, out.values()))


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(60), -5, -20, 99, 1 << 40]:
        for t in range(rng.choice([0, 1, 2, 3, 5])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d  e\tf"])))
    rows += [(k, t, "user", f"copy {t}") for k in range(200, 260) for t in range(3)]  # a hot conversation
    rows += [(7, None, "user", "first"), (7, 0, "user", "same turn"), (7, 0, "user", "same turn"), (None, 0, "user", "nobody")]
    rows += [(300, t, "user", f"t{t % 3}") for t in range(2500)]  # longer than a slice
    return rows


def test_trie_against_plain_python(spark):
    rows = conversations()
    df = spark.createDataFrame(turn_rows(rows), TURN)
    got = convtrie.report(df, "conv_id", "turn", "role", "text").collect()
    assert sorted(repr(r.asDict()) for r in got) == plain_trie(rows)


def test_end_lists_and_texts(spark):
    rows = [(c, t, "user", x) for c, xs in {1: "ab", 2: "ab", 9000: "ab", 3: "abc", 4: "x"}.items() for t, x in enumerate(xs)]
    df = spark.createDataFrame(turn_rows(rows), TURN)
    own = convtrie.turns(df, "conv_id", "turn", "role", "text")
    nodes, ends = convtrie.trie(own.select("c").distinct(), own)
    assert sorted((r.end_id, r.conv_id) for r in ends.collect()) == [(1, 1), (1, 2), (1, 9000), (3, 3), (4, 4)]
    got = {(r.conv_id, r.depth): (r.text, r.n_convs, r.n_leaves) for r in convtrie.last_turns(nodes, df, "conv_id", "turn", "role", "text").collect()}
    assert got == {(1, 0): (None, 5, 2), (1, 1): ("a", 4, 1), (1, 2): ("b", 4, 1), (3, 3): ("c", 1, 1), (4, 1): ("x", 1, 1)}
    digest = {r.end_id: r.ends_sha256 for r in convtrie.end_digests(ends).collect()}
    assert digest[1] == hashlib.sha256(b"1,2,9000").hexdigest()


def test_trie_of_empty_table(spark):
    assert convtrie.report(spark.createDataFrame([], TURN), "conv_id", "turn", "role", "text").count() == 0


# ---- packing -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return packing.Vocabulary(PATH)


def test_tokens_agree_with_the_tokenizers_library(vocabulary, corpus):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    odd = ["", " ", "a<|endoftext|>b", "é \U0001f600中文。", "x" * 3000, "I'm 12345  \n\n done.", "ال हि", "a b " * 600_000]
    for t in odd + [t for _, t, _ in corpus if t]:
        assert vocabulary.ids(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    with open(PATH, encoding="utf-8") as f:
        assert json.load(f)["added_tokens"][0]["content"] == "<|endoftext|>"


def test_cuts_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(300):
        gaps = [rng.randint(1, 9) for _ in range(rng.randint(1, 14))]
        at, window = np.cumsum(gaps), rng.choice([9, 12, 16])
        pen = np.array([rng.choice([0, 1, 3]) for _ in gaps])
        pos, best = [0, *at.tolist()], {0: 0}
        for j in range(1, len(pos)):
            best[j] = pen[j - 1] + min(best[i] + packing.padding(pos[j] - pos[i], window) for i in range(j) if pos[j] - pos[i] <= window)
        cuts = packing.best_cuts(at, pen, window)
        edges = [0, *(int(at[c]) for c in cuts)]
        assert edges[-1] == at[-1] and all(0 < b - a <= window for a, b in zip(edges, edges[1:]))
        assert sum(packing.padding(b - a, window) for a, b in zip(edges, edges[1:])) + sum(int(pen[c]) for c in cuts) == best[len(pos) - 1]


def pieces_hold(df, docs, vocabulary, window, **options):
    got = packing.pack(df, ["doc_id"], "text", PATH, window=window, **options).collect()
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and r.length > 0
        sequences[r.sequence_id].append(r)
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0, *(r.length for r in rs)])[:-1].tolist()
        assert sum(r.length for r in rs) <= window
    want = defaultdict(list)
    for i, t, _ in docs:
        want[i].append(np.append(vocabulary.ids(t or ""), 1).astype("<u4").tobytes())
    held = defaultdict(bytes)
    for i in want:
        rs = sorted((r for (k, _), v in by_doc.items() if k == i for r in v), key=lambda r: (r.doc_tokens, r.start))
        if len(want[i]) == 1:
            assert [r.start for r in rs] == np.cumsum([0, *(r.length for r in rs)])[:-1].tolist()
            held[i] = b"".join(bytes(r.ids) for r in rs)
            assert held[i] == want[i][0] and {r.doc_tokens for r in rs} == {len(held[i]) // 4}
        else:
            assert sum(r.length for r in rs) == sum(len(x) for x in want[i]) // 4
    return sequences


def test_pieces_rebuild_every_document(frame, corpus, vocabulary):
    for window, segment in ((2048, 1 << 18), (64, 256)):  # small segments settle in the middle of documents
        sequences = pieces_hold(frame(corpus), corpus, vocabulary, window, segment=segment)
        lengths = [sum(r.length for r in rs) for rs in sequences.values()]
        assert sum(packing.padding(n, window) for n in lengths) <= 0.1 * sum(lengths) + window * 8


def test_pack_of_odd_tables(frame, vocabulary):
    assert packing.report(frame([]), ["doc_id"], "text", PATH).count() == 0
    docs = [(1, None, None), (2, "", None), (None, "x", None), (5, "word" * 5000, None), (6, "no stop " * 3000, None)]
    pieces_hold(frame(docs), docs, vocabulary, 128)
    got = packing.report(frame(docs[:1]), ["doc_id"], "text", PATH).collect()
    assert [(*r[:5], r.offset) for r in got] == [(1, 0, 1, zlib.crc32(b"\1\0\0\0"), 1, 0)]


# ---- whitening -----------------------------------------------------------------------------------------------------

VECTOR = "vec_id long, embedding array<float>, x int, v double, n long, deviation long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, 3, 4) for i, v in rows], VECTOR)


@pytest.mark.parametrize(
    "values",
    [
        list(np.linspace(1, 20, 20)), [1.0] * 6 + [2.0] * 6 + [5, 5 + 1e-6, 5 + 2e-6], [3 + 1e-10 * k for k in range(6)] + [1 + 1e-13 * k for k in range(6)],
        [7.0] * 5, [0.0, 0, 0, 1, 2], [1 + 1e-7 * k for k in range(24)],
    ],
)
def test_eigenvectors_of_clustered_spectra(values):
    rng = np.random.default_rng(0)
    d = len(values)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(whiten.WIDE)
    for _ in range(3):
        q = q @ (1.5 * np.eye(d, dtype=whiten.WIDE) - 0.5 * (q.T @ q))
    a = q @ np.diag(np.array(values, whiten.WIDE)) @ q.T
    a = (a + a.T) / 2
    lam, x = whiten.eigen(a)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17 and np.abs(a @ x - x * lam).max() < 1e-15
    assert np.abs(lam - np.sort(np.array(values, whiten.WIDE))[::-1]).max() < 1e-15
    # vectors agree where eigenvalues differ by more than rounding can blur
    order = np.argsort(-np.array(values), kind="stable")
    gaps = [min((abs(values[i] - v) for k, v in enumerate(values) if k != i), default=1) for i in order]
    for k, i in enumerate(order):
        if gaps[k] > 1e-11:
            assert abs(abs((q[:, i] * x[:, k]).sum()) - 1) < 1e-12


def test_products_are_exact():
    y = np.random.default_rng(2).integers(-(1 << 41), 1 << 41, (2500, 3))
    assert (whiten.products(y) == y.astype(object).T @ y.astype(object)).all()


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(4)
    c = (rng.normal(size=(150, 6)) @ np.diag([3, 3, 2, 1, 0.5, 0.5])).astype(np.float32)
    rows = [(k, [float(z) for z in v]) for k, v in enumerate(c)]
    rows += [(1000 + k, rows[0][1]) for k in range(300)]  # hot copies count once
    rows += [(None, rows[3][1]), (5, rows[5][1]), (2000, [0.0] * 6)]
    bad = [(1, None), (2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3, [float("nan")] + [0.0] * 5), (4, [float("inf")] + [0.0] * 5), (6, []), (7, [1.0])]
    got = whiten.report(vectors(spark, rows + bad), "vec_id", "embedding", components=4).collect()
    assert len(got) == 4 * len(rows)
    xs = {tuple(math.floor(64 * z) + 1_000_000 for z in v) for _, v in rows}
    n, s = len(xs), [sum(col) for col in zip(*xs)]
    cov = [[float(sum((Fraction(x[i]) - Fraction(s[i], n)) * (Fraction(x[j]) - Fraction(s[j], n)) for x in xs) / n) for j in range(6)] for i in range(6)]
    e, v = np.linalg.eigh(np.array(cov))
    order = np.argsort(-e)[:4]
    by_row = defaultdict(list)
    for r in got:
        by_row[r.vec_id].append(r)
        assert r.n == n and abs(r.explained / (e[order[r.component - 1]] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-9
    sign = {}
    for i, vec in rows[:150]:
        x = [math.floor(64 * z) + 1_000_000 for z in vec]
        want = np.array([float(Fraction(a) - Fraction(t, n)) for a, t in zip(x, s)]) @ v[:, order] / np.sqrt(e[order])
        for r in by_row[i]:
            assert r.deviation == sum((n * a - t) ** 2 for a, t in zip(x, s))
            sign.setdefault(r.component, np.sign(r.whitened * want[r.component - 1]))
            assert abs(r.whitened - sign[r.component] * want[r.component - 1]) < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whiten.report(vectors(spark, []), "vec_id", "embedding").count() == 0
    assert whiten.report(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]), "vec_id", "embedding").count() == 0
    line = whiten.report(vectors(spark, [(k, [float(k), 1.0]) for k in range(5)]), "vec_id", "embedding").collect()
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    far = whiten.report(vectors(spark, [(k, [float(k) * 1e9, 1.0]) for k in range(-2, 3)]), "vec_id", "embedding").collect()
    assert {r.deviation for r in far} >= {None} and all(np.isfinite(r.whitened) for r in far)
