"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: each round visits every feature in turn and fits a shallow tree to the current gradients of that one
feature; the trees of a feature add up to a lookup table over its bins. The pairs whose tables would lower the loss
most are then boosted the same way, by a tree that splits one feature and then the other. A score is the sum of
one table entry per feature and pair, so scoring is a few array additions.

The features come from the text alone, in numpy, from bytes and words. The model is fitted on the driver from at most
`most` labelled rows, chosen by a hash of their id where there are more; everything else runs in Arrow batches.

Defined cases: null text counts as empty; empty text gets the score of its features; labels that are null are ignored
and several labels of one id all count; without labels of both kinds the score is their mean (none: 0.5 and keep).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import chunks, free, share, shared

#: Byte classes that are counted: as shares of the text's bytes.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?'\"()-",
    "bang": b"!",
    "mark": b"#$%&*+<=>@[\\]^_`{}~/",
    "bar": b"|",
    "blank": b" \t",
}
FEATURES = [
    "log_bytes", *CLASSES, "beyond_ascii", "log_words", "word_length", "distinct_words", "top_word", "repeat_share",
    "short_words", "capitals", "shouted", "odd_words", "line_words", "distinct_lines", "line_stops", "first_again",
]
_CLASS_OF = np.zeros((256, len(CLASSES) + 1), np.float64)
for _k, _bytes in enumerate(CLASSES.values()):
    _CLASS_OF[list(_bytes), _k] = 1
_CLASS_OF[128:, -1] = 1


def features(text: bytes | None) -> list[float]:
    """The feature values of one text, 0 where a ratio has nothing to divide by."""
    text = text or b""
    n = len(text)
    classes = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS_OF / n).tolist() if n else [0.0] * _CLASS_OF.shape[1]
    words = text.split()
    m = len(words)
    if not m:
        return [float(np.log1p(n)), *classes, *[0.0] * (len(FEATURES) - 1 - len(classes))]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, m)
    lines = [x for x in text.split(b"\n") if x.strip()]
    half = words[: m // 2]
    values = list(counts.values())
    return [
        float(np.log1p(n)),
        *classes,
        float(np.log1p(m)),
        float(sizes.mean()),
        len(counts) / m,
        max(values) / m,
        sum(v for v in values if v > 1) / m,
        float((sizes <= 3).mean()),
        sum(map(bytes.istitle, words)) / m,
        sum(map(bytes.isupper, words)) / m,
        sum(not (w[-1:].isalnum() or w[-1] >= 128 or w[-1:] in (b".", b",")) for w in words) / m,
        float(np.log1p(m / len(lines))),
        len(set(lines)) / len(lines),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        len(set(half) & set(words[m // 2 :])) / max(1, len(set(half))),
    ]


def bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)


def split_tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float) -> np.ndarray:
    """Values of a greedy tree with few leaves over the bins of one feature, from sums of gradients and curvatures."""
    G, H = np.cumsum(g), np.cumsum(h)
    parts, gain_of = [(0, len(g))], lambda a, b: a * a / (b + l2)
    for _ in range(leaves - 1):
        best = None
        for a, b in parts:
            if b - a < 2:
                continue
            g0, h0 = (G[a - 1], H[a - 1]) if a else (0.0, 0.0)
            gl, hl = G[a : b - 1] - g0, H[a : b - 1] - h0
            gt, ht = G[b - 1] - g0, H[b - 1] - h0
            gain = gain_of(gl, hl) + gain_of(gt - gl, ht - hl) - gain_of(gt, ht)
            k = int(gain.argmax())
            if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                best = (gain[k], a, a + k + 1, b)
        if best is None:
            break
        _, a, mid, b = best
        parts.remove((a, b))
        parts += [(a, mid), (mid, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Values of a tree that splits the rows of a 2-d table once and each side's columns once, and its gain."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    score = lambda a, b: a * a / (b + l2)
    best = None
    total = score(G[-1, -1], H[-1, -1])
    for i in range(len(g) - 1):
        sides = []
        for gs, hs in ((G[i], H[i]), (G[-1] - G[i], H[-1] - H[i])):
            gain = score(gs[:-1], hs[:-1]) + score(gs[-1] - gs[:-1], hs[-1] - hs[:-1])
            j = int(gain.argmax())
            sides.append((gain[j], j + 1))
        if best is None or sides[0][0] + sides[1][0] > best[0]:
            best = (sides[0][0] + sides[1][0], i + 1, sides[0][1], sides[1][1])
    out = np.zeros_like(g)
    if best is None:
        return out, 0.0
    gain, i, left, right = best
    for rows, j in ((slice(0, i), left), (slice(i, None), right)):
        for cols in (slice(0, j), slice(j, None)):
            out[rows, cols] = -g[rows, cols].sum() / (h[rows, cols].sum() + l2)
    return out, float(gain - total)


def fit(
    x: np.ndarray, y: np.ndarray, n_bins: int = 32, rounds: int = 120, pairs: int = 8, rate: float = 0.2, l2: float = 1.0
) -> dict:
    """Edges, tables and bias; x holds one row of features per label."""
    if not len(y) or y.min() == y.max():
        mean = float(y.mean()) if len(y) else 0.5
        return {"edges": [], "tables": [], "pairs": [], "bias": 0.0, "constant": mean}
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) for k in range(x.shape[1])]
    b = bins(x, edges)
    sizes = [len(e) + 1 for e in edges]
    bias = float(np.log(y.mean() / (1 - y.mean())))
    z, tables = np.full(len(y), bias), [np.zeros(s) for s in sizes]

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for k, s in enumerate(sizes):
            g, h = slopes()
            step = rate * split_tree(np.bincount(b[:, k], g, s), np.bincount(b[:, k], h, s), 3, l2)
            tables[k] += step
            z += step[b[:, k]]
    # the pairs with the largest gain left over
    coarse = 8
    cb = [np.minimum(b[:, k] * coarse // s, coarse - 1) for k, s in enumerate(sizes)]
    g, h = slopes()
    ranked = []
    for i in range(len(sizes)):
        for j in range(i + 1, len(sizes)):
            cell = cb[i] * coarse + cb[j]
            sums = [np.bincount(cell, v, coarse * coarse).reshape(coarse, coarse) for v in (g, h)]
            ranked.append((-pair_tree(*sums, l2)[1], i, j))
    chosen = [(i, j) for _, i, j in sorted(ranked)[:pairs]]
    grids = [np.zeros((coarse, coarse)) for _ in chosen]
    for _ in range(rounds // 2):
        for grid, (i, j) in zip(grids, chosen, strict=True):
            g, h = slopes()
            cell = cb[i] * coarse + cb[j]
            sums = [np.bincount(cell, v, coarse * coarse).reshape(coarse, coarse) for v in (g, h)]
            step = rate * pair_tree(*sums, l2)[0]
            grid += step
            z += step.ravel()[cell]
    maps = [np.minimum(np.arange(s) * coarse // s, coarse - 1) for s in sizes]
    found = [(i, j, grid[maps[i]][:, maps[j]]) for grid, (i, j) in zip(grids, chosen, strict=True)]
    return {"edges": edges, "tables": tables, "pairs": found, "bias": bias, "constant": None}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if model["constant"] is not None:
        return np.full(len(x), model["constant"])
    b = bins(x, model["edges"])
    z = np.full(len(x), model["bias"])
    for k, t in enumerate(model["tables"]):
        z += t[b[:, k]]
    for i, j, t in model["pairs"]:
        z += t[b[:, i], b[:, j]]
    return 1 / (1 + np.exp(-z))


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label: str, use: Column, most: int = 12_000) -> dict:
    """Fit from the labels of the documents whose id `use` (on a column doc_id) lets in.

    Only the ids and labels of the sample are sent around: they are at most `most` rows. So are the measured rows that
    the model is fitted on, even if many documents share an id: the first by a hash of the id, then by what was measured.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("_y"))
    known = known.where(use & F.col("_y").isin(0, 1))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(most)
    sample = sample.sparkSession.createDataFrame(sample.toPandas(), known.schema)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "_y")

    def measure(it):
        for batch, texts in chunks(it):
            x = matrix(texts)
            cols = [batch.column("doc_id"), batch.column("_y"), *(pa.array(x[:, k]) for k in range(x.shape[1]))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "_y", *FEATURES])

    kind = dict(rows.dtypes)["doc_id"]
    got = rows.mapInArrow(measure, f"doc_id {kind}, _y int, " + ", ".join(f"{f} double" for f in FEATURES))
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "_y", *FEATURES).limit(most).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")  # the same model whatever the order of tasks
    return fit(got[FEATURES].to_numpy(float), got["_y"].to_numpy(float))


def score(docs: DataFrame, text: str, model: dict, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Add the score of each whole text to the columns `keep` of `docs`."""
    keep = docs.columns if keep is None else keep
    inner = free("_text", [*keep, out])
    rows = docs.select(*keep, F.col(text).alias(inner))
    handle = share(docs.sparkSession, model)
    schema = StructType([*(f for f in rows.schema.fields if f.name not in (inner, out)), StructField(out, DoubleType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(it):
        model = shared(handle)
        for batch, texts in chunks(it, inner):
            cols = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(predict(model, matrix(texts)))], [*names, out])

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, text: str, model: dict, least: float = 0.5) -> DataFrame:
    """The documents whose score is at least `least`, with their own columns."""
    out = free("_score", docs.columns)
    return score(docs, text, model, out=out).where(F.col(out) >= least).drop(out)
