"""Language model scores: a log-bilinear model over word classes, trained with noise-contrastive estimation.

Tokens are words, A-Z lower-cased, and one end per text. Every token belongs to one class: the commonest words and the
end are classes of their own, other words fall into classes by how they are spelt and whether they are in the
dictionary of the `dictionary` commonest words. P(token | two classes before) = P(class | two classes before) *
P(token | class). The first factor is the log-bilinear model: the context vectors of the two classes, each turned by
its position's matrix, are multiplied with every class vector at once and normalised over all classes. The second is
(c + 0.5) / (n + 0.5 (v + 1)) over the n tokens and v words of the class, one share of which is left to unknown words.
So the probabilities of all known words and one unknown word per class add up to 1.

Word counts, class counts and class trigram counts cover all training texts. They are summed in the tasks first. Only
bounded tables reach the driver: the dictionary, and at most `CLASSES ** 3` trigram counts, on which the model is
trained in numpy. Counts of words outside the dictionary never do: texts meet them in a join.

Defined cases: null text counts as empty, which is one end token; a null id is neither held out nor learned from;
without training tokens every base share is the smoothed one of a single unknown word, and classes are equally
likely; repeated rows are scored one by one and each counts in training.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .common import chunks, share, shared

CLASSES = 128
#: Spelling classes: in the dictionary or not, four kinds of letters, four kinds of endings. The end has class 0.
SPELT = 32
OWN = CLASSES - SPELT - 1


def tokens(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def spelling(word: bytes) -> int:
    """0 to 15: which letters beyond ASCII a word has, and how it ends."""
    letters = 0
    if not word.isascii():
        letters = 1 if b"\xc3\xb1" in word or b"\xc3\xb3" in word or b"\xc3\xad" in word else 2
        if b"\xc3\xbc" in word or b"\xc3\xb6" in word or b"\xc3\xa4" in word or b"\xc3\x9f" in word:
            letters = 3
    last = word[-1:]
    return letters * 4 + (0 if last.isalnum() or last >= b"\x80" else 1 if last == b"." else 2 if last == b"," else 3)


def class_of(word: bytes, rank: int, inside: bool) -> int:
    """rank: place among the commonest words, from 0."""
    return 1 + rank if inside and rank < OWN else 1 + OWN + 16 * (not inside) + spelling(word)


def word_counts(docs: DataFrame, text: str, most: int = 300_000) -> DataFrame:
    """word (bytes), c. Tasks add up their words and pass them on whenever they hold `most` different ones."""

    def count(it):
        def rows(seen):
            cols = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, ["word", "c"])

        seen: Counter = Counter()
        for _, texts in chunks(it, "_text", 2 << 20):
            for t in texts:
                seen.update(tokens(t))
            if len(seen) > most:
                yield rows(seen)
                seen = Counter()
        yield rows(seen)

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(count, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def dictionary_of(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """The commonest words, at most `most`, all down to one count; commonest first."""
    band = F.floor(F.log2("c") * 16).cast("int")
    bands = sorted(((r[0], r[1]) for r in counts.groupBy(band).count().collect()), reverse=True)
    held, least = 0, None
    for b, n in bands:
        if held + n > most:
            break
        held, least = held + n, b
    if least is None:
        return []
    got = counts.where(band >= least).toArrow()
    return sorted(zip(got["word"].to_pylist(), got["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


class Lexicon:
    """Class of each token of a text."""

    def __init__(self, words: list[tuple[bytes, int]]):
        self.number = {w: k + 1 for k, (w, _) in enumerate(words)}
        self.cls = np.array([0, *(class_of(w, k, True) for k, (w, _) in enumerate(words))], np.int32)
        self.count = np.array([0, *(c for _, c in words)], np.int64)

    def read(self, texts: list[bytes | None]):
        """Of all texts behind one another, an end behind each: dictionary numbers, classes, places of the ends, and
        the words and places that the dictionary lacks."""
        words: list[bytes] = []
        ends = []
        for t in texts:
            words += tokens(t)
            ends.append(len(words))
            words.append(b"")
        number = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        ends = np.array(ends, np.int64)
        cls = self.cls[number]
        missing = number == 0
        missing[ends] = False
        at = np.flatnonzero(missing)
        lacking = [words[k] for k in at.tolist()]
        cls[at] = np.fromiter((class_of(w, 0, False) for w in lacking), np.int32, len(lacking))
        cls[ends] = 0
        return number, cls, ends, lacking, at


def contexts(cls: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two tokens before; a text begins as if behind two ends."""
    one = np.concatenate([[0], cls[:-1]])
    two = np.concatenate([[0, 0], cls[:-2]])[: len(cls)]
    after = ends[ends + 1 < len(cls)] + 1  # first tokens but for the very first
    two[after] = 0
    return one, two


def trigrams(docs: DataFrame, text: str, lexicon) -> DataFrame:
    def count(it):
        lex, total = Lexicon(shared(lexicon)), np.zeros(CLASSES**3, np.int64)
        for _, texts in chunks(it, "_text", 2 << 20):
            _, cls, ends, _, _ = lex.read(texts)
            one, two = contexts(cls, ends)
            key = (two.astype(np.int64) * CLASSES + one) * CLASSES + cls
            found, n = np.unique(key, return_counts=True)
            total[found] += n
        found = np.flatnonzero(total)
        cols = [pa.array(found.astype(np.int32)), pa.array(total[found])]
        for k in range(0, max(1, len(found)), 100_000):
            yield pa.RecordBatch.from_arrays([c.slice(k, 100_000) for c in cols], ["key", "n"])

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(count, "key int, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def train(
    key: np.ndarray, n: np.ndarray, dims: int = 24, steps: int = 2000, batch: int = 2048, noise: int = 64,
    rate: float = 0.02, seed: int = 3,
) -> dict:
    """Fit context vectors, position matrices, class vectors and biases on weighted class trigrams.

    Each step draws trigrams by count and noise classes by their share; the model learns to tell the class that
    followed from the noise. Steps are scaled by running moments of the slopes.
    """
    rng = np.random.default_rng(seed)
    seen = np.bincount(key % CLASSES, n, CLASSES) + 0.5
    unigram = seen / seen.sum()
    p = {
        "r": rng.normal(0, 0.1, (CLASSES, dims)), "q": rng.normal(0, 0.1, (CLASSES, dims)),
        "c1": np.eye(dims), "c2": np.eye(dims) * 0.5, "b": np.log(unigram),
    }
    if not len(key):
        return p
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    cum, cum_noise = np.cumsum(n) / n.sum(), np.cumsum(unigram)
    log_noise, eye = np.log(noise * unigram), np.eye(CLASSES)
    for t in range(1, steps + 1):
        k = key[np.minimum(np.searchsorted(cum, rng.random(batch)), len(key) - 1)]
        w, h1, h2 = k % CLASSES, k // CLASSES % CLASSES, k // CLASSES**2
        z = np.minimum(np.searchsorted(cum_noise, rng.random(noise)), CLASSES - 1)
        r1, r2 = p["r"][h1], p["r"][h2]
        ctx = r1 @ p["c1"] + r2 @ p["c2"]
        s_data = (ctx * p["q"][w]).sum(1) + p["b"][w] - log_noise[w]
        s_noise = ctx @ p["q"][z].T + p["b"][z] - log_noise[z]
        g_data = -1 / (1 + np.exp(s_data)) / batch
        g_noise = 1 / (1 + np.exp(-s_noise)) / batch
        g_ctx = g_data[:, None] * p["q"][w] + g_noise @ p["q"][z]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        at_w, at_z, at_1, at_2 = (eye[x].T for x in (w, z, h1, h2))
        g["q"] = at_w @ (g_data[:, None] * ctx) + at_z @ (g_noise.T @ ctx)
        g["b"] = np.bincount(w, g_data, CLASSES) + np.bincount(z, g_noise.sum(0), CLASSES)
        g["c1"], g["c2"] = r1.T @ g_ctx, r2.T @ g_ctx
        g["r"] = at_1 @ (g_ctx @ p["c1"].T) + at_2 @ (g_ctx @ p["c2"].T)
        step = rate * (1 - t / (steps + 1))
        for name, x in p.items():
            m1[name] = 0.9 * m1[name] + 0.1 * g[name]
            m2[name] = 0.99 * m2[name] + 0.01 * g[name] ** 2
            x -= step * (m1[name] / (1 - 0.9**t)) / (np.sqrt(m2[name] / (1 - 0.99**t)) + 1e-8)
    return p


def class_log10(p: dict) -> np.ndarray:
    """log10 P(class | class two before, class before), one batch of contexts per class two before."""
    out = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
    for two in range(CLASSES):
        s = (p["r"] @ p["c1"] + p["r"][two] @ p["c2"]) @ p["q"].T + p["b"]
        s -= s.max(1, keepdims=True)
        out[two] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)
    return out


def class_sizes(counts: DataFrame, lexicon, ends: int) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens and words of each class."""

    def add(it):
        lex, n, v = Lexicon(shared(lexicon)), np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in it:
            words = b.column("word").to_pylist()
            k = np.fromiter(map(lex.number.get, words, repeat(0)), np.int64, len(words))
            cls = np.where(k > 0, lex.cls[k], [0 if i else class_of(w, 0, False) for w, i in zip(words, k, strict=True)])
            n += np.bincount(cls, b.column("c").to_numpy(), CLASSES).astype(np.int64)
            v += np.bincount(cls, minlength=CLASSES)
        cols = [pa.array(range(CLASSES), pa.int32()), pa.array(n), pa.array(v)]
        yield pa.RecordBatch.from_arrays(cols, ["cls", "n", "v"])

    rows = counts.mapInArrow(add, "cls int, n long, v long").groupBy("cls").agg(F.sum("n"), F.sum("v")).collect()
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in rows:
        n[r[0]], v[r[0]] = r[1], r[2]
    n[0], v[0] = ends, min(ends, 1)
    return n, v


def score(docs: DataFrame, keys: list[str], text: str, learn: Column, dictionary: int = 200_000) -> DataFrame:
    """Per row: keys, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    with scratch(docs.sparkSession) as keep:
        return keep(_score(docs, keys, text, learn, dictionary), "scores")


def _score(docs: DataFrame, keys: list[str], text: str, learn: Column, dictionary: int) -> DataFrame:
    spark = docs.sparkSession
    training = docs.where(learn)
    counts = materialize(word_counts(training, text), "words")
    ends = training.count()
    whole = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (whole[0] or 0) + ends, whole[1] + min(ends, 1)
    words = dictionary_of(counts, dictionary)
    lexicon = share(spark, words)
    n, v = class_sizes(counts, lexicon, ends)
    rows = trigrams(training, text, lexicon).toArrow()  # at most CLASSES ** 3 rows
    order = np.argsort(rows["key"].to_numpy())
    model = train(rows["key"].to_numpy()[order].astype(np.int64), rows["n"].to_numpy()[order].astype(float))
    inside = np.arange(CLASSES) <= OWN
    # log10 of what a class's counts are divided by; classes of one token have nothing to divide
    under = np.where(inside, 0.0, np.log10(np.maximum(n + 0.5 * (v + 1), 0.5)))
    handle = share(spark, (class_log10(model).ravel(), under, float(np.log10(total + 0.5 * (distinct + 1)))))

    kinds = dict(docs.dtypes)
    names = [*keys, "_n", "_known", "_base", "_score", "_id", "_word", "_times"]
    schema = ", ".join(
        [*(f"`{k}` {kinds[k]}" for k in keys), "_n long, _known long, _base double, _score double, _id string"]
        + ["_word array<binary>, _times array<int>"]
    )

    def judge(it):
        import uuid

        lex = Lexicon(shared(lexicon))
        table, under, base_under = shared(handle)
        log_count = np.log10(lex.count + 0.5)
        log_count[0] = 0.0
        own = lex.cls <= OWN
        in_class = np.where(own, 0.0, log_count)
        task, made = uuid.uuid4().hex, 0
        end_log = np.log10(ends + 0.5)
        for batch, texts in chunks(it, "_text", 2 << 20):
            number, cls, stop, lacking, at = lex.read(texts)
            one, two = contexts(cls, stop)
            token = table[(two.astype(np.int64) * CLASSES + one) * CLASSES + cls].astype(float)
            token += in_class[number] - under[cls]
            base = log_count[number] - base_under
            base[stop] += end_log
            start = np.concatenate([[0], stop[:-1] + 1])
            known = np.add.reduceat((number > 0).astype(np.int64), start) + int(ends > 0)
            edge = np.searchsorted(at, np.append(start, len(cls)))
            rare = [Counter(lacking[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            cols = [batch.column(k) for k in keys]
            cols += [pa.array(stop - start + 1), pa.array(known), pa.array(np.add.reduceat(base, start))]
            cols += [pa.array(np.add.reduceat(token, start))]
            cols += [pa.array([f"{task}-{made + k}" for k in range(len(texts))])]
            cols += [pa.array([list(x) for x in rare], pa.list_(pa.binary()))]
            cols += [pa.array([list(x.values()) for x in rare], pa.list_(pa.int32()))]
            made += len(texts)
            yield pa.RecordBatch.from_arrays(cols, names)

    got = docs.select(*keys, F.col(text).alias("_text")).mapInArrow(judge, schema)
    got = materialize(got, "scored")
    # words outside the dictionary meet their counts
    rare = got.select("_id", F.explode(F.arrays_zip("_word", "_times")).alias("x"))
    rare = rare.select("_id", F.col("x._word").alias("word"), F.col("x._times").alias("times"))
    least = words[-1][1] if words else 1 << 62
    found = rare.join(counts.where(F.col("c") <= least), "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = found.groupBy("_id").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.log10(c + 0.5) * F.col("times")).alias("logs")
    )
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return got.join(sums, "_id", "left").select(
        *keys,
        F.col("_n").alias("n_tokens"),
        (F.col("_known") + more).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("_base") + logs).alias("base_score"),
        (F.col("_score") + logs).alias("score"),
    )
