"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a small labelled URL table (at most `most` rows, chosen by hash where there
are more) and is one vector of `2 ** bits` weights. URLs are scored in Arrow batches, all n-grams of a batch at once.

Defined cases: a null URL or one without "://" has an empty host and path, fits no rule and gets the model's verdict;
repeated URLs get the same verdict; of rules that fit, the longest wins (host and path together, then the longer
host, then the greater text); without labelled rows of both kinds the model knows only their share (none: allow).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ascii_lower

HOST, PATH, END = b"\x02", b"\x03", b"\x04"
SIZES = (3, 4, 5)

#: Labelled URLs: words of unwanted and of wanted hosts, put into the same frames so that only the words differ.
BLOCK_WORDS = (
    "adult porn xxx sexcam escort nude spam link-farm farm pills cheap-pills pharmacy viagra cialis casino poker "
    "slots roulette jackpot bets betting free-bets sportsbook gamble win-cash lottery ads adserver ads-track track "
    "tracker tracking banner popup clickbait malware phishing keygen crack warez torrent-free cheap-loans payday "
    "replica-watches weight-loss get-rich forex-signals"
).split()
ALLOW_WORDS = (
    "news daily herald times post journal weather science physics history museum library school college campus math "
    "docs guide manual wiki encyclopedia recipes garden travel city council health clinic research open-data maps "
    "books reader poetry music theatre film sport-club football chess forum blog notes developer code project "
    "archive gallery market bakery farmers winter track-and-field adults-education betterment"
).split()
FRAMES = (
    "https://{}.com/", "http://www.{}.net/index.html", "https://blog.{}.org/en/12", "http://m.{}.com/fr/7?page=2",
    "https://{}.info/a/{}", "https://site.{}.net/de/{}.html",
)


def labelled_rows() -> list[tuple[str, int]]:
    return [(f.format(w, w), y) for y, ws in ((1, BLOCK_WORDS), (0, ALLOW_WORDS)) for w in ws for f in FRAMES]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host between "://" and the first of / ? # (A-Z lower-cased), path from there to the first of ? #."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule (host, path, verdict) that fits, else null."""
    table = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v")) for h, p, v in rules))
    fits = F.filter(
        table,
        lambda r: ((host == r["h"]) | F.endswith(host, F.concat(F.lit("."), r["h"]))) & F.startswith(path, r["p"]),
    )
    name = lambda r: F.concat(r["h"], r["p"])
    ranked = F.transform(
        fits,
        lambda r: F.struct(
            F.length(name(r)).alias("n"), F.length(r["h"]).alias("hn"), name(r).alias("rule"), r["v"].alias("verdict")
        ),
    )
    return F.array_max(ranked)


def grams(urls: list[tuple[bytes, bytes]], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """URL number and bucket of each n-gram, and each URL's number of n-grams."""
    parts = [HOST + h + PATH + p + END for h, p in urls]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    stop = np.cumsum(size)
    owner = np.repeat(np.arange(len(parts)), size)
    at = np.arange(len(data))
    head = np.repeat(stop - size + 1 + np.fromiter((len(h) for h, _ in urls), np.int64, len(urls)), size)
    field = (at >= head).astype(np.uint64)  # 0 in the host, 1 from the path on
    who, what = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            m = len(data) - n + 1
            if m <= 0:
                continue
            h = field[:m] * np.uint64(7919) + np.uint64(n)
            for k in range(n):
                h = (h ^ data[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            ok = at[:m] + n <= stop[owner[:m]]
            who.append(owner[:m][ok])
            what.append((h[ok] >> np.uint64(64 - bits)).astype(np.int64))
    who = np.concatenate(who) if who else np.zeros(0, np.int64)
    what = np.concatenate(what) if what else np.zeros(0, np.int64)
    return who, what, np.bincount(who, minlength=len(parts))


def fit(rows: list[tuple[bytes, bytes, int]], bits: int = 16, rounds: int = 400, rate: float = 0.5, l2: float = 1e-5, share: float = 0.17):
    """Weights and bias by full-batch gradient steps scaled by AdaGrad.

    `share` is the share of unwanted URLs expected in use: labelled rows are weighted to it, so that a URL without
    any known n-gram is taken for a usual one.
    """
    w, y = np.zeros(1 << bits), np.array([r[2] for r in rows], float)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.01) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return w, bias
    who, what, n = grams([r[:2] for r in rows], bits)
    each = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    scale = (1 / np.sqrt(np.maximum(n, 1)))[who]
    seen, seen_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        z = bias + np.bincount(who, w[what] * scale, len(y))
        g = (1 / (1 + np.exp(-z)) - y) * each
        gw = np.bincount(what, g[who] * scale, len(w)) + l2 * w
        seen += gw * gw
        seen_b += g.sum() ** 2
        w -= rate * gw / np.sqrt(seen)
        bias -= rate * g.sum() / np.sqrt(seen_b)
    return w, bias


def score(urls: list[tuple[bytes, bytes]], w: np.ndarray, bias: float) -> np.ndarray:
    if not urls:
        return np.zeros(0)
    who, what, n = grams(urls, int(len(w)).bit_length() - 1)
    z = bias + np.bincount(who, w[what], len(urls)) / np.sqrt(np.maximum(n, 1))
    return 1 / (1 + np.exp(-z))


def train(labelled: DataFrame, most: int = 20_000, bits: int = 16):
    """Fit from a table (url, blocked); at most `most` rows reach the driver."""
    host, path = host_path(F.col("url"))
    rows = labelled.where("blocked is not null").select(host.alias("h"), path.alias("p"), F.col("blocked").cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("h", "p"), "h", "p", "y").limit(most).collect()
    return fit([(r.h.encode(), r.p.encode(), r.y) for r in rows], bits)


def judge(
    df: DataFrame, keep: list[str], url: str, rules: list[tuple[str, str, str]], labelled: DataFrame, cut: float = 0.5
) -> DataFrame:
    """Per row: `keep`, host, path, rule, verdict and the model's score (chance that the URL is unwanted)."""
    w, bias = train(labelled)
    model = df.sparkSession.sparkContext.broadcast(w.astype(np.float32))
    host, path = host_path(F.col(url))
    rows = df.select(*keep, host.alias("host"), path.alias("path"))
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def batches(it):
        weights = model.value
        for b in it:
            pairs = list(zip(b.column("host").cast(pa.binary()).to_pylist(), b.column("path").cast(pa.binary()).to_pylist()))
            # about 4 MB of URLs at a time
            out, at, size = [], 0, 0
            for i, (h, p) in enumerate(pairs):
                size += len(h) + len(p)
                if size > 4 << 20:
                    out.append(score(pairs[at : i + 1], weights, bias))
                    at, size = i + 1, 0
            out.append(score(pairs[at:], weights, bias))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out))], [*b.schema.names, "score"])

    scored = rows.mapInArrow(batches, schema)
    rule = best_rule(F.col("host"), F.col("path"), rules)
    return scored.withColumn("_rule", rule).select(
        *keep,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= cut, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
