import random
import re

import numpy as np
from pyspark.sql import functions as F

from examloom.llm import quality, urlfilter
from examloom.llm.queries import URL_RULES


def labelled(rng, n):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    out = []
    for k in range(n):
        ws = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        good = rng.random() < 0.7
        out.append((k, " ".join(ws).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in ws), int(good)))
    return out


def test_classifier_learns_and_handles_odd_rows(spark, frame):
    rows = labelled(random.Random(2), 300)
    odd = [(900, None, None), (901, "", None), (902, "x" * 300_000, None), (None, "No id.", None), (5, rows[5][1], None)]
    docs = frame([(i, t, None) for i, t, _ in rows] + odd)
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows] + [(7, None, 1), (None, 1, 0), (900, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, "doc_id", "text", labels, "quality", F.col("doc_id") % 3 != 1)
    got = quality.score(docs, "text", model).collect()
    assert len(got) == 305 and set(docs.columns) == set(got[0].asDict())
    score = {r.doc_id: r.score for r in got}
    assert all(0 <= s <= 1 for s in score.values())
    held = [(score[i] >= 0.5) == bool(q) for i, _, q in rows if i % 3 == 1]
    assert np.mean(held) > 0.98


def test_classifier_without_two_kinds(spark, frame):
    docs = frame([(1, "a", None), (2, None, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs, "doc_id", "text", labels, "quality", F.lit(True))
    assert [r.score for r in quality.score(docs, "text", model).collect()] == [0.5, 0.5]
    assert quality.score(frame([]), "text", model).count() == 0


def test_tables_add_up():
    rng = np.random.default_rng(0)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # only a pair tells
    model = quality.fit(x, y, rounds=40)
    assert (0, 1) in {(i, j) for i, j, _ in model["pairs"]}
    assert ((quality.predict(model, x) > 0.5) == y).mean() > 0.9
    b = quality.bins(x[:1], model["edges"])[0]
    z = model["bias"] + sum(t[b[k]] for k, t in enumerate(model["tables"])) + sum(t[b[i], b[j]] for i, j, t in model["pairs"])
    assert abs(1 / (1 + np.exp(-z)) - quality.predict(model, x[:1])[0]) < 1e-12


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_rules_and_model(spark):
    urls = [
        "http://www.Example.com/en/1", "http://example.com/en/2?x", "https://a.example.com/en/#f", "http://x.com/de",
        "http://x.com", "http://notcom/", "http://b.net/es/1", "http://b.net/fr", "http://b.net/fr/", "http://free-casino.org/a",
        "https://quiet-library.org/en/12", None, "", "no scheme", "://", "http://\u00c9T\u00c9.fr/\n?q", "http://ads-track.org/" + "a" * 100_000,
        "http://b.net/es/1", "x://y://z.com/p", "http://ads-track.org/1",
    ]
    df = spark.createDataFrame([(k, u, "h", 1.0) for k, u in enumerate(urls)], "page_id long, url string, host string, score double")
    model = spark.createDataFrame(urlfilter.labelled_rows(), "url string, blocked int")
    got = {r.page_id: r for r in urlfilter.judge(df, ["page_id"], "url", URL_RULES, model).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path = split(u)
        assert (got[k].host, got[k].path) == (host, path)
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            assert (got[k].rule, got[k].verdict) == max(fits)[1:]
        else:
            assert got[k].rule is None and got[k].verdict == ("block" if got[k].score >= 0.5 else "allow")
    assert got[9].verdict == "block" and got[10].verdict == "allow" and got[19].verdict == "block"


def test_url_models_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, blocked int")
    assert [r.verdict for r in urlfilter.judge(df, ["page_id"], "url", [("zz", "/", "block")], none).collect()] == ["allow"]
    assert urlfilter.judge(df.limit(0), ["page_id"], "url", URL_RULES, none).count() == 0
