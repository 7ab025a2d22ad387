import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, shard string, copies int, root long, key string, label int"


def rows_of(docs):
    """(doc_id, text, source) to rows with further columns whose names clash with those of the operators."""
    return [(i, t, None, s, None if t is None else len(t), 0.5, 1, "x", 3, 4, "k", 1) for i, t, s in docs]


@pytest.fixture(scope="session")
def frame(spark):
    return lambda docs: spark.createDataFrame(rows_of(docs), SCHEMA)


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, an empty, a null, blanks, one long text and a null id."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)] + ["the", "of", "and"] * 40
    texts = [sentence(rng, rng.randint(1, 120), words) for _ in range(60)]
    base = sentence(rng, 150, words)
    for k in range(12):
        ws = base.split()
        for _ in range(k % 5):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(ws))
    texts += [texts[0]] * 7 + ["", None, "  \n\t ", "Only Two", "only two", "ONE", "\u00e9t\u00e9 \U0001f600 \u00e9t\u00e9"]
    texts.append(sentence(rng, 20_000, words))
    docs = [(k, t, [None, "a", "b", "c"][k % 4]) for k, t in enumerate(texts)]
    docs.append((None, "a text without any id of its own at all", "a"))
    docs.append((3, texts[3], "b"))  # a repeated row
    docs.append((3, texts[3], "b"))
    return docs
