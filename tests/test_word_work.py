"""The segment steps do little per word: no folding or regex before the shuffle, regions meet lines instead of words."""

from examloom.operators import segment as O
from examloom.sources import adapters as A

WORDS = "doc_id BIGINT, page INT, word_no INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_fold_only_what_may_be_the_item_word(spark):
    heads = ["QUESTÃO", "▬Questão", "questao", "QUESTÃO", "XQUESTAÓ", "QUESTAº"]
    others = ["QUESTAO.", "QUESTÕES", "pequeño", "ESTÃO", None, ""]
    rows = [(1, 0, 2 * k + j, text, 50.0, 20.0 * k, 60.0, 20.0 * k + 10)
            for k, head in enumerate(heads + others) for j, text in enumerate([head, f"{k + 1}"])]
    words = spark.createDataFrame(rows, WORDS)
    c = O.candidates(words)
    got = [r.number for r in c.filter("pattern = 'questao'").orderBy("word_no").collect()]
    assert got == list(range(1, len(heads) + 1))
    below = plan(c).split("Window", 1)[1]  # what is done with every word
    assert "translate(" not in below and "RLIKE" not in below


def test_words_become_rows_in_compiled_code(spark, tmp_path):
    text = "a  b\n\n c\n" + "\n".join("x" for _ in range(5))
    docs = [(k, text if k else None) for k in range(4)]
    spark.createDataFrame(docs, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    w = A.words(spark, str(tmp_path))
    got = [(r.word_no, r.text, r.x0, r.y0) for r in w.filter("doc_id = 1 and page = 0").orderBy("word_no").collect()]
    assert got[:6] == [(0, "1.", 51.5, 50.0), (1, "a", 130.0, 50.0), (2, "b", 150.0, 50.0), (3, "2.", 53.0, 68.0),
                       (4, "3.", 50.0, 86.0), (5, "c", 130.0, 86.0)]
    assert [g[1] for g in got[-4:]] == ["7.", "7.", "x", "8.", "x"][-4:]
    assert w.filter("text is null").count() == 1  # the document without text
    generate = [line for line in w._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate " in line]
    assert generate and all("*(" in line for line in generate)


def test_regions_meet_lines(spark):
    # two columns read one after the other: words of one height are not neighbours in reading order
    texts = {(0, 10.0): "1.", (1, 10.0): "a", (2, 30.0): "b", (3, 30.0): None, (4, 50.0): "2.", (5, 50.0): "c",
             (6, 10.0): "d", (7, 30.0): "e", (8, 50.0): "f"}
    words = spark.createDataFrame([(1, 0, no, t, 0.0, y, 1.0, y + 1) for (no, y), t in texts.items()], WORDS)
    anchors = spark.createDataFrame([(1, 0, 0, 10.0, 1), (1, 0, 4, 50.0, 2)], "doc_id BIGINT, page INT, word_no INT, y0 DOUBLE, number BIGINT")
    out = O.segment_text(words, anchors)
    assert {r.number: r.text for r in out.collect()} == {1: "1. a b d e", 2: "2. c f"}
    assert "collect_list" in plan(out).split("Join Inner", 1)[1]
