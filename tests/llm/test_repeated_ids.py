"""The near-duplicate stage where one doc_id has several texts."""

from strideframe.llm import simhash


def text(word, n=60):
    return " ".join(f"{word}{i * i}" for i in range(n))


def test_a_repeated_id_keeps_a_text_of_each_class(spark):
    rows = [(1, text("a"), "z"), (1, text("b"), "z"), (2, text("c"), "z"), (2, text("a"), "z"), (3, text("c"), "z"), (4, text("d"), "z"), (4, text("d"), "y"), (None, text("a"), "z")]
    want = sorted([(0, text("a"), "z"), (1, text("a"), "z"), (1, text("b"), "z"), (2, text("c"), "z"), (4, text("d"), "y")])
    for order in (rows, rows[::-1]):
        kept = simhash.one_of_each(spark.createDataFrame(order, "doc_id long, text string, source string"))
        assert sorted((r.doc_id or 0, r.text, r.source) for r in kept.collect()) == want
