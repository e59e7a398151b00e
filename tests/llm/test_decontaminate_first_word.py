from vigil.llm import decontaminate as dc

SHORT = "What is the boiling point of water"
LONG = "Minutes pass before the old train from the northern harbour reaches its last stop near the bridge"


def found(spark, rows):
    bench = spark.createDataFrame([(1, SHORT), (2, LONG)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in dc.matches(docs, bench).collect()}


BEFORE = ("", "Question: ", "1) ", "A heading line\n", "It ends here. ", "asked ", "15 ")


def test_copies_behind_any_word(spark):
    got = found(spark, [(2 * i + k, b + t) for i, b in enumerate(BEFORE) for k, t in enumerate((SHORT, LONG + " and more"))])
    assert set(got) == {(i, 1 + i % 2) for i in range(2 * len(BEFORE))}
    for r in got.values():
        assert r["contaminated"] and r["n_matched"] == r["n_windows"] and r["n_replaced"] == 0


def test_keep_drops_them(spark):
    bench = spark.createDataFrame([(1, SHORT)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Question: {SHORT}"), (2, "clean text")], "doc_id long, text string")
    assert [r["doc_id"] for r in dc.keep(docs, bench).collect()] == [2]


def test_another_first_word_is_no_copy(spark):
    assert not found(spark, [(1, "Question: Where is the boiling point of water"), (2, "is the boiling point of water")])
