import pytest

from vigil.llm import decontaminate as dc

QUESTION = "A train leaves Paris at 5 miles per hour and meets Alice after 12 minutes on the way to the old harbour near the bridge."


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, QUESTION), (2, "seven words are quite enough to test"), (3, "too short"), (4, None), (5, ""), (1, QUESTION)]
    return spark.createDataFrame(rows, "item_id long, text string")


def found(spark, benchmark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string")
    return {(r["doc_id"], r["item_id"]): r for r in dc.matches(docs, benchmark).collect()}


def test_verbatim_and_reparameterised(spark, benchmark):
    other = QUESTION.replace("Paris", "Rome").replace("5 miles", "7 miles").replace("Alice", "Bob").replace("12", "30")
    got = found(
        spark, benchmark,
        [
            (1, f"Some prose before it. {QUESTION} And some prose behind it.", "x"), (2, other, "x"), (3, QUESTION.upper(), "x"),
            (4, "and now seven words are quite enough to test it", "x"), (5, None, "x"), (6, "", "x"), (7, "too short", "x"),
            (8, "Nothing of it is in this clean text about a train and the harbour.", "x"), (None, QUESTION, "x"), (9, QUESTION.replace(" ", "\n"), "x"),
        ],
    )
    assert {k for k, r in got.items() if r["contaminated"]} == {(1, 1), (2, 1), (4, 2), (7, 3), (None, 1), (9, 1)} | ({(3, 1)} & set(got))
    assert got[(1, 1)]["n_replaced"] == 0 and got[(2, 1)]["n_replaced"] == 4
    assert got[(2, 1)]["n_matched"] == got[(2, 1)]["n_windows"]


def test_inconsistent_slots_are_no_match(spark):
    item = "the value 5 is added to the value 5 and then the value 5 is taken from it"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.replace("5", "8"), ""), (2, "the value 1 is added to the value 2 and then the value 3 is taken from it", "")]
    got = found(spark, bench, rows)
    assert set(got) == {(1, 1)} and got[(1, 1)]["contaminated"]


def test_short_items_are_exact_word_sequences(spark):
    bench = spark.createDataFrame([(1, "name the capital"), (2, "add 5 and 7"), (3, "word")], "item_id long, text string")
    rows = [(1, "Now name the capital, please.", ""), (2, "name the old capital", ""), (3, "So: add 5 and 7!", ""), (4, "add 6 and 8", ""), (5, "a word", "")]
    assert set(found(spark, bench, rows)) == {(1, 1), (3, 2)}


def test_rows_that_share_an_id_are_judged_each(spark, benchmark):
    rows = [(None, QUESTION, "a"), (7, QUESTION, "b"), (None, "clean one", "c"), (None, "clean two", "d"), (7, "clean three", "e"), (8, "clean four", "f")]
    bad = spark.createDataFrame(rows, "doc_id long, text string, h string")
    assert sorted(r["h"] for r in dc.keep(bad, benchmark).collect()) == ["c", "d", "e", "f"]
    # two halves of an item in two texts of one id are no copy of it
    words = QUESTION.split(" ")
    halves = [(1, " ".join(words[:12]), ""), (1, " ".join(words[12:]), "")]
    got = dc.matches(spark.createDataFrame(halves, "doc_id long, text string, h string"), benchmark).collect()
    assert len(got) == 2 and all(r["n_matched"] < r["n_windows"] for r in got)


def test_tables_of_numbers(spark):
    bench = spark.createDataFrame([(1, " ".join(map(str, range(20))))], "item_id long, text string")
    rows = [(1, " ".join(map(str, range(20))), ""), (2, " ".join(map(str, range(50, 70))), "")]
    assert set(found(spark, bench, rows)) == {(1, 1)}


def test_keep(spark, docs, empty, clashing, benchmark):
    assert dc.keep(clashing, benchmark).columns == clashing.columns
    assert dc.keep(docs, benchmark).count() == docs.count()
    assert dc.keep(empty, benchmark).count() == 0
    assert dc.matches(docs, benchmark.limit(0)).count() == 0
    bad = spark.createDataFrame([(7, QUESTION), (None, "clean")], "doc_id long, text string")
    assert [r["doc_id"] for r in dc.keep(bad, benchmark).collect()] == [None]


def test_no_python_in_plan(docs, benchmark):
    plan = dc.matches(docs, benchmark)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan
