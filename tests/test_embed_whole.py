"""Texts longer than a model's input: whole, in pieces, and cut."""

from vigil.operators import embed


def vectors(spark, texts, **limits):
    def load():
        def encode(texts):
            assert all("boom" not in t for t in texts)
            return [[float(len(t)), float(t.count("x"))] for t in texts]

        return encode

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = embed.model_embedder(load, batch_size=3, **limits)(df, "t", "v")
    assert rows.columns == ["i", "t", "v"] and dict(rows.dtypes)["v"] == "array<float>"
    return [list(r.v) for r in rows.orderBy("i").collect()]


TEXTS = ["a" * 10 + "x" * 10 + "x" * 4, "short", "", None]


def test_whole_texts(spark):
    assert vectors(spark, TEXTS) == [[24.0, 14.0], [5.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_cap_drops_the_rest(spark):
    assert vectors(spark, TEXTS, cap=12) == [[12.0, 2.0], [5.0, 0.0], [0.0, 0.0], [0.0, 0.0]]


def test_all_pieces_are_pooled(spark):
    got = vectors(spark, [*TEXTS, "a" * 10 + "boom" + "a" * 30], chunk=10)
    assert [round(x, 4) for x in got[0]] == [8.0, round(14 / 3, 4)]
    assert got[1:] == [[5.0, 0.0], [0.0, 0.0], [0.0, 0.0], []]
