"""Documents with the awkward cases that every operator here has a defined result for."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, width: int = 7) -> str:
    rng = random.Random(seed)
    syllables = "an er the in on re at en nd ti es or ed is it al ar st to nt".split()
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]
    lines = [" ".join(words[i : i + width]).capitalize() + "." for i in range(0, n, width)]
    return "\n".join(lines)


@pytest.fixture(scope="session")
def texts():
    shared = prose(99, 120)
    near = prose(5, 200).split(" ")
    return [
        prose(1, 80), prose(1, 80), prose(2, 90) + "\n" + shared, shared + "\n" + prose(3, 70), prose(4, 400) + "\n" + shared,
        None, "", " \n\t ", "one", "one two three", "one two three", "é" * 300, "naïve café 漢字 \U0001f600 \x00 end", "a b " * 400,
        " ".join(near), " ".join(near[:-1] + ["changed"]), prose(6, 6000), "x" * 5000, "\n".join(["same line", "next line"] * 6),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[14], (None, texts[0], None, None, None), (40, texts[2], None, "s0", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("n_tokens", "ids", "spans", "key", "node", "shard", "slot", "n", "rep", "component_id", "lines", "a", "b", "h", "word", "score")
    return docs.withColumns({name: F.lit("x") for name in names})


@pytest.fixture(scope="session")
def by_id():
    def rows(df, key="doc_id"):
        return sorted((tuple(r) for r in df.collect()), key=str)

    return rows
