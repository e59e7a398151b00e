from vigil.llm import line_dedup as ld

LONG = "one passage of many words that stands on a single line in several documents, between other neighbours each time"


def brute(rows, run, alone):
    """rows: distinct (doc_id, text), in the order of ids."""
    seen, out = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        gone = set()
        for j in range(len(lines)):
            for n in {1, run} if len(lines[j].encode()) >= alone else {run}:
                window = tuple(lines[j : j + n])
                if len(window) == n:
                    gone |= set(range(j, j + n)) if window in seen else set()
                    seen.add(window)
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else text
    return out


def test_a_long_line_between_other_neighbours(spark):
    rows = [(1, f"a\n{LONG}\nb"), (2, f"c\n{LONG}\nd"), (3, LONG), (4, "x\nshort\ny"), (5, "z\nshort\nw"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["__removed"]) for r in ld.dedup(df).collect()}
    assert got == {
        1: (rows[0][1], 0), 2: ("c\nd", 1), 3: ("", 1), 4: (rows[3][1], 0), 5: (rows[4][1], 0), 6: (None, 0),
    }


def test_against_brute_force(docs, texts, clashing):
    rows = [(i, t) for i, t in enumerate(texts) if t is not None] + [(40, texts[2])]
    for run, alone in ((2, 40), (5, 45), (3, 0)):
        got = ld.dedup(clashing, run, alone=alone).where("doc_id IS NOT NULL").collect()
        assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] != 5} == brute(rows, run, alone)
    out = ld.dedup(docs, alone=40)
    assert out.columns[:-2] == docs.columns and out.count() == docs.count()
    assert "Python" not in out._jdf.queryExecution().toString()
