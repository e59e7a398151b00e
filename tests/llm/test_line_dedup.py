from vigil.llm import line_dedup as ld


def brute(rows, run):
    """rows: distinct (doc_id, text), in the order of ids."""
    seen, out = set(), {}
    for i, text in rows:
        lines = text.split("\n")
        gone = set()
        for j in range(len(lines) - run + 1):
            window = tuple(lines[j : j + run])
            if window in seen:
                gone |= set(range(j, j + run))
            seen.add(window)
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone) if gone else text
    return out


def test_against_brute_force(docs, texts, clashing):
    rows = [(i, t) for i, t in enumerate(texts) if t is not None] + [(40, texts[2])]
    for run in (1, 2, 3, 5):
        want = brute(rows, run)
        got = ld.dedup(clashing, run, alone=None).where("doc_id IS NOT NULL").collect()
        assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] != 5} == want
        assert all(r["text"] is None for r in got if r["doc_id"] == 5)
    out = ld.dedup(docs)
    assert out.columns[:-2] == docs.columns and out.count() == docs.count()
    # the null id comes last, so it loses what others have
    assert out.where("doc_id IS NULL").first()["text"] == ""


def test_runs_within_a_document(spark):
    rows = [(1, "a\nb\nc\na\nb\nd"), (2, "x\na\nb\nc\ny"), (3, "q"), (4, ""), (5, "a\na\na\na")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["__removed"]) for r in ld.dedup(df, 2).collect()}
    assert got == {1: ("a\nb\nc\nd", 2), 2: ("x\ny", 3), 3: ("q", 0), 4: ("", 0), 5: ("a", 3)}


def test_empty(empty):
    assert ld.dedup(empty).count() == 0 and ld.digests(empty).count() == 0


def test_no_python_in_plan(docs):
    plan = ld.dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan
