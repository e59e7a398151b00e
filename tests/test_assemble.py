import random

from pyspark.sql import functions as F

from vigil.functions import text as tx
from vigil.operators import assemble, embed
from vigil.plans import ingest
from vigil.sources import raw_lines

FIXTURE = [
    "stray before any header",
    "2025-01-01T00:00:00.000Z app-1 ERROR panic: nil pointer",
    "    at worker.go:10   ",
    "",
    "2025-01-01T00:00:01.000Z app-2 ",
    "2025-01-01T00:00:02.000Z app-2 \x1b[31mERROR upstream 502\x1b[0m",
    "tail of B",
]
A = "ERROR panic: nil pointer\n    at worker.go:10\n2025-01-01T00:00:01.000Z app-2"
B = "\x1b[31mERROR upstream 502\x1b[0m\ntail of B"


def frame(spark, lines, cuts=(), file="f"):
    rows, chunk = [], 0
    for i, line in enumerate(lines):
        chunk += i in cuts
        rows.append(("g", file, chunk * 1000, i, line))
    return spark.createDataFrame(
        rows, "log_group string, file string, chunk long, line_no long, line string"
    )


def events(df):
    out = assemble.assemble_events(df).orderBy("file", "event_no").collect()
    return [(r.log_stream, r.ts_ms, r.message) for r in out]


def test_fixture(spark):
    wanted = [("app-1", 1_735_689_600_000, A), ("app-2", 1_735_689_602_000, B)]
    assert events(frame(spark, FIXTURE)) == wanted
    for cuts in ([1], [2], [3, 4], [6], [1, 2, 3, 4, 5, 6]):
        assert events(frame(spark, FIXTURE, cuts)) == wanted


def fold(lines):
    out = []
    for line in lines:
        line = line.rstrip()
        if not line:
            continue
        head, _, rest = line.partition(" s ")
        if head.startswith("2025") and rest:
            out.append(rest)
        elif out:
            out[-1] += "\n" + line
    return out


def test_any_chunking_equals_one_pass(spark):
    rng = random.Random(11)
    for _ in range(4):
        lines = [
            rng.choice(["2025-01-01T00:00:00Z s m%d" % i, "  more %d" % i, "", "2025-01-01T00:00:00Z s "])
            for i in range(60)
        ]
        cuts = set(rng.sample(range(60), 12))
        assert [m for _, _, m in events(frame(spark, lines, cuts))] == fold(lines)


def test_files_do_not_mix(spark):
    one = frame(spark, FIXTURE, file="one")
    two = frame(spark, ["only a continuation"] + FIXTURE[1:2], file="two")
    assert [m for _, _, m in events(one.unionByName(two))] == [A, B, "ERROR panic: nil pointer"]


def test_split_files_keep_line_order(spark, tmp_path):
    folder = tmp_path / "group-a"
    folder.mkdir()
    lines = []
    for i in range(3000):
        lines += [f"2025-01-01T00:00:00.{i % 1000:03d}Z s event {i}", f"  line two of {i}", f"  line three of {i}"]
    (folder / "x.log").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        read = raw_lines.read_lines(spark, str(tmp_path))
        assert read.select("chunk").distinct().count() > 5
        got = assemble.assemble_events(read).orderBy("event_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.message for r in got] == [
        f"event {i}\n  line two of {i}\n  line three of {i}" for i in range(3000)
    ]
    assert {r.log_group for r in got} == {"group-a"}


def test_quality_filter_and_ids(spark):
    rows = spark.createDataFrame(
        [
            ("ok", [1.0, 0.0]), (" \t\n", [1.0]), ("zeros", [0.0, 0.0]), ("empty", []),
            ("nulls", [0.0, None, 0.0]), ("none", None), ("\x1b[31m\x1b[0m", [1.0]),
        ],
        "message string, embedding array<float>",
    ).select(F.lit("g").alias("log_group"), F.lit("s").alias("log_stream"), F.lit(1).cast("long").alias("ts_ms"), "*")
    kept, rejected = assemble.quality_filter(rows)
    assert [r.message for r in kept.collect()] == ["ok"]
    assert rejected.count() == 6
    counts = assemble.reject_counts(rows).first()
    assert (counts.total, counts.failed_embeddings, counts.blank_messages, counts.kept) == (7, 4, 2, 1)
    assert rows.select(assemble.stable_id()).distinct().count() == 7


def test_equal_lines_get_different_but_repeatable_ids(spark):
    lines = ["2025-01-01T00:00:00Z s same"] * 3
    embedder = embed.hash_embedder(8)
    first = {r.id for r in ingest.prepare(frame(spark, lines), embedder).collect()}
    again = {r.id for r in ingest.prepare(frame(spark, lines, [1]), embedder).collect()}
    assert len(first) == 3 and first == again


def test_model_embedder_turns_failures_into_rejects(spark):
    def load():
        def encode(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model down")
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    rows = spark.createDataFrame([("abc",), ("boom",)], "message string").repartition(2)
    out = embed.embed(rows, embed.model_embedder(load))
    assert {r.message: list(r.embedding) for r in out.collect()}["boom"] == []
    assert tx.EMBED_CAP == 4000
