import random
import re

from pyspark.sql import functions as F

from vigil.functions import text as tx


def one(spark, column, **values):
    names = ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column).first()[0]


def test_ansi_and_embed_text(spark):
    raw = "\x1b[31mERROR upstream 502\x1b[0m"
    assert one(spark, tx.strip_ansi("m"), m=raw) == "ERROR upstream 502"
    assert len(one(spark, tx.embed_text("m"), m="x" * 4001)) == 4000


def test_trim_covers_unicode_space(spark):
    assert one(spark, tx.trim_end("m"), m="  a   ﻿\t\r") == "  a"
    assert one(spark, tx.trim_space("m"), m="　a b\n") == "a b"
    assert one(spark, tx.not_blank("m"), m=" \t\n ") is False


def test_truncate_and_preview(spark):
    assert one(spark, tx.truncate("m", 5), m="abcdef") == "ab..."
    assert one(spark, tx.truncate("m", 6), m="abcdef") == "abcdef"
    assert one(spark, tx.preview("m", 5), m="abcdef") == "abcde..."
    assert one(spark, tx.preview("m", 6), m="abcdef") == "abcdef"


def test_times_do_not_depend_on_the_session_zone(spark):
    ms = 1_735_689_600_123
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert one(spark, tx.iso_time("t"), t=ms) == "2025-01-01T00:00:00.123Z"
        assert one(spark, tx.iso_hour("t"), t=ms) == "2025-01-01T00"
        assert one(spark, tx.in_timezone("t", "America/New_York"), t=ms) == "12/31/2024, 7:00:00 PM"
        assert one(spark, tx.iso_to_ms("s"), s="2025-01-01T00:00:00.123Z") == ms
        assert one(spark, tx.iso_to_ms("s"), s="2025-01-01Tnope") is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_wall_clock_ignores_summer_time(spark):
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-07-01 12:00:00.123999' AS a, TIMESTAMP_NTZ'1969-12-31 23:59:59.9999' AS b")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert tuple(rows.select(tx.wall_clock_ms("a"), tx.wall_clock_ms("b")).first()) == (1_719_835_200_123, -1)
        assert one(spark, tx.iso_time("t"), t=1_719_835_200_123) == "2024-07-01T12:00:00.123Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_suspects(spark):
    hits = ["order 1500 shipped", "meeting room", "ERROR panic: nil", "DeadLock", "upstream 502", "Failed"]
    misses = ["INFO startup OK", "DEBUG cache miss", "code 49 and 5x5"]
    rows = spark.createDataFrame([(m,) for m in hits + misses], "m string")
    assert [r[0] for r in rows.where(tx.is_suspect("m")).collect()] == hits
    words = rows.where(tx.is_suspect("m", tx.SUSPECT_WORDS)).collect()
    assert [r[0] for r in words] == ["ERROR panic: nil", "DeadLock", "upstream 502", "Failed"]


def test_suspect_shortcut_equals_the_pattern(spark):
    rng = random.Random(5)
    pieces = ["err", "or", "ERROR", "oo", "m", "5", "00", "time", "out", "TimeOut", " ", "pan", "ic", "é", "K", "49"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 8))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "m string")
    got = [r[0] for r in rows.select(tx.is_suspect("m")).collect()]
    pattern = re.compile(tx.SUSPECT, re.ASCII)
    assert got == [bool(pattern.search(t)) for t in texts]


def test_failure_classes(spark):
    cases = {
        "curl: Connection refused": "Service not running",
        "request timed out": "Request timeout",
        "timeout 404": "Request timeout",
        "HTTP 404": "Endpoint not found",
        "HTTP 500": "Server error",
        "Could not resolve host: x": "Host unreachable",
        "other": "Connection failed",
    }
    for message, label in cases.items():
        assert one(spark, tx.failure_class("m"), m=message) == label


def test_templates(spark):
    m = "job 12 of 123e4567-e89b-12d3-a456-426614174000 at 0xBEEF took 1.5"
    assert one(spark, tx.message_template("m"), m=m) == "job <n> of <uuid> at <hex> took <n>.<n>"


def test_like_keeps_wildcards_and_takes_backslashes(spark):
    rows = spark.createDataFrame([("g", "s", r"100%_done\path"), ("g", "s", "100 done")], "a string, b string, c string")
    assert rows.where(tx.like_any(r"done\path", "a", "b", "c")).count() == 1
    assert rows.where(tx.like_any("1%d_ne", "a", "b", "c")).count() == 2
    assert rows.where(F.lit(True)).count() == 2
