"""Turning windows into scored incidents: rule scorer, pluggable scorers, normalising, gating."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import text as tx
from vigil.schema import SCORER_BODY, SEVERITIES

# Lower bound of the suspect share for each severity, highest first.
RULES = ((0.5, "critical"), (0.25, "high"), (0.10, "medium"), (0.02, "low"))
CONFIDENCE_PRIOR = 5.0


def severity_rank(severity: Column | str) -> Column:
    """0 for info up to 4 for critical, -1 for anything else."""
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c).cast("int") - 1


def normalize_severity(severity: Column | str, compat: bool = False) -> Column:
    """Lower case; unknown becomes medium. `compat` sends info to medium as well."""
    c = F.lower(F.coalesce(F.col(severity) if isinstance(severity, str) else severity, F.lit("")))
    known = [s for s in SEVERITIES if not (compat and s == "info")]
    return F.when(c.isin(known), c).otherwise("medium")


def clamp_confidence(confidence: Column | str) -> Column:
    """A number in [0, 1]; text that is no finite number counts as 0."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    plain = tx.trim_space(c.cast("string"))
    # a cast alone would take suffixes like 5f, too
    number = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
    value = F.when(F.regexp_like(plain, F.lit(number)), plain.try_cast("double"))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))).otherwise(0.0)


def rule_scores(counts: DataFrame, *keep: str) -> DataFrame:
    """Score every (tick, group) of `group_counts(df, "tick_ms")` by its share of suspects."""
    ratio = F.col("n_suspects") / F.col("n")
    severity = None
    for bound, name in RULES:
        hit = ratio >= bound
        severity = F.when(hit, name) if severity is None else severity.when(hit, name)
    return counts.where(F.col("n_suspects") > 0).select(
        "tick_ms",
        "log_group",
        F.col("n").alias("total"),
        F.col("n_suspects").alias("suspects"),
        F.round(ratio, 4).alias("ratio"),
        severity.otherwise("info").alias("severity"),
        F.round(F.col("n_suspects") / (F.col("n_suspects") + CONFIDENCE_PRIOR), 4).alias("confidence"),
        F.format_string("%d suspect events in %s", "n_suspects", "log_group").alias("title"),
        F.format_string("%d of %d events matched", "n_suspects", "n").alias("summary"),
        *keep,
    )


def rule_incidents(counts: DataFrame, dedupe: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rule scores in the shape of parsed scorer output. `dedupe` may give a key."""
    return rule_scores(counts, *keep).select(
        "tick_ms",
        F.col("log_group").alias("ord"),
        "title",
        "severity",
        F.col("confidence").cast("string").alias("confidence"),
        (F.lit(None).cast("string") if dedupe is None else dedupe).alias("dedupe_key"),
        "summary",
        F.array(F.lit("rule")).alias("tags"),
        *keep,
    )


def rule_bodies(counts: DataFrame) -> DataFrame:
    """The rule scores as JSON texts, one per (tick, group), as an external scorer would answer."""
    item = F.struct("title", "severity", "confidence", "summary")
    return rule_scores(counts).select(
        "tick_ms", F.to_json(F.struct(F.array(item).alias("incidents"))).alias("body")
    )


def external_scorer(load: Callable[[], Callable[[str], str]]) -> Callable[[DataFrame], DataFrame]:
    """Wrap a scorer service or model: (tick_ms, prompt) rows to (tick_ms, body) rows.

    `load` runs once per task. An exception fails the task, so the window is retried
    and its cursor does not move.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            yield pd.DataFrame(
                {"tick_ms": batch["tick_ms"], "body": [score(p) for p in batch["prompt"]]}
            )

    return lambda prompts: prompts.select("tick_ms", "prompt").mapInPandas(
        run, "tick_ms long, body string"
    )


def parse_incidents(bodies: DataFrame) -> DataFrame:
    """Scorer bodies (tick_ms, body) to one row per incident; broken bodies give none."""
    parsed = bodies.withColumn("parsed", F.from_json("body", SCORER_BODY))
    return parsed.select("tick_ms", F.posexplode("parsed.incidents").alias("ord", "i")).select(
        "tick_ms",
        F.col("ord").cast("string").alias("ord"),
        F.col("i.title").alias("title"),
        F.col("i.severity").alias("severity"),
        F.col("i.confidence").alias("confidence"),
        F.col("i.dedupe_key").alias("dedupe_key"),
        F.col("i.summary").alias("summary"),
        F.coalesce("i.tags", F.array().cast("array<string>")).alias("tags"),
    )


def broken_bodies(bodies: DataFrame) -> DataFrame:
    """How many scorer answers held no incident list."""
    incidents = F.from_json("body", SCORER_BODY)["incidents"]
    return bodies.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(incidents.isNull()).alias("n_broken")
    )


def gate(
    incidents: DataFrame,
    min_severity: str = "medium",
    min_confidence: float = 60,
    compat: bool = False,
) -> DataFrame:
    """Normalise severity and confidence, keep what reaches both bounds (percent for the latter)."""
    if min_severity not in SEVERITIES:
        raise ValueError(f"unknown severity {min_severity!r}")
    clean = incidents.withColumns(
        {
            "severity": normalize_severity("severity", compat),
            "confidence": clamp_confidence("confidence"),
        }
    )
    return clean.where(
        (severity_rank("severity") >= SEVERITIES.index(min_severity))
        & (F.col("confidence") >= min_confidence / 100)
    )

