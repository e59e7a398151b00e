"""Vector expressions over `array<float>` columns, evaluated in the JVM."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(
            _col(a), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
        )
    )


def cosine_distance(
    a: Column | str,
    b: Column | str,
    a_norm: Column | None = None,
    b_norm: Column | None = None,
) -> Column:
    """1 - cosine similarity in double precision; null where a norm is zero.

    Pass stored norms to save one pass over each vector.
    """
    scale = (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm)
    return 1 - F.try_divide(dot(a, b), scale)


def vector_literal(values: list[float]) -> Column:
    """A constant vector. Parsed from one text, which the optimizer folds to a literal array."""
    text = json.dumps([float(v) for v in values], allow_nan=False)
    return F.from_json(F.lit(text), T.ArrayType(T.DoubleType()))


def vector_from_json(c: Column | str) -> Column:
    return F.from_json(_col(c), T.ArrayType(T.FloatType()))


def is_usable(v: Column | str) -> Column:
    """Not null, not empty, not made of zeros and nulls only."""
    v = _col(v)
    non_zero = F.exists(v, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)) != 0)
    return F.coalesce((F.size(v) > 0) & non_zero, F.lit(False))


def mean_pool(tokens: Column | str, pooling: str = "mean") -> Column:
    """One `array<double>` from the token vectors of a row; empty where there are none."""
    tokens = _col(tokens)
    first = F.element_at(tokens, 1).cast("array<double>")
    if pooling == "first":
        pooled = first
    else:
        pooled = F.transform(
            F.sequence(F.lit(1), F.size(first)),
            lambda i: F.aggregate(
                tokens,
                F.lit(0.0),
                lambda total, token: total + F.element_at(token, i).cast("double"),
            )
            / F.size(tokens),
        )
    has_tokens = (F.size(tokens) > 0) & (F.size(F.element_at(tokens, 1)) > 0)
    return F.when(has_tokens, pooled).otherwise(F.array().cast("array<double>"))


def mean_by_key(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key over rows: a partial (map-side) aggregate of fixed size."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return (
        df.where(is_usable(vector))
        .select(key, array_to_vector(_col(vector)).alias("v"))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("v")).alias("m"))
        .select(key, "n", vector_to_array("m").alias("mean_vector"))
    )


def register_sql_functions(spark: SparkSession) -> None:
    """Make the cosine distance callable from SQL text, without Python per row."""
    for name in ("vec_cosine_distance", "cosine_distance"):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}"
            "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
            "1 - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (t, p) -> t + p)"
            " / nullif(sqrt(aggregate(a, 0D, (t, x) -> t + x * x))"
            " * sqrt(aggregate(b, 0D, (t, y) -> t + y * y)), 0D)"
        )
