"""Arrow functions over the kernels; everything else is a Catalyst expression."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeloom.functions import kernels
from codeloom.runtime import ship


def lift(spark: SparkSession, returns: str, f: Callable) -> Callable:
    """An Arrow function that applies f to the values of its columns; a null in any of them gives null."""
    ship(spark)

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns)], dtype=object)

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, returns)


def normalise(spark: SparkSession) -> Callable:
    return lift(spark, "string", kernels.normalise)


def match_key(spark: SparkSession) -> Callable:
    return lift(spark, "string", kernels.match_key)


def lexical_tokens(spark: SparkSession) -> Callable:
    return lift(spark, "array<string>", kernels.lexical_tokens)


def lexical_vector(spark: SparkSession, dims: int = kernels.DIMS) -> Callable:
    return lift(spark, "array<double>", lambda text: kernels.lexical_vector(text, dims).tolist())


def segment_spans(spark: SparkSession, min_spans: int = 2, max_words: int = 40) -> Callable:
    return lift(spark, "array<struct<start:int,end:int>>", lambda text: [{"start": a, "end": b} for a, b in kernels.segment_spans(text, min_spans, max_words)])


def locate(spark: SparkSession, threshold: float = 0.85) -> Callable:
    names = ("found", "score", "start", "end")
    ship(spark)

    def run(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernels.locate(q or "", t or "", threshold) for q, t in zip(quote, text)], columns=names)

    run.__annotations__ = {"quote": pd.Series, "text": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "found boolean, score double, start int, end int")


def longest_shared_run(spark: SparkSession) -> Callable:
    return lift(spark, "int", lambda text, segments: kernels.longest_shared_run(text, list(segments)))


def repair_mojibake(spark: SparkSession) -> Callable:
    return lift(spark, "string", kernels.repair_mojibake)
