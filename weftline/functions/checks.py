"""Assertions on schemas, keys and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assert_schema(df: DataFrame, required: list[str], exact: bool = False, forbidden: tuple[str, ...] = ()) -> DataFrame:
    have = df.columns
    if exact and have != required or not set(required) <= set(have):
        raise ValueError(f"columns are {have}, wanted {required}")
    if bad := [c for c in have if any(f in c for f in forbidden)]:
        raise ValueError(f"forbidden columns: {bad}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not duplicates(df, keys).isEmpty():
        raise ValueError(f"{keys} isn't unique")
    return df


def assert_no_rows(violations: DataFrame, what: str) -> None:
    if not violations.isEmpty():
        raise AssertionError(f"{what}: {violations.first()}")


def join_one_to_one(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return assert_unique(a, keys).join(assert_unique(b, keys), keys, how)
