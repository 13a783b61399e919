"""Expectations checked on written results: a run saves first and fails after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wanderloop.functions.columns import is_true_text


class GateError(RuntimeError):
    """A control behaved against its known answer."""


def require_no_rows(df: DataFrame, bad: Column, message: str) -> None:
    if not df.filter(bad).isEmpty():
        raise GateError(message)


def require_all(df: DataFrame, good: Column, message: str) -> None:
    """Every row passes and there is at least one."""
    if df.isEmpty():
        raise GateError(f"{message}: no rows")
    require_no_rows(df, ~F.coalesce(good, F.lit(False)), message)


def refuse_stub_rows(df: DataFrame, flag: str = "is_stub") -> DataFrame:
    """Placeholder rows must not reach published tables."""
    if flag in df.columns:
        require_no_rows(df, is_true_text(F.col(flag)), "placeholder rows among the results")
    return df


def negative_control(df: DataFrame, trigger: str, name: str) -> None:
    require_no_rows(df, is_true_text(F.col(trigger)), f"negative control {name} fired")


def positive_control(df: DataFrame, trigger: str, name: str) -> None:
    require_all(df, is_true_text(F.col(trigger)), f"positive control {name} did not fire")


def full_space_rows(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The main table: full-space rows in a given column order."""
    full = refuse_stub_rows(df).filter(F.lower(F.trim("space")) == "full")
    return full.select(*[c for c in order if c in df.columns])
