"""Contracts and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame


def contract(df: DataFrame, fields: dict[str, str | None]) -> list[tuple[str, str]]:
    """For every required field: ok, missing, or the type it has instead of the required one."""
    there = dict(df.dtypes)
    return [(n, "missing" if n not in there else "ok" if kind in (None, there[n]) else there[n]) for n, kind in fields.items()]


def require(df: DataFrame, fields: dict[str, str | None]) -> DataFrame:
    if bad := [(n, s) for n, s in contract(df, fields) if s != "ok"]:
        raise ValueError(f"the table breaks its contract: {bad}")
    return df


def none_left(bad: DataFrame, what: str) -> None:
    """Raises if a query for violations finds any."""
    if not bad.isEmpty():
        raise ValueError(what)
