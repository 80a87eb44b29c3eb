"""Checks on physical plans, for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def no_pair_enumeration(df: DataFrame) -> bool:
    """No join that pairs every row with every row."""
    text = plan_text(df)
    return "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text


def stays_in_jvm(df: DataFrame) -> bool:
    text = plan_text(df)
    return not any(x in text for x in ("Python", "Pandas", "MapInArrow"))


def pushed_filters(df: DataFrame) -> str:
    return " ".join(x for x in plan_text(df).split("\n") if "PushedFilters" in x)
