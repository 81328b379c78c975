"""Plan checks used by tests: the scale rules expressed on physical plans.

Operators run jobs of their own before they return a (often small, local) result, so the plan of the result alone
shows no scan.  :func:`recorded_plans` notes the plan of everything that is run while it is open; the checks work on
such a list.
"""

from __future__ import annotations

from contextlib import contextmanager
from typing import Iterator

from pyspark.sql import DataFrame

_WIDE = {"spark.sql.maxMetadataStringLength": "100000", "spark.sql.debug.maxToStringFields": "10000"}


def physical_plan(df: DataFrame) -> str:
    """The physical plan as text, uncut."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in _WIDE}
    for k, v in _WIDE.items():
        conf.set(k, v)
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


@contextmanager
def recorded_plans() -> Iterator[list[str]]:
    """The plans of all frames that are collected or counted in the block."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame
    plans: list[str] = []
    actions = {name: getattr(Frame, name) for name in ("collect", "count", "toLocalIterator", "isEmpty")}

    def noting(action):
        def run(self, *args, **kwargs):
            plans.append(physical_plan(self))
            return action(self, *args, **kwargs)
        return run

    for name, action in actions.items():
        setattr(Frame, name, noting(action))
    try:
        yield plans
    finally:
        for name, action in actions.items():
            setattr(Frame, name, action)


def assert_no_single_partition(plans: list[str]) -> None:
    """Fail when a plan moves rows to one task: an exchange to a single partition may only carry what tasks have
    already aggregated to one row, or a limit."""
    for plan in plans:
        lines = plan.splitlines()
        for line, below in zip(lines, [*lines[1:], ""]):
            if "SinglePartition" in line and not ("functions=[partial_" in below or "Limit" in below):
                raise AssertionError("plan has a SinglePartition exchange:\n" + plan)


def assert_pruned_scan(plans: list[str], table: str, allowed: set[str]) -> None:
    """Fail when a scan of ``table`` reads columns outside ``allowed``, or when there is no scan of it."""
    scans = 0
    for line in (line for plan in plans for line in plan.splitlines()):
        if "FileScan" in line and f"{table}.parquet" in line and "ReadSchema" in line:
            scans += 1
            schema = line.split("ReadSchema:")[1].strip()
            schema = schema[len("struct<"):schema.index(">")] if schema.startswith("struct<") else schema
            names = [p.split(":")[0].strip() for p in schema.split(",")]
            extra = {n for n in names if n and n not in allowed}
            if extra:
                raise AssertionError(f"scan of {table} reads {extra}")
    if not scans:
        raise AssertionError(f"no plan scans {table}")
