from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Entry(run, sql)
        return run

    return register


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Sums of doubles differ in the last bits between engines and partitionings."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def as_long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")
