"""Named collectors: what gathers rows for a query from one source."""

from __future__ import annotations

from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

RESULT = "source string, query string, key string, body string, reliability string"


class Collector(Protocol):
    name: str
    reliability: str

    def collect(self, spark: SparkSession, query: str, **params: Any) -> DataFrame: ...


class Stub:
    """A template: finds nothing."""

    name, reliability = "stub", "low"

    def collect(self, spark: SparkSession, query: str, **params: Any) -> DataFrame:
        return spark.createDataFrame([], RESULT)


_known: dict[str, type] = {Stub.name: Stub}


def register(name: str, kind: type) -> None:
    if lacking := [m for m in ("name", "reliability", "collect") if not hasattr(kind, m)]:
        raise TypeError(f"a collector needs {', '.join(lacking)}")
    _known[name] = kind


def get(name: str) -> type | None:
    return _known.get(name)


def names() -> list[str]:
    return sorted(_known)
