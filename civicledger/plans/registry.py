"""Views and queries: what each computes, from what, its output columns, and its oracle."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .domain import Domain, oracle

#: Portable output types: long, double (4 places), string (dates as ISO text), boolean, array joined by "|".
_SPARK: dict[str, Callable[[Column], Column]] = {
    "l": lambda c: c.cast("bigint"),
    "d": lambda c: F.round(c.cast("double"), 4),
    "s": lambda c: c.cast("string"),
    "b": lambda c: c.cast("boolean"),
    "a": lambda c: F.array_join(c, "|"),
}
_DUCK = {"l": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 4)", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)", "a": "array_to_string({0}, '|')"}


@dataclass(frozen=True)
class View:
    name: str
    columns: str  # "name:type ..."
    build: Callable[[Mapping[str, DataFrame]], DataFrame]
    body: str | None = None  # DuckDB SELECT (with its own CTEs, the last SELECT unnamed)
    reads: tuple[str, ...] = field(default=())

    def spec(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Domain(spark, sf_dir))
        return df.select(*[_SPARK[t](F.col(c)).alias(c) for c, t in self.spec()])

    def oracle(self) -> str | None:
        if self.body is None:
            return None
        out = ", ".join(f"{_DUCK[t].format(c)} AS {c}" for c, t in self.spec())
        return oracle(f"_result AS ({self.body}) SELECT {out} FROM _result", *self.reads)


VIEWS: dict[str, View] = {}


def view(name: str, columns: str, reads: str, body: str | None = None):
    """Register the decorated function (tables -> DataFrame) as a view."""

    def add(build):
        VIEWS[name] = View(name, columns, build, body, tuple(reads.split()))
        return build

    return add
