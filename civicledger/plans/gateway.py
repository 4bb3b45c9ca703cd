"""Read-only SQL: a guard, a schema snapshot for repairs, and steps run in order.

Spark's own parser decides what a statement is and what it does with columns; this module only refuses what isn't a
query, or one that takes other income for government funding. Statements run as they are given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# Words that no statement may hold, columns that are no funding, and what makes one pass for it.
FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|grant|revoke|copy|merge|execute|exec)\b", re.I)
#: Columns that hold investment and other income; to sum or call them government funding is a known error.
NOT_FUNDING = ("gov_funding_provincial", "gov_funding_other")
FUNDING = ("gov_funding_federal", *NOT_FUNDING)
AGGREGATES = ("sum", "avg", "mean", "max", "min")
CALLED_FUNDING = re.compile(r"^(total_)?(government|gov)_?(funding|revenue)", re.I)
CALLED_RIGHT = re.compile(r"investment[_ ]income|other[_ ]revenue", re.I)
#: Literals, quoted names and comments, whichever begins first.
SPANS = re.compile(r"""(?P<literal>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")|(?P<name>`(?:[^`]|``)*`)|(?P<comment>--[^\n]*|/\*.*?\*/)""", re.S)


def bare(sql: str) -> str:
    """The statement's own words: literals are empty, quoted names a letter, comments a space. Only to be looked at; what runs is the statement."""
    return SPANS.sub(lambda m: " " if m["comment"] else "''" if m["literal"] else "n", sql)


def nodes(tree) -> Iterator:
    """All nodes of a parsed plan or expression, through subqueries and WITH clauses too."""
    yield tree
    kind = tree.getClass().getSimpleName()
    below = [tree.children(), tree.innerChildren()]
    if tree.getClass().getClassLoader().loadClass("org.apache.spark.sql.catalyst.plans.QueryPlan").isInstance(tree):
        below.append(tree.expressions())
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        yield from nodes(tree.plan())
    seen = set()
    for seq in below:
        for i in range(seq.size()):
            child = seq.apply(i)
            if hasattr(child, "children") and (key := child.hashCode(), child.getClass().getName()) not in seen:
                seen.add(key)
                yield from nodes(child)


def columns_in(tree) -> set[str]:
    return {n.nameParts().last().lower() for n in nodes(tree) if n.getClass().getSimpleName() == "UnresolvedAttribute"}


def misuse(plan) -> str | None:
    """A column of NOT_FUNDING that the parsed statement aggregates, adds to others of FUNDING, or calls funding."""
    for n in nodes(plan):
        kind = n.getClass().getSimpleName()
        called = kind == "UnresolvedFunction" and n.nameParts().last().lower() in AGGREGATES
        named = kind == "Alias" and CALLED_FUNDING.match(n.name())
        added = kind == "Add" and len(columns_in(n) & set(FUNDING)) > 1
        if (called or named or added) and (found := sorted(columns_in(n) & set(NOT_FUNDING))):
            return found[0]
    return None


def guard(sql: str, spark: SparkSession | None = None) -> str:
    """The statement as it was given, if it is one query (SELECT, or WITH and SELECT); ValueError says why not."""
    words = bare(sql).strip().rstrip(";").strip()
    if not re.match(r"(select|with)\b", words, re.I):
        raise ValueError("only SELECT statements are run")
    if m := FORBIDDEN.search(words):
        raise ValueError(f"{m[0].upper()} isn't allowed")
    if ";" in words:
        raise ValueError("one statement at a time")
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and any(c in sql.lower() for c in NOT_FUNDING):
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except PySparkException:
            return sql.strip()  # what doesn't parse fails where it is run, with the parser's own words
        if c := misuse(plan):
            raise ValueError(f"{c} isn't government funding")
        if columns_in(plan) & set(NOT_FUNDING) and not CALLED_RIGHT.search(sql):
            raise ValueError(f"{' and '.join(NOT_FUNDING)} are to be called investment_income and other_revenue")
    return sql.strip()


def schema_snapshot(spark: SparkSession, sql: str) -> dict[str, list[str]]:
    """Columns of the catalog's tables and views that a statement names."""
    words = {w.lower() for w in re.findall(r"\w+", sql)}
    return {t.name: [c.name for c in spark.catalog.listColumns(t.name)] for t in spark.catalog.listTables() if t.name.lower() in words}


def run(spark: SparkSession, sql: str, repair: Callable[[str, str, dict], str] | None = None, rounds: int = 2) -> DataFrame:
    """Guard and plan a statement; a failing one goes to `repair(sql, error, schema)` up to `rounds` times."""
    for left in range(rounds, -1, -1):
        try:
            return spark.sql(guard(sql, spark))
        except PySparkException as e:
            if not left or repair is None:
                raise
            sql = repair(sql, str(e), schema_snapshot(spark, sql))
    raise AssertionError


def run_steps(spark: SparkSession, steps: list[tuple[str, str]], limit: int = 500) -> Iterator[tuple[str, dict]]:
    """Events of a plan's steps, (kind, data) as they happen; the last step with rows is the primary result."""
    primary = None
    for i, (purpose, sql) in enumerate(steps):
        yield "status", {"step": i, "purpose": purpose}
        try:
            rows = [r.asDict(True) for r in run(spark, sql).limit(limit).collect()]
        except (ValueError, PySparkException) as e:
            yield "step_error", {"step": i, "error": str(e)[:300]}
            continue
        primary = rows or primary
        yield "step_result", {"step": i, "rows": len(rows)}
    yield "rows", {"rows": primary or []}
    yield "done", {}
