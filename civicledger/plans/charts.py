"""What to draw of a table: fields, aggregation and kind from a profile and a stated goal; and which file to load.

Decisions are taken on a collected profile (a row for each column) or on the schema; data stays in DataFrames.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.relational import first_by, top_k
from ..sources import bounded
from . import tables
from .registry import view

# Words of a goal that name a kind of chart, the first kind with one wins.
GOALS = [("line", ["trend", "overtime", "timeseries", "timeline"]), ("scatter", ["scatter", "correlation", "relationship", "versus"]), ("bar", ["bar", "compare", "comparison", "top", "breakdown"])]
POINTS = 200


def _plain(text: str | None) -> str:
    return re.sub("[^a-z0-9]+", "", (text or "").lower())


def kind_of_goal(goal: str | None) -> str | None:
    return next((kind for kind, words in GOALS if any(w in _plain(goal) for w in words)), None)


def _named(columns: list[dict], name: str) -> dict:
    found = [c for c in columns if c["column"] == name] or [c for c in columns if _plain(c["column"]) == _plain(name)]
    if not found:
        raise ValueError(f"no column {name!r}; there are {', '.join(c['column'] for c in columns)}")
    return found[0]


def _first(columns: list[dict], goal: str | None) -> dict | None:
    """The first column that the goal names, else the first."""
    return next((c for c in columns if _plain(c["column"]) and _plain(c["column"]) in _plain(goal)), columns[0] if columns else None)


def choose_fields(profiled: list[dict], kind: str, goal: str | None = None, x: str | None = None, y: str | None = None, group: str | None = None) -> tuple[str, str | None, str | None]:
    """(x, y, group) of a chart: what is asked for if it fits, else by roles. A line runs over a time, bars over the
    place or category with the fewest values (two at least), a scatter over two measures; bars may do without y."""
    measures = [c for c in profiled if c["role"] == "measure"]
    if x is not None:
        over = _named(profiled, x)
    elif kind == "line":
        over = _first([c for c in profiled if c["role"] == "time"], goal)
    elif kind == "scatter":
        over = _first(measures, goal)
    else:
        over = _first(sorted((c for c in profiled if c["role"] in ("geography", "category") and c["distinct"] > 1), key=lambda c: c["distinct"]), goal)
    if over is None:
        raise ValueError(f"no column fits the x axis of a {kind} chart")
    if y is not None:
        value = _named(profiled, y)
        if value["role"] != "measure":
            raise ValueError(f"{value['column']} isn't a measure")
    else:
        named = [c for c in measures if goal and _plain(c["column"]) in _plain(goal)]
        value = named[0] if named else measures[1] if kind == "scatter" and len(measures) > 1 else measures[0] if measures else None
        if value is None and kind != "bar":
            raise ValueError(f"no measure for a {kind} chart")
    by = None if group is None else _named(profiled, group)
    if by is not None and by["role"] in ("measure", "time"):
        raise ValueError(f"{by['column']} can't group a chart")
    return over["column"], value and value["column"], by and by["column"]


def choose_aggregation(df: DataFrame, x: str, y: str | None, group: str | None = None, asked: str | None = None, goal: str | None = None) -> str:
    """What is asked for; else count without a measure, none if no (x, group) comes twice, and if one does the average
    of what the measure's name or the goal calls a rate, and the sum of anything else."""
    if asked not in (None, "auto"):
        return asked
    if y is None:
        return "count"
    keys = [x] + ([group] if group else [])
    return "none" if df.where(F.col(x).isNotNull()).groupBy(*keys).count().where("count > 1").isEmpty() else "avg" if is_rate(f"{goal or ''} {y}") else "sum"


# Words that make a measure one to average.
RATES = ["average", "avg", "mean", "rate", "pct"]


def is_rate(text: str) -> bool:
    return "%" in text or "percent" in text.lower() or any(w in _plain(text) for w in RATES)


def scatter(df: DataFrame, x: str, y: str, group: str | None = None, limit: int = POINTS) -> DataFrame:
    """(x, y, group) of rows where both are numbers, the first `limit` by x and y."""
    number = lambda c: F.regexp_replace(F.col(c).cast("string"), "[$,%\\s]", "").try_cast("double")
    points = df.select(number(x).alias("x"), number(y).alias("y"), *([F.col(group).alias("group")] if group else [])).where("x IS NOT NULL AND y IS NOT NULL")
    return top_k(points, [F.asc("x"), F.asc("y")], limit)


def prepare(df: DataFrame, profiled: list[dict], goal: str | None = None, kind: str | None = None, asked: str | None = None, **fields) -> tuple[DataFrame, dict]:
    """A chart's points (POINTS at most) and its specification."""
    suggested = tables.suggest_charts(profiled)
    kind = kind or kind_of_goal(goal) or (suggested[0][0] if suggested else "bar")
    x, y, group = choose_fields(profiled, kind, goal, **fields)
    if kind == "scatter":
        return scatter(df, x, y, group), vega_lite(kind, x, y, group, "quantitative")
    how = choose_aggregation(df, x, y, group, asked, goal)
    number = df if y is None else df.withColumn(y, F.regexp_replace(F.col(y).cast("string"), "[$,%\\s]", "").try_cast("double"))
    points = tables.chart(number, x, y, group, "max" if how == "none" else how, POINTS, by_value=kind == "bar")
    return points, vega_lite(kind, x, y if y and how != "count" else "count", group, "temporal" if kind == "line" else "nominal", how)


def vega_lite(kind: str, x: str, y: str, group: str | None, x_type: str, how: str = "none") -> dict:
    """A Vega-Lite specification over points named x, value (or y) and group."""
    second = "y" if kind == "scatter" else "value"
    encoding = {"x": {"field": "x", "type": x_type, "title": x}, "y": {"field": second, "type": "quantitative", "title": y if how in ("none", "count") else f"{how} of {y}"}}
    if group:
        encoding["color"] = {"field": "group", "type": "nominal", "title": group}
    return {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "mark": {"line": "line", "bar": "bar", "scatter": "point"}[kind], "encoding": encoding}


# Names that speak of a time, what reads as a number, how many rows tell, and kinds of charts.
TEMPORAL = r"year|date|fiscal|quarter|month"
PLAIN_NUMBER = r"^\s*-?\d+(\.\d+)?\s*$"
#: Rows of a result by which its columns are judged.
LOOKED_AT = 200
CHARTS = ("bar", "line", "kpi", "stacked_bar", "grouped_bar", "multi_line")


def column_kinds(df: DataFrame) -> tuple[dict[str, str], int]:
    """numeric, temporal, categorical or empty by the values of the first rows (numbers may be text), and how many rows
    these are; a name that speaks of a time makes a column temporal. One row comes to the driver."""
    first = df.limit(LOOKED_AT)
    text = lambda c: F.nullif(F.col(f"`{c}`").cast("string"), F.lit(""))
    counts = [x for i, c in enumerate(df.columns) for x in (F.count(text(c)).alias(f"n{i}"), F.count_if(text(c).rlike(PLAIN_NUMBER)).alias(f"m{i}"))]
    r, out = first.agg(F.count("*").alias("rows"), *counts).first(), {}
    for i, f in enumerate(df.schema.fields):
        if not r[f"n{i}"]:
            out[f.name] = "empty"
        elif isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType) or re.search(TEMPORAL, f.name, re.I):
            out[f.name] = "temporal"
        else:
            out[f.name] = "numeric" if isinstance(f.dataType, T.NumericType) or r[f"m{i}"] == r[f"n{i}"] else "categorical"
    return out, r["rows"]


def pick_chart(df: DataFrame, hint: dict | None = None) -> dict:
    """How to show a result: a figure, lines over time (one for each value of a category), stacked or grouped bars, a
    line, bars, a scatter, or the table itself. A hint chooses the series, grouped bars, and the title."""
    kinds, few = column_kinds(df)
    hint = hint if hint and hint.get("type") in CHARTS else {}
    by = {k: [c for c, x in kinds.items() if x == k] for k in ("numeric", "temporal", "categorical")}
    n, t, c = by["numeric"], by["temporal"], by["categorical"]
    named = {"title": hint["title"]} if hint.get("title") else {}
    if few == 0:
        return {"type": "none"}
    if few == 1 and len(n) == 1:
        return {"type": "kpi", "y": n[0]} | named
    if len(t) == 1 and c and len(n) == 1 and few > 1:
        series = hint["series"] if hint.get("type") == "multi_line" and hint.get("series") in df.columns else c[0]
        return {"type": "multi_line", "x": t[0], "y": n[0], "series": series} | named
    if not t and len(c) >= 2 and len(n) == 1 and few > 1:
        return {"type": "grouped_bar" if hint.get("type") == "grouped_bar" else "stacked_bar", "x": c[0], "y": n[0], "series": c[1]} | named
    if len(t) == 1 and len(n) == 1 and few > 1:
        return {"type": "line", "x": t[0], "y": n[0]} | named
    if c and len(n) == 1 and few > 1:
        return {"type": "bar", "x": c[0], "y": n[0]} | named
    return {"type": "scatter", "x": n[0], "y": n[1]} if len(n) >= 2 else {"type": "table"}


# Lines and bars of a chart with series at most, the last one being all others; single bars at most.
SERIES, STACKED, BARS = 8, 6, 25


def chart_rows(df: DataFrame, spec: dict, this_year: int | None = None) -> DataFrame:
    """The rows that a picked chart draws: few series and "Other", years that can be, lines by time, the largest bars."""
    from datetime import UTC, datetime

    kind = spec["type"]
    number = lambda c: F.col(f"`{c}`").cast("string").try_cast("double")
    if kind in ("multi_line", "stacked_bar", "grouped_bar"):
        keep = SERIES if kind == "multi_line" else STACKED
        named = df.withColumn("_s", F.coalesce(F.col(f"`{spec['series']}`").cast("string"), F.lit("—"))).withColumn("_y", F.coalesce(number(spec["y"]), F.lit(0.0)))
        top = named.groupBy("_s").agg(F.sum("_y").alias("_t")).orderBy(F.desc("_t"), "_s").limit(keep - 1).select(F.col("_s").alias("_top"))
        joined = named.join(F.broadcast(top), F.col("_s") == F.col("_top"), "left")  # SERIES rows at most
        return joined.withColumn(spec["series"], F.when(F.col("_top").isNotNull(), F.col(f"`{spec['series']}`")).otherwise(F.lit("Other"))).select(*df.columns)
    if kind == "line":
        x, last = number(spec["x"]), (this_year or datetime.now(UTC).year) + 2
        can_be = x.isNull() | (x != F.floor(x)) | x.between(1990, last)
        return df.where(can_be).orderBy(F.coalesce(x, F.lit(0.0)), F.col(f"`{spec['x']}`"))
    if kind == "bar":
        return df.orderBy(F.coalesce(number(spec["y"]), F.lit(0.0)).desc(), F.col(f"`{spec['x']}`")).limit(BARS)
    return df


def chart_hint(answer: str) -> tuple[str, dict | None]:
    """A generated statement without its fences and `-- CHART: {..}` lines, and the last line's hint if it is a sound one."""
    import json

    sql = re.sub(r"\n?```$", "", re.sub(r"^```sql\n?", "", answer.strip(), flags=re.I)).strip()
    lines = r"^[ \t]*--[ \t]*CHART[ \t]*:[ \t]*(\{.*\})[ \t]*$"
    found, hint = re.findall(lines, sql, re.I | re.M), None
    if found:
        try:
            said = json.loads(found[-1])
        except ValueError:
            said = None
        if isinstance(said, dict) and said.get("type") in CHARTS:
            hint = {"type": said["type"]} | {k: said[k] for k in ("x", "y", "series", "title") if isinstance(said.get(k), str) and 0 < len(said[k]) < 200}
    return re.sub(lines, "", sql, flags=re.I | re.M).strip(), hint


# What a file's format counts, for analysis and otherwise.
FORMAT_SCORES = [("CSV", 40, 25), ("GEOJSON", 35, 30), ("JSON", 35, 30), ("JSONL", 30, 20), ("XML", 15, 15), ("TXT", 10, 10), ("HTML", -20, 0)]
STRUCTURED = ["CSV", "TSV", "JSON", "JSONL", "GEOJSON", "XML", "TXT"]


def resource_score(format_: Column, for_analysis: bool = True, for_maps: bool = False) -> Column:
    """How well a file of a format serves: structured text counts 100 beside its format's own score."""
    f = F.upper(F.coalesce(format_, F.lit("")))
    own = reduce(lambda c, s: c.when(f == s[0], F.lit(80 if for_maps and s[0] == "GEOJSON" else 10 if for_maps and s[0] == "JSON" else s[1] if for_analysis else s[2])), FORMAT_SCORES, F.when(F.lit(False), F.lit(0)))
    return F.when(f.isin(*STRUCTURED), 100).otherwise(0) + F.coalesce(own, F.lit(0))


def file_score(for_analysis: bool = True, for_maps: bool = False) -> Column:
    """How well a file serves, by its columns format, mime, url, datastore (whether rows can be queried) and kind.

    Beside its format: 15 for a queried store, 5 (for analysis) or 10 for an API, for maps 60 for what looks like
    GeoJSON. It is structured text by declared format, by media type, or without one by the ending of its address.
    """
    kind, at, f = F.lower(F.coalesce("mime", F.lit(""))), F.lower(F.coalesce("url", F.lit(""))), F.upper(F.coalesce("format", F.lit("")))
    ending = F.regexp_extract(F.split_part(F.split_part(at, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), r"\.([a-z0-9]+)/*$", 1)
    text = f.isin(*[x.upper() for x in bounded.TEXT_ENDINGS]) | reduce(lambda a, b: a | b, [F.contains(kind, F.lit(x)) for x in bounded.TEXT_TYPES]) | ((kind == "") & ending.isin(*bounded.TEXT_ENDINGS))
    geo = (f == "GEOJSON") | F.contains(kind, F.lit("application/geo+json")) | F.endswith(at, F.lit(".geojson")) | F.contains(at, F.lit("f=geojson"))
    own = resource_score(F.col("format"), for_analysis, for_maps) - F.when(f.isin(*STRUCTURED), 100).otherwise(0)
    api = F.when(F.lower(F.coalesce("kind", F.lit(""))) == "api", 5 if for_analysis else 10).otherwise(0)
    return F.when(text, 100).otherwise(0) + own + F.when(geo, 60 if for_maps else 0).otherwise(0) + F.when(F.coalesce("datastore", F.lit(False)), 15).otherwise(0) + api


def resolve_file(files: DataFrame, dataset: str, wanted: str | None = None) -> dict:
    """The file (id, name, ..) of a dataset that a user means: by id, or by a name that only one has; the only one if nothing is said."""
    own = files.where(F.col("dataset") == dataset)
    if wanted is None:
        found, none = own.limit(2).collect(), "the dataset has no file"
    else:
        said = " ".join(wanted.split()).lower()
        by_id = own.where(F.col("id").cast("string") == wanted).limit(1).collect()
        found, none = by_id or own.where(F.lower("name") == said).limit(2).collect(), f"{wanted} is no file of {dataset}"
    if not found:
        raise ValueError(none)
    if len(found) > 1:
        raise ValueError("several files match; give an id")
    return found[0].asDict()


# Words of a topic that point at all sources of a domain.
TOPIC_WORDS = {
    "spending": ["spending", "money", "budget", "financial", "cost", "expense", "dollar", "funding", "fiscal", "procurement", "purchase"],
    "travel": ["travel", "trip", "flight", "hospitality", "conference", "aircraft"],
    "briefing reporting": ["accountability", "transparency", "wrongdoing", "disclosure", "government", "minister", "briefing", "parliament"],
}


def sources_of_topic(sources: DataFrame, topic: str) -> DataFrame:
    """Rows of sources (id, title, description, domain, examples array) whose title, description or an example holds the
    topic, or is held by it; if there is none, those of the domains that the topic's words point at."""
    said = " ".join(topic.lower().split())
    near = lambda c: F.contains(F.lower(c), F.lit(said)) | ((F.length(c) > 0) & F.contains(F.lit(said), F.lower(c)))
    direct = sources.where(near(F.col("title")) | F.contains(F.lower("description"), F.lit(said)) | F.exists("examples", near))
    if not direct.isEmpty():
        return direct
    domains = [d for names, words in TOPIC_WORDS.items() if any(w in said for w in words) for d in names.split()]
    return sources.where(F.col("domain").isin(domains))


def recommended(resources: DataFrame, for_analysis: bool = True, for_maps: bool = False, whole: bool = False) -> DataFrame:
    """(dataset, id, format, score): each dataset's best file, ties to the smaller id; `whole` scores by all columns."""
    r = resources.withColumn("score", file_score(for_analysis, for_maps) if whole else resource_score(F.col("format"), for_analysis, for_maps))
    return first_by(r, ["dataset"], ["id", "format", "score"], F.struct(-F.col("score"), F.col("id")))


@view("scatter_points", "x:d y:d", "", "SELECT CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y FROM part ORDER BY x, y LIMIT 200")
def scatter_points(t):
    return scatter(t.raw("part"), "p_size", "p_retailprice")


_FORMATS = "CASE p_partkey % 5 WHEN 0 THEN 'html' WHEN 1 THEN 'XML' WHEN 2 THEN 'pdf' WHEN 3 THEN CASE WHEN p_size > 45 THEN 'csv' ELSE 'jsonl' END END"


@view("recommended_resources", "dataset:s id:l format:s score:l", "", f"""
  SELECT dataset, arg_min(id, o) AS id, arg_min(format, o) AS format, arg_min(score, o) AS score FROM (SELECT *, {{'a': -score, 'b': id}} AS o FROM (SELECT *, CASE upper(format) WHEN 'CSV' THEN 140 WHEN 'JSONL' THEN 130 WHEN 'XML' THEN 115 WHEN 'HTML' THEN -20 ELSE 0 END AS score
    FROM (SELECT p_type AS dataset, p_partkey AS id, coalesce({_FORMATS}, '') AS format FROM part))) GROUP BY dataset""")  # fmt: skip
def recommended_resources(t):
    """The file to load of each dataset, by format."""
    p = t.raw("part")
    return recommended(p.selectExpr("p_type AS dataset", "p_partkey AS id", f"coalesce({_FORMATS}, '') AS format"))


_FILES = f"""SELECT p_type AS dataset, p_partkey AS id, coalesce({_FORMATS}, '') AS format, CASE p_size % 3 WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN 'application/pdf' END AS mime,
  'https://host/' || lower(p_brand) || CASE WHEN p_size % 4 = 0 THEN '.geojson' WHEN p_size % 4 = 1 THEN '.csv?x=1' ELSE '/query?f=geojson' END AS url, p_retailprice > 1500 AS datastore, CASE WHEN p_size < 10 THEN 'API' ELSE 'file' END AS kind FROM"""
_SCORE = """CASE WHEN upper(format) IN ('CSV', 'JSONL', 'XML', 'HTML') OR contains(coalesce(mime, ''), 'json') OR (mime IS NULL AND p IN (0, 1)) THEN 100 ELSE 0 END
  + CASE upper(format) WHEN 'CSV' THEN 40 WHEN 'JSONL' THEN 30 WHEN 'XML' THEN 15 WHEN 'HTML' THEN -20 ELSE 0 END + CASE WHEN p <> 1 THEN 60 ELSE 0 END + CASE WHEN datastore THEN 15 ELSE 0 END + CASE WHEN kind = 'API' THEN 5 ELSE 0 END"""


@view("recommended_map_files", "dataset:s id:l format:s score:l", "", f"""
  SELECT dataset, arg_min(id, o) AS id, arg_min(format, o) AS format, arg_min(score, o) AS score FROM (SELECT *, {{'a': -score, 'b': id}} AS o FROM (SELECT *, {_SCORE} AS score FROM (
    SELECT *, CASE WHEN url LIKE '%.geojson' THEN 0 WHEN url LIKE '%.csv?x=1' THEN 1 ELSE 2 END AS p FROM ({_FILES} part)))) GROUP BY dataset""")  # fmt: skip
def recommended_map_files(t):
    """The file of each dataset that serves a map best, by format, media type, address, store and kind."""
    return recommended(t.spark.sql(_FILES + " {part}", part=t.raw("part")), for_maps=True, whole=True)
