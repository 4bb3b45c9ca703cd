"""Ad-hoc analysis of any table: profile, roles, chart data, maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in a column's name that tell its role, the first role with one wins.
ROLES = {
    "geography": ["province", "city", "country", "region", "postal", "lat", "lon", "geo"],
    "time": ["date", "year", "month", "quarter", "period", "time"],
    "identifier": ["id", "code", "number", "key", "uuid"],
}
NUMBER, DATE, BOOLEAN = r"^\s*[-+]?[$]?\d[\d,]*(\.\d+)?%?\s*$", r"^\s*\d{4}-\d{1,2}(-\d{1,2})?([ T].*)?\s*$", r"(?i)^\s*(true|false|yes|no|y|n|0|1)\s*$"


def profile(df: DataFrame) -> DataFrame:
    """(column, type, role, rows, non_null, distinct, least, greatest, mean of numbers): one scan and one aggregation for all columns.

    Texts count as a type if nine in ten values read as it (booleans: all, of two values at most). Values are
    unpivoted and pre-aggregated by (column, value), so distinct counts are exact and large columns spread.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns]))
    values = df.select(cells.alias("x")).groupBy("x.column", "x.value").agg(F.count("*").alias("n"))
    is_ = {k: F.sum(F.when(F.col("value").rlike(p), F.col("n")).otherwise(0)) for k, p in (("number", NUMBER), ("date", DATE), ("boolean", BOOLEAN))}
    number = F.regexp_replace("value", "[$,%\\s]", "").try_cast("double")
    out = values.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"), F.count("value").alias("distinct"),
        *[c.alias(f"_{k}") for k, c in is_.items()], F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.min("value").alias("_first"), F.max("value").alias("_last"),
        (F.sum(number * F.col("n")) / F.sum(F.when(number.isNotNull(), F.col("n")))).alias("_mean"),
    )
    share = lambda k: F.col(f"_{k}") >= 0.9 * F.col("non_null")
    kind = F.when(F.col("non_null") == 0, "string").when((F.col("_boolean") == F.col("non_null")) & (F.col("distinct") <= 2), "boolean").when(share("number"), "number").when(share("date"), "date").otherwise("string")
    out = out.withColumn("type", kind)
    name = F.regexp_replace(F.lower("column"), "[^a-z0-9]", "")
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words])
    unique = (F.col("type") != "number") & (F.col("non_null") >= 20) & (F.col("distinct") > 0.9 * F.col("non_null"))
    role = F.when(has(ROLES["geography"]), "geography").when((F.col("type") == "date") | has(ROLES["time"]), "time").when(has(ROLES["identifier"]) | unique, "identifier").when(F.col("type") == "number", "measure").otherwise("category")
    lo, hi = (F.when(F.col("type") == "number", F.col(a).cast("string")).otherwise(F.col(b)) for a, b in (("_lo", "_first"), ("_hi", "_last")))
    return out.select("column", "type", role.alias("role"), "rows", "non_null", "distinct", lo.alias("least"), hi.alias("greatest"), F.when(F.col("type") == "number", F.col("_mean")).alias("mean"))


def suggest_charts(profiled: list[dict]) -> list[tuple[str, str, str]]:
    """(kind, x, y) of charts that fit a collected profile: lines over time, bars over categories, a scatter."""
    by = {r: [p["column"] for p in profiled if p["role"] == r] for r in ("time", "geography", "category", "measure")}
    out = [("line", t, m) for t in by["time"][:1] for m in by["measure"][:1]]
    out += [("bar", c, m) for c in (by["category"] + by["geography"])[:1] for m in by["measure"][:1]]
    return out + [("scatter", x, y) for x, y in zip(by["measure"][:1], by["measure"][1:2], strict=False)]


def chart(df: DataFrame, x: str, y: str | None = None, group: str | None = None, how: str = "sum", limit: int = 200, by_value: bool = False) -> DataFrame:
    """(x, group, value) of a chart: rows aggregated by x and group, the first `limit` by x, or by value."""
    keys = [F.col(x).alias("x")] + ([F.col(group).alias("group")] if group else [])
    value = F.count("*") if y is None or how == "count" else {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[how](y)
    out = df.where(F.col(x).isNotNull()).groupBy(*keys).agg(value.alias("value"))
    return out.orderBy(F.desc_nulls_last("value"), "x").limit(limit) if by_value else out.orderBy(*(["x", "group"] if group else ["x"])).limit(limit)


def top_and_other(df: DataFrame, series: str, value: str, keep: int, by: list[str]) -> DataFrame:
    """Sums by `by` and series, all but the `keep - 1` largest series under "Other"; the largest are a broadcast top-k."""
    top = df.groupBy(series).agg(F.sum(value).alias("_t")).orderBy(F.desc("_t"), series).limit(keep - 1).select(F.col(series).alias("_top"))
    named = df.join(F.broadcast(top), F.col(series) == F.col("_top"), "left").withColumn(series, F.when(F.col("_top").isNotNull(), F.col(series)).otherwise("Other"))
    return named.groupBy(*by, series).agg(F.sum(value).alias(value))


def pivot(df: DataFrame, x: str, series: str, y: str, values: list[str]) -> DataFrame:
    """Long to wide: a column for each stated value of `series`; stated, so that no extra job finds them."""
    return df.groupBy(x).pivot(series, values).agg(F.sum(y))


def geo_features(geojson: DataFrame) -> DataFrame:
    """(feature_id, geometry_type, properties, xmin, ymin, xmax, ymax) of a column `value` of GeoJSON feature collections.

    Coordinates of any depth are read as the pairs of numbers in their JSON text.
    """
    kind = T.StructType([T.StructField("features", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])))])
    f = geojson.select(F.posexplode(F.from_json("value", kind)["features"]).alias("pos", "f"))
    pairs = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"\[\s*(-?[\d.eE+-]+)\s*,\s*(-?[\d.eE+-]+)"), 0)
    points = F.transform(pairs, lambda p: F.transform(F.split(F.regexp_replace(p, r"[\[\s]", ""), ","), lambda v: v.try_cast("double")))
    f = f.withColumn("p", F.when(F.col("f.geometry.type") == "Point", F.array(F.transform(F.split(F.regexp_replace(F.col("f.geometry.coordinates"), r"[\[\]\s]", ""), ","), lambda v: v.try_cast("double")))).otherwise(points))

    def of(i):
        return F.transform("p", lambda q: q[i])

    ends = {"xmin": F.array_min(of(0)), "ymin": F.array_min(of(1)), "xmax": F.array_max(of(0)), "ymax": F.array_max(of(1))}
    return f.select(F.coalesce("f.id", (F.col("pos") + 1).cast("string")).alias("feature_id"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.properties").alias("properties"), *[c.alias(n) for n, c in ends.items()])
