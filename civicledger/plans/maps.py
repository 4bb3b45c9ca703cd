"""GeoJSON as rows and as a map: features are VARIANT values, coordinates are cast to the depth of their type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nesting of a type's coordinates above a position.
DEPTHS = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
# Words of names that make a label or a value.
LABEL_WORDS = "name|title|label|site|location|place|museum|park|station|region|province|territory|city|community"
VALUE_WORDS = "count|total|value|amount|rate|pct|percent|population|density|area|score"
FEATURES = 250


def positions(geometry: Column) -> Column:
    """All positions (arrays of numbers) of a simple geometry; null for other types and coordinates of another shape."""
    kind, out = F.try_variant_get(geometry, "$.type", "string"), None
    for name, depth in DEPTHS.items():
        c = F.try_variant_get(geometry, "$.coordinates", "array<" * (depth + 1) + "double" + ">" * (depth + 1))
        for _ in range(depth - 1):
            c = F.flatten(c)
        c = F.array(c) if depth == 0 else c
        out = F.when(kind == name, c) if out is None else out.when(kind == name, c)
    return out


def features(geojson: DataFrame) -> DataFrame:
    """(place, id, properties, types, geometry_type, lon, lat, xmin, ymin, xmax, ymax), a row for each feature of the column `value`.

    `value` holds a feature collection, a feature or an array of features. types are those of the geometry and, of a
    collection, of its members; lon and lat are those of points. What isn't JSON has no features.
    """
    v = F.try_parse_json("value")
    many = F.try_variant_get(v, "$.features", "array<variant>")
    alone = F.try_variant_get(v, "$", "array<variant>")
    one = F.when(F.try_variant_get(v, "$.type", "string") == "Feature", F.array(v))
    f = geojson.select(F.posexplode(F.coalesce(many, alone, one)).alias("place", "f")).where(F.try_variant_get("f", "$.type", "string") == "Feature")
    geometry = F.try_variant_get("f", "$.geometry", "variant")
    members = F.coalesce(F.try_variant_get(geometry, "$.geometries", "array<variant>"), F.array().cast("array<variant>"))
    f = f.select("place", "f", geometry.alias("g"), members.alias("m"))
    kind = lambda g: F.try_variant_get(g, "$.type", "string")
    of_members = F.flatten(F.transform("m", lambda x: F.coalesce(positions(x), F.array().cast("array<array<double>>"))))
    own = F.coalesce(positions(F.col("g")), F.array().cast("array<array<double>>"))
    f = f.select(
        "place", F.try_variant_get("f", "$.id", "string").alias("id"), F.try_variant_get("f", "$.properties", "map<string, variant>").alias("properties"), kind(F.col("g")).alias("geometry_type"),
        F.array_distinct(F.filter(F.concat(F.array(kind(F.col("g"))), F.transform("m", kind)), lambda x: x.isNotNull())).alias("types"),
        F.filter(F.concat(own, of_members), lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull()).alias("p"),
    )
    point = lambda i: F.when(F.col("geometry_type") == "Point", F.get("p", F.lit(0))[i])
    of = {"x": F.transform("p", lambda q: q[0]), "y": F.transform("p", lambda q: q[1])}
    ends = {f"{axis}{end}": (F.array_min if end == "min" else F.array_max)(of[axis]) for end in ("min", "max") for axis in "xy"}
    return f.select("place", "id", "properties", "types", "geometry_type", point(0).alias("lon"), point(1).alias("lat"), *[c.alias(n) for n, c in ends.items()])


def property_kinds(rows: DataFrame) -> DataFrame:
    """(name, numbers, filled, distinct_values): of each property, how many features have it and as a number."""
    p = rows.select(F.explode("properties").alias("name", "v"))
    text, number = F.try_variant_get("v", "$", "string"), F.try_variant_get("v", "$", "double")
    kind = F.schema_of_variant("v")
    is_number = number.isNotNull() & ~kind.isin("BOOLEAN")
    return p.where(text.isNotNull()).groupBy("name").agg(F.count_if(is_number).alias("numbers"), F.count("*").alias("filled"), F.count_distinct(text).alias("distinct_values"))


def prepare_map(geojson: DataFrame, label: str | None = None, value: str | None = None, most: int = FEATURES) -> dict:
    """What a map of the features needs: map type, label and value fields, bounding box, counts, and the first `most`
    features in their order. Only the summary (a row, a row for each property) and those features come to the driver."""
    rows = features(geojson)
    total = rows.agg(
        F.count("*").alias("n"), F.array_sort(F.flatten(F.collect_set("types"))).alias("types"), *[f(c).alias(c) for f, c in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))]
    ).first()
    types = sorted(set(total["types"] or ()))
    if not types:
        raise ValueError("the GeoJSON has no usable geometry")
    kinds = {r["name"]: r for r in property_kinds(rows).collect()}
    order = ordered_names(geojson, kinds)
    measures = [n for n in order if kinds[n]["numbers"] >= 0.9 * kinds[n]["filled"] and not _matches(n, r"(^|_)(id|code|year|lat|lon|latitude|longitude)($|_)")]
    label, value = choose_label(order, measures, label), choose_value(order, measures, value)
    box = stated_box(geojson) or ([total[c] for c in ("xmin", "ymin", "xmax", "ymax")] if total["xmin"] is not None else None)
    shown = rows.orderBy("place").limit(most)
    return {
        "map_type": map_type(types, value), "types": types, "label": label, "value": value, "box": box, "features": total["n"], "returned": min(most, total["n"]),
        "preview": [r.asDict() for r in shown.limit(8).select((F.col("place") + 1).alias("feature_number"), "geometry_type", *[F.try_variant_get(F.col("properties")[c], "$", "string").alias(c) for c in dict.fromkeys(x for x in (label, value) if x)]).collect()],
        "rows": shown, "warnings": [f"only the first {most} of {total['n']} features are shown"] if total["n"] > most else [],
    }


def _matches(name: str, pattern: str) -> bool:
    import re

    return bool(re.search(pattern, name, re.I))


def ordered_names(geojson: DataFrame, known) -> list[str]:
    """Property names in the order of the first feature's text, others after them by name."""
    first = geojson.select(F.json_object_keys(F.coalesce(F.get_json_object("value", "$.features[0].properties"), F.get_json_object("value", "$[0].properties"), F.get_json_object("value", "$.properties"))).alias("k")).where("k IS NOT NULL").first()
    named = [n for n in (first["k"] if first else []) if n in known]
    return named + sorted(n for n in known if n not in named)


def choose_label(order: list[str], measures: list[str], wanted: str | None) -> str | None:
    if wanted:
        return _wanted(order, wanted)
    return next((n for n in order if _matches(n, LABEL_WORDS)), None) or next((n for n in order if n not in measures), None)


def choose_value(order: list[str], measures: list[str], wanted: str | None) -> str | None:
    if wanted:
        found = _wanted(order, wanted)
        if found not in measures:
            raise ValueError(f"{found} isn't numeric enough to be a map's value")
        return found
    return next((n for n in measures if _matches(n, VALUE_WORDS)), None) or next(iter(measures), None)


def _wanted(order: list[str], name: str) -> str:
    found = [n for n in order if n.lower() == name.lower()]
    if not found:
        raise ValueError(f"there is no field {name}; there are {', '.join(order)}")
    return found[0]


def map_type(types: list[str], value: str | None) -> str:
    """point, choropleth (areas with a value), boundary (areas without), line or mixed."""
    if all(x in ("Point", "MultiPoint") for x in types):
        return "point"
    if any(x in ("Polygon", "MultiPolygon") for x in types):
        return "choropleth" if value else "boundary"
    return "line" if all(x in ("LineString", "MultiLineString") for x in types) else "mixed"


def stated_box(geojson: DataFrame) -> list[float] | None:
    """The collection's own bounding box, of four or of six numbers."""
    r = geojson.select(F.try_variant_get(F.try_parse_json("value"), "$.bbox", "array<double>").alias("b")).where("b IS NOT NULL").first()
    b = r["b"] if r else []
    return None if None in b else list(b) if len(b) == 4 else [b[0], b[1], b[3], b[4]] if len(b) == 6 else None
