"""Bounded reads of CSV, JSON and GeoJSON by byte ranges; maps from GeoJSON."""

import json
import random

import pytest

from civicledger.plans import maps
from civicledger.sources import bounded, readers

POLYGONS = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"province": "Ontario", "value": 10}, "geometry": {"type": "Polygon", "coordinates": [[[-80, 43], [-79, 43], [-79, 44], [-80, 44], [-80, 43]]]}},
    {"type": "Feature", "properties": {"province": "Quebec", "value": 12}, "geometry": {"type": "Polygon", "coordinates": [[[-72, 46], [-71, 46], [-71, 47], [-72, 47], [-72, 46]]]}},
]}
POINTS = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"name": "Station A", "reading": 4.2}, "geometry": {"type": "Point", "coordinates": [-75.7, 45.4]}},
    {"type": "Feature", "properties": {"name": "Station B", "reading": 3.8}, "geometry": {"type": "Point", "coordinates": [-73.6, 45.5]}},
]}


def plain(data: bytes, most: int):
    """(offset, line) of the whole lines within the budget, by definition."""
    out, at = [], 0
    for line in data.split(b"\n"):
        end = at + len(line)
        if end < min(len(data), most) or (end == len(data) <= most and line):
            out.append((at, line.removesuffix(b"\r").decode()))
        at = end + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ranges_give_each_whole_line_once(tmp_path, seed):
    rng = random.Random(seed)
    data = "\n".join("é" * rng.choice([0, 1, 3, 40]) + str(i) + rng.choice(["", "\r"]) for i in range(120)).encode() + rng.choice([b"", b"\n"])
    at = tmp_path / "x.txt"
    at.write_bytes(data)
    for most in (0, 1, 57, len(data) - 1, len(data), 10**6):
        for part in (1, 7, 64, 10**6):
            r = bounded.BoundedReader({"path": str(at), "max_bytes": most, "part_bytes": part})
            rows = [x for p in r.partitions() for x in r.read(p)]
            assert [x[:2] for x in rows] == plain(data, most), (most, part)
            assert all(x[2] == (most < len(data)) for x in rows)


def test_no_byte_behind_the_budget_is_read(tmp_path, monkeypatch):
    at = tmp_path / "x.csv"
    at.write_bytes(b"a,b\n" + b"1,2\n" * 100_000)
    seen = []
    read = bounded.read_range
    monkeypatch.setattr(bounded, "read_range", lambda path, start, end: seen.append(end) or read(path, start, end))
    r = bounded.BoundedReader({"path": str(at), "max_bytes": 1001, "part_bytes": 300})
    assert sum(1 for p in r.partitions() for _ in r.read(p)) == 250 and max(seen) == 1001


def test_csv(spark, tmp_path):
    at = tmp_path / "a.csv"
    at.write_text('﻿date,"the value"\n2024-01-01,10\n\n2024-01-02,"1,2"\n2024-01-03,7')
    rows = bounded.read_csv(spark, str(at), part_bytes=9).collect()
    assert [tuple(r) for r in rows] == [("2024-01-01", "10", False), ("2024-01-02", "1,2", False), ("2024-01-03", "7", False)]
    cut = bounded.read_csv(spark, str(at), max_bytes=len(at.read_bytes()) - 1, part_bytes=9)
    assert [tuple(r) for r in cut.collect()] == [("2024-01-01", "10", True), ("2024-01-02", "1,2", True)]
    assert cut.columns == ["date", "the value", "_truncated"]


def test_documents(spark, tmp_path):
    at = tmp_path / "a.geojson"
    at.write_text(json.dumps(POLYGONS))
    assert json.loads(bounded.read_document(spark, str(at))) == POLYGONS
    with pytest.raises(ValueError, match="max_bytes"):
        bounded.read_document(spark, str(at), 100)
    lines = tmp_path / "b.jsonl"
    lines.write_text('{"a": 1}\n{"a": 2}\n{"a": 3}')
    rows = bounded.read_lines(spark, str(lines), max_bytes=22)
    assert [(json.loads(r["value"])["a"], r["truncated"]) for r in rows.collect()] == [(1, True), (2, True)]


def test_structured_text():
    assert bounded.is_structured_text("CSV") and bounded.is_structured_text(media_type="application/json; charset=utf-8") and bounded.is_structured_text(name="https://x/y/a.geojson?z=1")
    assert not bounded.is_structured_text("PDF", "application/pdf", "a.pdf") and not bounded.is_structured_text(name="a") and not bounded.is_structured_text(media_type="image/png", name="a.csv")


def test_records_of_one_line_documents_are_sniffed_by_their_head(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"result": {"records": [{"n": i, "t": "x" * 50} for i in range(3000)]}}))
    assert readers.read_records(spark, str(tmp_path / "a.json")).count() == 3000
    (tmp_path / "b.json").write_text(json.dumps([{"n": 1}, {"n": 2}], indent=1))
    assert readers.read_records(spark, str(tmp_path / "b.json")).count() == 2
    assert readers.read_records(spark, str(tmp_path / "b.json"), schema="n int, m string").columns == ["n", "m"]


def rows(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def test_polygons(spark):
    got = maps.prepare_map(rows(spark, POLYGONS))
    assert (got["map_type"], got["types"], got["label"], got["value"], got["box"], got["features"]) == ("choropleth", ["Polygon"], "province", "value", [-80, 43, -71, 47], 2)
    assert got["preview"] == [{"feature_number": 1, "geometry_type": "Polygon", "province": "Ontario", "value": "10"}, {"feature_number": 2, "geometry_type": "Polygon", "province": "Quebec", "value": "12"}]


def test_points(spark):
    got = maps.prepare_map(rows(spark, POINTS), most=1)
    assert (got["map_type"], got["label"], got["value"], got["returned"]) == ("point", "name", "reading", 1) and got["warnings"]
    assert [(r["lon"], r["lat"]) for r in got["rows"].collect()] == [(-75.7, 45.4)]
    with pytest.raises(ValueError, match="numeric"):
        maps.prepare_map(rows(spark, POINTS), value="name")
    with pytest.raises(ValueError, match="no field"):
        maps.prepare_map(rows(spark, POINTS), label="nowhere")


def test_other_geometries(spark):
    line = {"type": "Feature", "properties": None, "geometry": {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4, 9]], [[-5, 0.5]]]}}
    area = {"type": "Feature", "id": 7, "properties": {"id": 3}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 1]]], [[[9, 9], [9, 8], [8, 8]]]]}}
    both = {"type": "Feature", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [10, 20]}, {"type": "LineString", "coordinates": [[0, 0], [-3, 4]]}]}}
    got = {r["place"]: r for r in maps.features(rows(spark, [line, area, both, {"type": "Feature", "geometry": None}])).collect()}
    assert [tuple(got[i][c] for c in ("xmin", "ymin", "xmax", "ymax")) for i in range(3)] == [(-5.0, 0.5, 3.0, 4.0), (0.0, 0.0, 9.0, 9.0), (-3.0, 0.0, 10.0, 20.0)]
    assert got[1]["id"] == "7" and got[2]["types"] == ["GeometryCollection", "Point", "LineString"] and got[3]["xmin"] is None and got[3]["types"] == []
    assert maps.prepare_map(rows(spark, line))["map_type"] == "line"
    assert maps.prepare_map(rows(spark, {"type": "FeatureCollection", "bbox": [0, 0, 1, 5, 6, 2], "features": [area]}))["box"] == [0, 0, 5, 6]
    assert maps.prepare_map(rows(spark, area))["map_type"] == "boundary"
    assert maps.features(rows(spark, "no json", "{}", "")).count() == 0
    with pytest.raises(ValueError, match="no usable geometry"):
        maps.prepare_map(rows(spark, {"type": "FeatureCollection", "features": []}))
