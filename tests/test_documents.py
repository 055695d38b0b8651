"""Split reading of JSON documents against the json module."""

import json
import random

import pytest
from pyspark.sql import functions as F

from geolake.sources import documents as d
from geolake.sources import readers


def value(rnd, depth=0):
    kind = rnd.randrange(7 if depth < 3 else 4)
    if kind == 0:
        return rnd.choice([None, True, -1.5e3, 7])
    if kind < 4:
        return "".join(rnd.choice('ab {}[]":,\\\n/é漢😀}') for _ in range(rnd.randrange(12)))
    if kind < 6:
        return {value_key(rnd): value(rnd, depth + 1) for _ in range(rnd.randrange(4))}
    return [value(rnd, depth + 1) for _ in range(rnd.randrange(4))]


def value_key(rnd):
    return rnd.choice(["a", "b", "features", "x}y", 'q"u', "back\\", "é"])


def write(rnd, path, doc):
    text = json.dumps(doc, ensure_ascii=rnd.random() < 0.5, indent=rnd.choice([None, 1]))
    path.write_bytes(text.encode())
    return text.encode()


@pytest.mark.parametrize("split", [90, 700, 1 << 20])
def test_elements_at_any_split(spark, tmp_path, split):
    rnd = random.Random(split)
    want, docs = [], {}
    for k in range(4):
        objects = [{**{value_key(rnd): value(rnd) for _ in range(rnd.randrange(5))}, "n": n} for n in range([0, 1, 12, 30][k])]
        doc = {"crs": {"features": [1, {"no": 1}]}, "feat": value(rnd), "features": [x for o in objects for x in ([o] if rnd.random() < 0.9 else [o, 5, [o], "{"])], "x}y": value(rnd)}
        raw = write(rnd, tmp_path / f"d{k}.json", doc)
        docs[f"d{k}.json"] = raw
        want += [(f"d{k}.json", json.dumps(o, sort_keys=True)) for o in objects]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = d.read_elements(spark, str(tmp_path), ("features",), rest=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = [r for r in rows if r.offset >= 0]
    assert sorted((r.file, json.dumps(json.loads(r.text), sort_keys=True)) for r in got) == sorted(want)
    assert all(docs[r.file][r.offset : r.offset + len(r.text.encode())] == r.text.encode() and r["keys"] == ["features"] for r in got)
    left = {r.file: r.text for r in rows if r.offset < 0}
    for name, raw in docs.items():
        full = json.loads(raw)
        assert json.loads(left[name]) == full | {"features": []}


def test_any_key(spark, tmp_path):
    doc = {"N": {"name": "n", "departures": [{"id": 1}, {"id": 2}]}, "_meta": {"departures": [{"id": 3}], "deep": {"departures": [{"id": 4}]}}, "S": {"departures": []}}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    rows = d.read_elements(spark, str(tmp_path), ("*", "departures")).orderBy("offset").collect()
    assert [(r["keys"], json.loads(r.text)["id"]) for r in rows] == [(["N", "departures"], 1), (["N", "departures"], 2), (["_meta", "departures"], 3)]


def test_documents_themselves(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\n{"a":{"b":"}"}} {"a":3}\n\n')
    rows = d.read_elements(spark, str(tmp_path), None).orderBy("offset").collect()
    assert [json.loads(r.text)["a"] for r in rows] == [1, {"b": "}"}, 3] and [r.offset for r in rows] == [0, 8, 24]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "y.json").write_text("")
    assert d.read_elements(spark, str(tmp_path / "e"), ("features",)).collect() == []


def test_ids_follow_no_split_and_no_folder(spark, tmp_path):
    """One collection read by many tasks: the ids are those of one task."""
    features = [{"type": "Feature", "properties": {"name": f"f{k % 50}"}, "geometry": {"type": "LineString", "coordinates": [[k, 1], [k, 2]]}} for k in range(400)]
    seen = []
    for folder, split in (("a", 1 << 20), ("b", 2000), ("c", 177)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            v = readers.read_geojson(spark, str(tmp_path / folder), "LineString", ["name"])
            seen.append(sorted((r.feature_id, r.name, r.seq, r.lon) for r in v.collect()))
            tasks = spark.read.option("lineSep", "}").text(str(tmp_path / folder)).select(F.spark_partition_id()).distinct().count()
            assert split > 10_000 or tasks > 10
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 800 and len({r[0] for r in seen[0]}) == 400


def test_all_splits_are_summed_up_at_once(spark, tmp_path):
    """One job looks at all ranges side by side, and one pass cuts out whole elements,
    pieces and the rest: none of it is read again for each use."""
    for k in range(3):
        (tmp_path / f"d{k}.json").write_text(json.dumps({"v": k, "features": [{"n": n, "s": "}" * 5} for n in range(100)]}))
    sc = spark.sparkContext
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        sc.setJobGroup("elements", "elements")
        rows = d.read_elements(spark, str(tmp_path), ("features",), rest=True)
        jobs = len(sc.statusTracker().getJobIdsForGroup("elements"))
        for k in range(3):
            (tmp_path / f"d{k}.json").unlink()
        got = rows.collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert jobs <= 4
    assert sorted(json.loads(r.text)["n"] for r in got if r.offset >= 0) == sorted(list(range(100)) * 3)
    assert sorted(json.loads(r.text)["v"] for r in got if r.offset < 0) == [0, 1, 2]
