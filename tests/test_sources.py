"""Readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from terrastrat.sources import files
from terrastrat.streaming import ingest

GOOD = '228175 "2008-01-01 02:35:14.260" 36.715770 -116.311330 9.172000 0.280000 1'


def test_relocated_catalogue(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"evid otime lat lon dep mag reloc\n{GOOD}\n\n")
    r = files.read_relocated(spark, str(tmp_path / "a.txt")).first()
    assert (r.id, r.time.year, r.lat, r.lon, r.depth_km, r.mag, r.relocated) == (228175, 2008, 36.71577, -116.31133, 9.172, 0.28, 1)


@pytest.mark.parametrize("bad", ['1 "2008-01-01 00:00:00" 91.0 0.0 1 1 1', '1 "2008-01-01 00:00:00" 1.0 0.0 1 1 2', '1 "2008-01-01 00:00:00 1.0 0.0 1 1 1'])
def test_malformed_lines_raise_or_are_left_out(spark, tmp_path, bad):
    (tmp_path / "a.txt").write_text(f"{GOOD}\n{bad}\n")
    assert files.read_relocated(spark, str(tmp_path / "a.txt"), strict=False).count() == 1
    with pytest.raises(Exception, match="malformed event"):
        files.read_relocated(spark, str(tmp_path / "a.txt")).collect()


def test_wide_catalogue(spark, tmp_path):
    head = "time,latitude,longitude,depth,mag,type,id"
    (tmp_path / "e.csv").write_text(f"{head}\n2020-01-02T03:04:05.000Z,38.5,-117.1,7.1,1.2,earthquake,nn1\nbad,x,-117.2,,2,quarry blast,nn2\n")
    rows = files.read_events_csv(spark, str(tmp_path / "e.csv")).orderBy("id").collect()
    assert rows[0].time.year == 2020 and rows[0].mag == 1.2 and rows[1].time is None and rows[1].latitude is None and rows[1].gap is None
    (tmp_path / "f.csv").write_text("time,latitude\n1,2\n")
    with pytest.raises(ValueError, match="longitude"):
        files.read_events_csv(spark, str(tmp_path / "f.csv"))


def test_support_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.5), (300, 7, 1.0)], "row long, col long, p double")
    files.write_support(df, str(tmp_path / "s"))
    a = files.audit_support(spark.read.parquet(str(tmp_path / "s"))).first()
    assert (a.n, a.positive, a.missing, a.outside, a.cells) == (2, 2, 0, 0, 2)
    with pytest.raises(Exception, match="outside 0..1"):
        files.write_support(df.withColumn("p", F.lit(1.5)), str(tmp_path / "t"))


def test_masks_digests_splits_and_receipts(spark, tmp_path):
    t = spark.createDataFrame([(1, 1), (1, 2)], "row long, col long")
    files.check_masks(t.withColumn("label", F.lit(1)), t)
    with pytest.raises(ValueError, match="masks? only|on one mask"):
        files.check_masks(t.limit(1).withColumn("label", F.lit(1)), t)
    assert files.content_digest(t).first() == files.content_digest(t.orderBy(F.desc("col"))).first()
    (tmp_path / "x.json").write_text(json.dumps({"schema": "v1", "k": 1}))
    assert files.read_split(spark, str(tmp_path / "x.json"), "v1")["k"] == 1
    with pytest.raises(ValueError, match="v2"):
        files.read_split(spark, str(tmp_path / "x.json"), "v2")
    assert files.digest(spark, str(tmp_path / "x.json")).first().length > 0
    df = spark.createDataFrame([(float("nan"), 1.0)], "a double, b double")
    assert json.loads(files.receipt(df).first().value) == {"a": None, "b": 1.0}
    (tmp_path / "h.csv").write_text("utm_x,utm_y,thermalclass\n1,2,Hot\n1,2, Hot \nNaN,2,Hot\n3,4,Cold\n")
    assert [tuple(r) for r in files.read_centres(spark, str(tmp_path / "h.csv")).collect()] == [(1.0, 2.0)]


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    schema = "id long, ts timestamp, x long, y long, mag double"
    part = lambda *rows: spark.createDataFrame(rows, "id long, ts string, x long, y long, mag double").withColumn("ts", F.to_timestamp("ts")).select("id", "ts", "x", "y", "mag").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    part((1, "2024-01-01 00:00:00", 1, 1, 1.0), (2, "2024-01-01 01:00:00", 2, 2, 3.0), (1, "2024-01-01 00:00:00", 1, 1, 1.0))
    stream = lambda: ingest.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    run(ingest.deduplicated(stream(), "id", "ts", "1 day"), "once")
    assert {r.id for r in spark.table("once").collect()} == {1, 2} and spark.table("once").count() == 2
    part((3, "2024-03-01 00:00:00", 900, 900, 1.0))
    run(ingest.thinned(stream(), "ts", "10 days", 250, "1 day"), "thinned")
    rows = spark.table("thinned").collect()
    assert [(r.id, r.mag) for r in rows] == [(2, 3.0)]
    run(ingest.parent_links(ingest.deduplicated(stream(), "id", "ts", "100 days"), 250), "linked")
    assert {r.id: r.parent for r in spark.table("linked").collect()} == {1: None, 2: 1, 3: None}
