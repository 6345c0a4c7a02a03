"""Landed inputs: weather text with any header length, reading pages, the sink."""

import json


from hourgrid.operators.sinks import write_if_absent
from hourgrid.sources.pages import page_completeness, read_pages
from hourgrid.sources.weather import read_weather_text


def test_weather_text_any_header_and_sentinel(spark, tmp_path):
    d = tmp_path / "w"
    (d).mkdir()
    hdr14 = [f"meta line {i}" for i in range(13)] + ["-END HEADER-", "YEAR,MO,DY,HR,ALLSKY_SFC_SW_DWN,T2M,WSC"]
    (d / "weather_power_NY.csv").write_text("\n".join(hdr14 + ["2024,1,1,0,0.0,1.76,3.72", "2024,1,1,1,0.0,1.27,3.48"]) + "\n")
    hdr3 = ["x", "y", "YEAR,MO,DY,HR,ALLSKY_SFC_SW_DWN,T2M,WSC"]
    (d / "weather_power_TEX.csv").write_text("\n".join(hdr3 + ["2024,1,1,0,-999,20.5,-999"]) + "\n")
    out = read_weather_text(spark, str(d), missing_sentinel=-999.0).orderBy("region", "datetime").collect()
    assert [(r.region, r.hr) for r in out] == [("NY", 0), ("NY", 1), ("TEX", 0)]
    assert out[0].t2m == 1.76 and str(out[0].datetime) == "2024-01-01 00:00:00"
    assert out[2].allsky_sfc_sw_dwn is None and out[2].t2m == 20.5 and out[2].wsc is None


def test_pages_explode_and_completeness(spark, tmp_path):
    row = {"period": "2024-07-31T00", "respondent": "NY", "respondent_name": "New York", "type": "D",
           "type_name": "Demand", "value": "26508", "value_units": "MWh", "ordinal": 1}
    pages = [{"response": {"total": "3", "data": [row, dict(row, ordinal=2)]}}, {"response": {"total": "3", "data": [dict(row, ordinal=3)]}}]
    p = tmp_path / "pages"
    p.mkdir()
    (p / "part.json").write_text("\n".join(json.dumps(x) for x in pages) + "\n")
    rows = read_pages(spark, str(p))
    assert rows.count() == 3
    c = page_completeness(rows).collect()[0]
    assert (c.rows, c.total, c.complete) == (3, 3, True)


def test_write_if_absent_never_rewrites(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "region string, v double")
    write_if_absent(a, path)
    b = spark.createDataFrame([("A", 9.0), ("C", 3.0)], "region string, v double")
    write_if_absent(b, path)
    got = sorted((r.region, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("A", 1.0), ("B", 2.0), ("C", 3.0)]


def test_stream_hours_matches_batch_pivot(spark, tmp_path):
    from datetime import datetime, timedelta

    from hourgrid.operators.reshape import pivot_first
    from hourgrid.streaming.ingest import stream_hours

    rows = []
    for h in range(6):
        t = datetime(2024, 1, 1) + timedelta(hours=h)
        rows.append((t, "R", "R", "D", "Demand", float(h), "u", 2 * h + 1))
        rows.append((t, "R", "R", "D", "Demand", 100.0 + h, "u", 2 * h + 2))
    rows.append((datetime(2024, 1, 9), "R", "R", "D", "Demand", 1.0, "u", 99))  # moves the watermark
    schema = "period timestamp_ntz, respondent string, respondent_name string, type string, type_name string, value double, value_units string, ordinal long"
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    types = {"Demand": "demand"}
    q = (
        stream_hours(stream, types, lateness="1 day")
        .writeStream.format("memory").queryName("hours_stream_test").outputMode("append")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = {(r.period, r.demand) for r in spark.sql("SELECT * FROM hours_stream_test").collect()}
    exp = {(r.period, r.demand) for r in pivot_first(spark.createDataFrame(rows, schema), types).collect()}
    # the last hour is still open (its watermark has not passed); all others are final
    assert got == {x for x in exp if x[0] < datetime(2024, 1, 9)}
