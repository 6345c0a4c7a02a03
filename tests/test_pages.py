"""Pages: coverage by offset, layouts by size, streams; the rules of the batch hold in the stream."""

import json

import pytest
from pyspark.sql import functions as F

from hourgrid.operators.reshape import pivot_first
from hourgrid.sources import pages
from hourgrid.streaming.ingest import ingest_pages, page_stream, stream_hours


def page(key, offset, n, total, extra=None):
    rows = [{"period": f"2024-01-01T{i % 24:02d}", "respondent": key, "respondent-name": key, "type-name": "Wind", "value": str(offset + i)} for i in range(n)]
    return {"request": {"params": {"offset": offset, "length": 5000}}, "response": {"total": str(total), "data": rows}, **(extra or {})}


def land(d, docs, name="x.json", indent=None):
    d.mkdir(exist_ok=True, parents=True)
    (d / name).write_text("\n".join(json.dumps(x, indent=indent) for x in docs))
    return str(d)


def test_a_repeated_page_does_not_hide_a_missing_one(spark, tmp_path):
    docs = [page("a", 0, 10, 40), page("a", 20, 10, 40), page("a", 20, 10, 40), page("a", 5, 3, 40), page("a", 25, 7, 40), page("b", 0, 4, 4), page("b", 0, 4, 4), page("c", 3, 2, 9)]
    rows = pages.read_pages(spark, land(tmp_path / "p", docs))
    assert rows.count() == sum(len(x["response"]["data"]) for x in docs)
    told = {r.respondent: (r["rows"], r.total, r.complete) for r in pages.page_completeness(rows).collect()}
    assert told == {"a": (22, 40, False), "b": (4, 4, True), "c": (2, 9, False)}
    gaps = sorted(map(tuple, pages.page_gaps(rows).collect()))
    assert gaps == [("a", 10, 20), ("a", 32, 40), ("c", 0, 3), ("c", 5, 9)]
    once = sorted((r.respondent, r.position, r.value) for r in pages.first_rows(rows).collect())
    assert once == sorted((k, i, str(i)) for k, ranges in (("a", [(0, 10), (20, 32)]), ("b", [(0, 4)]), ("c", [(3, 5)])) for s, e in ranges for i in range(s, e))
    with pytest.raises(ValueError, match=r"a: 22 of 40 rows \(from 10 on\); c: 2 of 9 rows \(from 0 on\)"):
        pages.require_complete(rows)
    assert pages.require_complete(rows.where("respondent = 'b'")).count() == 4


def test_pages_without_offset_or_rows(spark, tmp_path):
    old = page("a", 0, 5, 5)
    del old["request"]
    rows = pages.read_pages(spark, land(tmp_path / "p", [old, page("b", 0, 0, 3)]))
    assert rows.where("position IS NULL").count() == 5 and pages.page_gaps(rows).count() == 0
    assert pages.require_complete(rows).count() == 5
    with pytest.raises(ValueError, match="unknown layout"):
        pages.read_pages(spark, str(tmp_path / "p"), "xml")


@pytest.fixture
def mixed(tmp_path):
    """A small pretty-printed document, small lines, and a file of lines beyond the size of a document."""
    d = tmp_path / "mixed"
    land(d, [page("a", 0, 6, 6)], "pretty.json", 2)
    land(d, [page("b", 0, 4, 8), page("b", 4, 4, 8)], "lines.json")
    land(d, [page("c", 50 * i, 50, 20_000) for i in range(400)], "large.json")
    return d


def test_a_large_file_is_read_by_several_tasks(spark, mixed):
    size = (mixed / "large.json").stat().st_size
    assert size > 2_000_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 7))
    try:
        rows = pages.read_pages(spark, str(mixed), whole_bytes=100_000)
        parts = rows.where("respondent = 'c'").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) >= 5 and sum(r["count"] for r in parts) == 20_000
        assert sorted(r[1] for r in rows.groupBy("respondent").count().collect()) == [6, 8, 20_000]
        # the large file is never a string: the reader of whole files does not list it
        whole = pages.whole_documents(spark.read.text(str(mixed), wholetext=True).where(F.col("_metadata.file_size") <= 100_000))
        assert whole.agg(F.max(F.length("document"))).first()[0] < 100_000
        assert pages.require_complete(rows).count() == 20_014
        # the same through a stream, twice: the second run finds nothing new
        for _ in range(2):
            ingest_pages(spark, str(mixed), str(mixed.parent / "out"), str(mixed.parent / "ckpt"), whole_bytes=100_000)
        back = spark.read.parquet(str(mixed.parent / "out"))
        assert back.count() == 20_014 and back.select("respondent", "position").distinct().count() == 20_014
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_stream_takes_values_without_an_ordinal(spark, tmp_path):
    """The same first reading as the batch pivot, an ordinal or not."""
    a, b = page("a", 0, 3, 6), page("a", 3, 3, 6)
    a["response"]["data"][1]["ordinal"] = 7
    b["response"]["data"][0]["value"] = "n/a"
    b["response"]["data"][2]["ordinal"] = 1
    land(tmp_path / "p", [b, a])
    types = {"Wind": "wind"}
    q = stream_hours(page_stream(spark, str(tmp_path / "p")), types, "1 hour").writeStream.format("memory").queryName("hours_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    from hourgrid.operators.reshape import parse_readings

    got = sorted(map(tuple, spark.table("hours_out").collect()))
    batch = pivot_first(parse_readings(pages.read_pages(spark, str(tmp_path / "p"))), types)
    want = sorted(map(tuple, batch.collect()))
    assert [r[-1] for r in got] == [r[-1] for r in want] == [0.0, 1.0, 5.0]


def test_wire_pages_are_written_by_many_tasks(spark, tmp_path):
    """Places, totals, repeats and gaps of two respondents; the files come from more tasks than there are respondents."""
    rows = [(f"2024-01-01T{i % 24:02d}", k, f"Name {k}", "WI", "Wind", str(i), "MWh", i) for k in ("a", "b") for i in range(400) if i // 10 != 3]
    rows += [("2024-01-01T00", "a", "Name a", "WI", "Wind", "x", "MWh", None), ("2024-01-01T00", None, "nobody", "WI", "Wind", "x", "MWh", 1)]
    text = spark.createDataFrame(rows, "period string, respondent string, respondent_name string, type string, type_name string, value string, value_units string, ordinal long")
    path = pages.land_pages(text, str(tmp_path / "wire"), page_rows=10, wire=True, again=F.col("_page") == 5, missing=F.coalesce(F.col("_page") == 7, F.lit(False)))
    files = list((tmp_path / "wire").rglob("*.txt"))
    assert len(files) == 2 * 39 + 1  # 39 pages of each, one of them missing and one twice, and that without an ordinal
    assert len({f.name.split("-")[1] for f in files}) > 2 and {f.parent.name for f in files} == {"respondent=a", "respondent=b"}
    back = pages.read_pages(spark, path)
    gaps = sorted(map(tuple, pages.page_gaps(back).collect()))
    assert gaps == [("a", 61, 71), ("b", 60, 70)]  # the page without an ordinal comes first
    got = sorted((r.respondent, r.position, r.value) for r in pages.first_rows(back).collect())
    at = {"a": 1, "b": 0}
    want = [(k, (i if i < 30 else i - 10) + at[k], str(i)) for k in at for i in range(400) if i // 10 not in (3, 7)] + [("a", 0, "x")]
    assert got == sorted(want) and {r.page_total for r in back.select("page_total").distinct().collect()} == {390, 391}
