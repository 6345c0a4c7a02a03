"""Landed reading pages: one JSON document per request, ``response.data`` holds the rows, ``response.total``
the size of the whole result and ``request.params.offset`` the place of the page in it.

Pages come one to a file, pretty-printed or not, or as JSON lines; field names come as on the wire
(``respondent-name``) or as column names.  A document that does not parse, or has no ``response``, raises: it is
never read as nothing.  Files of at most ``WHOLE_BYTES`` may hold either layout and are read one by one; a
larger file is JSON lines, cut at line ends and read by as many tasks as it has splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourgrid.schemas import CORRUPT, PAGE, READING_TEXT, WIRE_NAMES
from hourgrid.session import cut_lineage

PAGE_ROWS = 5000
#: Largest file that may be one document: several times a page of PAGE_ROWS rows.
WHOLE_BYTES = 8 << 20
#: Where a row was found: place in the whole result (where the page tells its offset), file, document in it, place in the page.
ARRIVAL = ["position", "page_file", "page_doc", "page_pos"]
#: Layouts: found out by file and size; JSON lines in splittable files, whatever their size.
LAYOUTS = ("auto", "lines")


def parse_json(text: Column) -> Column:
    return F.from_json(text, PAGE, {"columnNameOfCorruptRecord": CORRUPT})


def whole_documents(texts: DataFrame) -> DataFrame:
    """(page_file, page_doc, document, page) of files read whole: a document, or JSON lines if the first line is one."""
    lines = F.filter(F.split("value", r"\R"), lambda x: F.trim(x) != "")
    first = parse_json(F.get(lines, F.lit(0)))
    by_line = first[CORRUPT].isNull() & first["response"].isNotNull()
    each = F.posexplode(F.when(by_line, lines).otherwise(F.array("value"))).alias("page_doc", "document")
    return _parsed(texts.select(F.col("_metadata.file_path").alias("page_file"), each))


def line_documents(texts: DataFrame, number: Column) -> DataFrame:
    """The same of files read by line; ``number`` tells the lines of a file apart."""
    return _parsed(texts.select(F.col("_metadata.file_path").alias("page_file"), number.cast("long").alias("page_doc"), F.col("value").alias("document")))


def _parsed(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("page_doc", F.col("page_doc").cast("long"))
    return docs.where(F.trim("document") != "").withColumn("page", parse_json(F.col("document")))


def documents(reader, path: str, layout: str = "auto", number: Column | None = None, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Documents of all files under ``path``.  ``reader`` is ``spark.read`` or ``spark.readStream``; the size of a file
    is known from the listing, so no file is opened for the other layout.  ``number``: see :func:`line_documents`."""
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}")
    number = F.monotonically_increasing_id() if number is None else number
    # pages lie in folders of their own names: no column is made of them
    text = lambda whole: reader().option("recursiveFileLookup", True).text(path, wholetext=whole)
    if layout == "lines":
        return line_documents(text(False), number)
    large = F.col("_metadata.file_size") > whole_bytes
    return whole_documents(text(True).where(~large)).unionByName(line_documents(text(False).where(large), number))


def _is_corrupt() -> Column:
    return F.col(f"page.{CORRUPT}").isNotNull() | F.col("page.response").isNull()


def rows_of(docs: DataFrame) -> DataFrame:
    """The rows of parsed documents; a corrupt one raises."""
    why = F.concat(F.lit("page that cannot be read: "), F.col("page_file"), F.lit(": "), F.left("document", F.lit(200)))
    data = F.when(_is_corrupt(), F.raise_error(why)).otherwise(F.col("page.response.data"))
    number = lambda c: F.col(c).try_cast("long")
    each = docs.select("page_file", "page_doc", number("page.response.total").alias("page_total"), number("page.request.params.offset").alias("_offset"), F.posexplode(data).alias("page_pos", "r"))
    both = [F.coalesce(F.col("r")[c], F.col("r")[WIRE_NAMES[c]]).alias(c) if c in WIRE_NAMES else F.col("r")[c].alias(c) for c in READING_TEXT.names]
    return each.withColumn("position", F.col("_offset") + F.col("page_pos")).select("page_total", *both, *ARRIVAL)


def read_pages(spark: SparkSession, path: str, layout: str = "auto", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Rows of all pages under ``path``: ``page_total`` (the ``response.total`` of the page, as a
    number), the columns of a reading, and where each was found (``ARRIVAL``), which orders the
    readings where the feed has no ``ordinal``."""
    return rows_of(documents(lambda: spark.read, path, layout, whole_bytes=whole_bytes))


def corrupt_pages(spark: SparkSession, path: str, layout: str = "auto") -> DataFrame:
    """(page_file, document) of what ``read_pages`` raises on."""
    return documents(lambda: spark.read, path, layout).where(_is_corrupt()).select("page_file", "document")


# ---------------------------------------------------------------- what has come
def page_intervals(rows: DataFrame, key: str = "respondent") -> DataFrame:
    """One row a page that tells its offset: (key, page_file, page_doc, start, end, total, reach), ``reach`` being
    the end of what the pages before it cover (by start, longer ones and earlier files first)."""
    start = (F.col("position") - F.col("page_pos")).alias("start")
    pages = rows.where(F.col("position").isNotNull()).groupBy(key, "page_file", "page_doc", start)
    pages = pages.agg((F.max("position") + 1).alias("end"), F.max("page_total").alias("total"))
    before = Window.partitionBy(key).orderBy("start", F.desc("end"), "page_file", "page_doc").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)).cast("long"))


def page_completeness(rows: DataFrame, key: str = "respondent") -> DataFrame:
    """Per request series: rows received, each place of the result once, the total the service announced, and
    whether all places arrived.  Rows of pages without an offset count each."""
    new = F.greatest(F.col("end") - F.greatest("start", "reach"), F.lit(0))
    placed = page_intervals(rows, key).groupBy(key).agg(F.sum(new).alias("_rows"), F.max("total").alias("_total"))
    others = rows.where(F.col("position").isNull()).groupBy(key).agg(F.count("*").alias("_rows"), F.max("page_total").alias("_total"))
    out = placed.unionByName(others).groupBy(key).agg(F.sum("_rows").alias("rows"), F.max("_total").alias("total"))
    return out.withColumn("complete", F.coalesce(F.col("rows") >= F.col("total"), F.lit(False)))


def page_gaps(rows: DataFrame, key: str = "respondent") -> DataFrame:
    """(key, gap_start, gap_end): places of the result (0-based, the end not included) that no page covers."""
    pages = page_intervals(rows, key)
    inner = pages.where(F.col("start") > F.col("reach")).select(key, F.col("reach").alias("gap_start"), F.col("start").alias("gap_end"))
    ends = pages.groupBy(key).agg(F.max("end").alias("gap_start"), F.max("total").alias("gap_end"))
    return inner.unionByName(ends.where(F.col("gap_end") > F.col("gap_start")))


def first_rows(rows: DataFrame, key: str = "respondent") -> DataFrame:
    """``rows``, each place of a result once: of pages that repeat or overlap, the part that pages before
    cover goes.  The rows are written once (their pages are parsed once), and so are the pages that are not
    new, which are joined to them."""
    rows = cut_lineage(rows, "page-rows")
    again = cut_lineage(page_intervals(rows, key).where(F.col("start") < F.col("reach")), "pages-again")
    again = again.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("page_file", "page_doc", "start", "reach")])
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("page_file") == F.col("_page_file")) & (F.col("page_doc") == F.col("_page_doc"))
    seen = rows.join(again, same & (F.col("position") - F.col("page_pos") == F.col("_start")), "left")
    return seen.where(F.col("_reach").isNull() | (F.col("position") >= F.col("_reach"))).select(rows.columns)


def require_complete(rows: DataFrame, key: str = "respondent") -> DataFrame:
    """``rows``, each once, after a job that raises if a place of a series has not come."""
    rows = first_rows(rows, key)
    missing = page_completeness(rows, key).where("NOT complete").orderBy(key).limit(20).collect()
    if missing:
        gaps = {r[0]: r[1] for r in page_gaps(rows, key).groupBy(key).agg(F.min("gap_start")).where(F.col(key).isin([r[key] for r in missing])).collect()}
        at = lambda k: f" (from {gaps[k]} on)" if k in gaps else ""
        raise ValueError("pages are missing: " + "; ".join(f"{r[key]}: {r['rows']} of {r['total']} rows{at(r[key])}" for r in missing))
    return rows


def land_pages(readings_text: DataFrame, path: str, page_rows: int = PAGE_ROWS, key: str = "respondent", wire: bool = False, missing: Column | None = None, again: Column | None = None) -> str:
    """Write text readings as pages of at most ``page_rows`` rows per ``key`` (page = ordinal div
    page_rows, so a page never exceeds the bound).  Returns ``path``.

    JSON lines under the column names; with ``wire`` as the service sends them: names of the wire,
    no ordinal, a document a file in folders by key, every other page pretty-printed.  Pages for which
    ``missing`` holds (an expression over ``_page``) are left out, those of ``again`` come twice.

    Places and totals come from a table of page sizes; the rows of a page are shuffled to their page only, and
    the files are written by as many tasks as the session shuffles to."""
    cols = [c for c in READING_TEXT.names if not (wire and c == "ordinal")]
    # rows without an ordinal are the first page; plain equal keys, so that the join needs no shuffle of its own
    none = F.lit(-(1 << 63))
    paged = readings_text.withColumn("_slot", F.coalesce(F.floor(F.col("ordinal") / F.lit(page_rows)), none))
    before = Window.partitionBy(key).orderBy("_slot")
    sizes = paged.groupBy(key, "_slot").agg(F.count(F.lit(1)).alias("_n")).select(
        key, "_slot", (F.sum("_n").over(before) - F.col("_n")).cast("string").alias("offset"),
        F.sum("_n").over(Window.partitionBy(key)).cast("string").alias("total"),
    )
    row = F.struct(*[F.col(c).alias(WIRE_NAMES.get(c, c) if wire else c) for c in cols])
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", row.alias("row")))), lambda x: x["row"])
    # small tasks are not put together: pages are few bytes and much work
    tasks = int(readings_text.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = paged.repartition(tasks, key, "_slot").groupBy(key, "_slot").agg(in_order.alias("data"))
    # merged, since the side with the texts is never to be broadcast, nor the sizes where they are many
    pages = pages.join(sizes.hint("merge"), [key, "_slot"])
    pages = pages.withColumn("_page", F.when(F.col("_slot") != none, F.col("_slot")))
    if missing is not None:
        pages = pages.where(~missing)
    if again is not None:
        pages = pages.withColumn("_copy", F.explode(F.when(again, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    params = F.struct(F.struct("offset", F.lit(str(page_rows)).alias("length")).alias("params"))
    response = F.struct(params.alias("request"), F.struct(F.col("total"), F.col("data")).alias("response"))
    doc = F.to_json(response)
    if not wire:
        pages.select(doc.alias("value")).write.mode("overwrite").text(path)
        return path
    doc = F.when(F.col("_page") % 2 == 0, F.to_json(response, {"pretty": "true"})).otherwise(doc)
    out = pages.select(doc.alias("value"), key)
    # the tasks move their files to their place; else the driver moves one after the other
    moved = {"mapreduce.fileoutputcommitter.algorithm.version": "2", "maxRecordsPerFile": "1"}
    out.write.mode("overwrite").options(**moved).partitionBy(key).text(path)
    return path
