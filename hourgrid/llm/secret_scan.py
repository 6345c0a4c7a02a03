"""Secret scans with multipart credential linking, in DataFrame functions only.

Base spans (assignments, access identifiers, hexadecimal runs) are always reported.  Weak
candidates are parts that mean little alone: short assigned values, 40-character keys without
a name, user or client identifiers, endpoints.  A part is an interval of its text; the join of
intervals is a sweep in the order of starts that finds the nearest identifier and the nearest
secret on either side.  A weak candidate is reported only if complementary parts lie within
``scope`` characters of it: an identifier needs a secret, a secret an identifier, an endpoint
both.  Weak candidates that overlap a base span are part of it and not reported.

Two sweeps, from the beginning and from the end, over the sorted parts of one document: no pairs are made, and
the work beside the sorts is linear in the parts.  A text with very many parts is one group of them.  Places
are code points; they come from the lengths of what a pattern matches and of what lies between.

Null and empty texts have no spans.  Repeated rows and null keys are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import fresh, staged, with_row_place

#: Characters between two parts of one credential.
SCOPE = 200

# Patterns by kind, in the order of the report; the group that holds the value.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (
    ("assign", ASSIGN, 2),
    ("access", r"AKIA[A-Z0-9]{14,}", 0),
    ("hex", r"[0-9a-f]{16,}", 0),
    ("session", r"(?:ASIA|AIDA|AROA)[A-Z0-9]{12,}", 0),
    ("named_id", r"""(?i)(access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", 2),
    ("short_secret", ASSIGN, 2),
    ("bare_key", r"[A-Za-z0-9+/]{40,}", 0),
    ("url", r"""(?i)https?://[^\x00-\x20"'<>|]+""", 0),
    ("host", r"""(?i)(endpoint|host|server)["']?\x20*[:=]\x20*["']?([A-Za-z0-9-]+[.][A-Za-z0-9.:-]+)""", 2),
)
KINDS = [k for k, _, _ in PATTERNS]
BASE = KINDS[:3]
IDENTIFIERS = ["access", "session", "named_id"]
SECRETS = ["assign", "hex", "short_secret", "bare_key"]


def _part(kind: str, match: Column, value: Column) -> Column:
    """Number of the kind that a match is a part of; null if of none."""
    own, n = F.lit(KINDS.index(kind)), F.length(value)
    if kind == "assign":
        return F.when(n >= 12, own).when(n >= 6, F.lit(KINDS.index("short_secret")))
    if kind == "bare_key":
        return F.when((F.length(match) == 40) & match.rlike("[0-9]") & match.rlike("[A-Z]") & match.rlike("[a-z]"), own)
    return own


def _items(text: Column, number: int) -> Column:
    """(list, nth, gap, size, kind) of the matches of a pattern, in order: the characters since
    the match before, those of the match, and the kind of part that it is."""
    kind, pattern, group = PATTERNS[number]
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.arrays_zip(F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("v"))
    items = F.transform(
        found,
        lambda x, i: F.struct(
            F.lit(number).alias("list"),
            i.alias("nth"),
            F.get(gaps, i).alias("gap"),
            F.length(x["m"]).alias("size"),
            _part(kind, x["m"], x["v"]).alias("kind"),
        ),
    )
    return F.when(text.rlike(pattern), items)


def parts(docs: DataFrame, row: str, text: str) -> DataFrame:
    """(row, kind, start, end) of every part; ``kind`` is its number in ``PATTERNS``."""
    t = F.col(text)
    # short secrets have the pattern of assignments: one list serves both
    numbers = [n for n, k in enumerate(KINDS) if k != "short_secret"]
    lists = [F.coalesce(_items(t, n), F.array()) for n in numbers]
    hit = t.rlike("|".join(f"(?:{PATTERNS[n][1]})" for n in numbers))
    found = docs.where(hit).select(F.col(row).alias("row"), F.explode(F.flatten(F.array(*lists))).alias("x")).select("row", "x.*")
    upto = Window.partitionBy("row", "list").orderBy("nth")
    ended = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto))
    return ended.where("kind IS NOT NULL").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts to report: base spans, and weak ones whose complements lie within ``scope``."""
    number = {k: n for n, k in enumerate(KINDS)}
    base = F.col("kind") < len(BASE)
    is_id = F.col("kind").isin([number[k] for k in IDENTIFIERS])
    is_secret = F.col("kind").isin([number[k] for k in SECRETS])
    row = Window.partitionBy("row")
    before = row.orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    # the parts behind, swept from the end: a frame that reaches to the end would be made anew for each row
    after = row.orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)

    def gap(role: Column) -> Column:
        """Characters to the nearest part of a role on either side (0 or less: they touch)."""
        left = F.col("start") - F.max(F.when(role, F.col("end"))).over(before)
        right = F.min(F.when(role, F.col("start"))).over(after) - F.col("end")
        return F.least(left, right)

    to_id, to_secret, to_base = (F.coalesce(gap(role), F.lit(1 << 40)) for role in (is_id, is_secret, base))
    swept = found.select("*", to_id.alias("to_id"), to_secret.alias("to_secret"), to_base.alias("to_base"))
    near_id, near_secret = F.col("to_id") <= scope, F.col("to_secret") <= scope
    complete = F.when(is_id, near_secret).when(is_secret, near_id).otherwise(near_id & near_secret)
    return swept.where(base | (complete & (F.col("to_base") >= 0))).select("row", "kind", "start", "end")


def spans(docs: DataFrame, row: str, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(row, kind, start, end): all spans to report."""
    return linked(parts(docs, row, text), scope)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base, spans) of every document; ``base`` and ``spans``
    are arrays of (start, kind, end) by start, then kind."""
    d = with_row_place(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "row")
    item = F.struct("start", "kind", "end")
    of_doc = spans(d, "row", "text", scope).groupBy("row").agg(
        *[F.count_if(F.col("kind") == n).alias(f"n_{k}") for n, k in enumerate(BASE)],
        F.sort_array(F.collect_list(F.when(F.col("kind") < len(BASE), item))).alias("base"),
        F.sort_array(F.collect_list(item)).alias("spans"),
    )
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return d.select("row", "key").join(of_doc, "row", "left").select(
        "key", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in BASE], *[F.coalesce(c, none).alias(c) for c in ("base", "spans")]
    )


def told(found: Column) -> Column:
    """An array of spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", scope: int = SCOPE, mask: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mask``; spans that overlap become one.

    Documents without a match of any pattern keep their place: only the others are shuffled."""
    row, merged = fresh(docs, "row"), fresh(docs, "merged")
    d = with_row_place(docs, row)
    order = Window.partitionBy("row").orderBy("start", "end")
    found = spans(d, row, text, scope).withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    group = F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order)
    joined = found.withColumn("group", group).groupBy("row", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    places = F.sort_array(F.collect_list(F.struct("start", "end")))
    cuts = staged(joined.groupBy("row").agg(places.alias(merged)).withColumnRenamed("row", row), "secret-spans")
    t, m = F.col(text), F.col(merged)

    def tail(x: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(m, i + 1)["start"], F.length(t))
        return F.concat(F.lit(mask), t.substr((x["end"] + 1).cast("int"), (stop - x["end"]).cast("int")))

    masked = F.concat(t.substr(F.lit(1), F.get(m, F.lit(0))["start"].cast("int")), F.array_join(F.transform(m, tail), ""))
    out = d.join(cuts, row, "left")
    return out.withColumn(text, F.when(m.isNotNull(), masked).otherwise(t)).select(docs.columns)


__all__ = ["KINDS", "PATTERNS", "linked", "parts", "redact", "scan", "spans", "told"]
