"""Resolution of not-modified revisits in web archives.

A revisit record (status 304) has no body of its own; it stands for the latest earlier full response
(status 200) of the same canonical URL. That is an as-of join. Rows are range-partitioned and sorted by
(canonical URL, time), each task walks its range once, and what a range leaves open at its start
is answered by the ranges before it: one row per range reaches the driver. A URL with a third of
all captures thus spreads over many ranges. The full response counts only if its validators agree
with the revisit's; then the headers a 304 may change replace the stored ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.session import written

#: Header fields that a 304 answer may update.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]

CAPTURES = "record_id bigint, url string, captured_at timestamp, status int, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without default port, user or leading www; no fragment; parameters sorted,
    without those that only track; no slash at the end of the path. Null if there is no scheme and host."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(host, "^www\\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|gclid|fbclid)="))
    text = F.array_join(F.array_sort(params), "&")
    whole = F.concat(F.lit("//"), host, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
    return F.when((scheme != "") & (host != ""), whole)


def lower_names(headers: Column) -> Column:
    """A header map with lower-case names; of names that then agree, the last one counts."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    merge = lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["k"]), F.map_from_arrays(F.array(e["k"]), F.array(e["v"])))
    return F.coalesce(F.aggregate(entries, F.create_map().cast("map<string,string>"), merge), F.create_map().cast("map<string,string>"))


def latest_before(captures: DataFrame) -> DataFrame:
    """``row, full_row`` of every revisit among (row, record_id, canon, at, full, rank): the latest full row strictly earlier.

    ``row`` tells rows apart. Of full rows at one time the largest id counts, before those without id; of
    equal ids the largest ``rank``. ``at`` is a number; ``full`` tells full rows.
    """
    rows = captures.where("canon is not null and at is not null").repartitionByRange("canon", "at")
    rows = rows.sortWithinPartitions("canon", "at").select("row", "canon", "at", "full", "record_id", "rank")
    names = ["part", "row", "canon", "full_row", "open", "kind"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = canon = at = before = newest = None
        begun = False
        for batch in batches:
            out = []
            for row, url, t, full, record, rank in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if not begun or url != canon:
                    first, begun = (first if begun else url), True
                    canon, at, before, newest = url, t, None, None
                elif t != at:
                    at, before, newest = t, newest[-1] if newest is not None else before, None
                if full:
                    this = (record is not None, record or 0, rank, row)
                    newest = this if newest is None else max(newest, this)
                else:
                    out.append((part, row, url, before, before is None and url == first, "revisit"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(6)], names)
        if begun:  # the range's first and last URL, and the last one's newest full row
            ends = [(part, None, first, None, False, "first"), (part, None, canon, newest[-1] if newest is not None else before, False, "last")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in ends], kinds[k]) for k in range(6)], names)

    found = written(rows.mapInArrow(walk, "part bigint, row bigint, canon string, full_row bigint, open boolean, kind string"), "as-of")
    ends = found.where("kind <> 'revisit'").collect()  # two rows per range
    firsts = {r["part"]: r["canon"] for r in ends if r["kind"] == "first"}
    lasts = {r["part"]: (r["canon"], r["full_row"]) for r in ends if r["kind"] == "last"}
    carried, canon, newest = [], None, None
    for part in sorted(firsts):
        if firsts[part] == canon and newest is not None:
            carried.append((part, newest))
        url, full = lasts[part]
        newest = full if full is not None else newest if url == canon else None
        canon = url
    spark = captures.sparkSession
    carry = spark.createDataFrame(carried, "part bigint, carried bigint")
    return (
        found.where("kind = 'revisit'")
        .join(carry, "part", "left")
        .select("row", F.when(F.col("open"), F.col("carried")).otherwise(F.col("full_row")).alias("full_row"))
    )


def resolve(captures: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical_url, captured_at, full_id, verdict, matched_by, headers.

    ``captures`` has the columns of ``CAPTURES``. Status 200 is a full response, 304 a revisit; other
    rows are ignored, as are other columns. Ids may repeat or be null: every revisit row gets one row
    of its own, and of full responses at one time the largest id counts, before those without id; of
    equal ids one is picked by a hash of its headers. ``full_id`` is then that response's id, null if
    it has none; only the verdict tells whether there is a response. Verdicts: ``resolved``;
    ``changed`` when the entity tags differ (weakly compared), or without tags the modification dates;
    ``missing`` without an earlier full response; ``no_url`` without canonical URL or time.
    ``matched_by`` names the validator that agreed: ``etag``, ``last-modified`` or ``none`` when the
    revisit carries neither, or the full response lacks it. Headers are null unless resolved.
    """
    rows = captures.where("status in (200, 304)").select(
        F.col("record_id").cast("bigint").alias("record_id"), canonical_url(F.col("url")).alias("canon"), "captured_at", F.unix_micros("captured_at").alias("at"), "status", lower_names(F.col("headers")).alias("headers")
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "captures")  # a key of its own, fixed by writing
    full, rank = F.col("status") == 200, F.xxhash64(F.array_sort(F.map_entries("headers")))
    found = latest_before(rows.select("row", "record_id", "canon", "at", full.alias("full"), F.when(full, rank).alias("rank")))
    revisits = rows.where("status = 304").join(found, "row", "left")
    full = rows.where(full).select(F.col("row").alias("full_row"), F.col("record_id").alias("full_id"), F.col("headers").alias("stored"))
    joined = revisits.join(full, "full_row", "left")
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    new, old = F.col("headers"), F.col("stored")
    tags = new["etag"].isNotNull() & old["etag"].isNotNull()
    dates = ~tags & new["last-modified"].isNotNull() & old["last-modified"].isNotNull()
    agrees = F.when(tags, weak(new["etag"]) == weak(old["etag"])).when(dates, new["last-modified"] == old["last-modified"]).otherwise(True)
    verdict = F.when(F.col("canon").isNull() | F.col("at").isNull(), "no_url").when(F.col("full_row").isNull(), "missing").when(agrees, "resolved").otherwise("changed")
    update = F.map_filter(new, lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(update), k)), update)
    return joined.withColumn("verdict", verdict).select(
        "record_id",
        F.col("canon").alias("canonical_url"),
        "captured_at",
        "full_id",
        "verdict",
        F.when(F.col("verdict") == "resolved", F.when(tags, "etag").when(dates, "last-modified").otherwise("none")).alias("matched_by"),
        F.when(F.col("verdict") == "resolved", merged).alias("headers"),
    )


def archive_of(pages: DataFrame) -> DataFrame:
    """A capture log derived from pages (page_id, url, html): per page a full response, revisits with agreeing,
    differing and missing validators, some before the response, and for every third page a newer response."""
    p = F.col("page_id")
    pages = pages.select("page_id", "url", F.md5("html").alias("digest"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    k = F.col("k")
    start = F.lit(1704067200) + F.pmod(p * 7919, F.lit(2592000))
    at = start + F.when((k == 3) & (p % 13 == 0), -3600).when(k == 4, 9000).otherwise(k * (p % 5 + 1) * 1800)
    status = F.when((k == 0) | ((k == 4) & (p % 3 == 0)), 200).otherwise(304)
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.when(k == 4, "-b").otherwise(""), F.lit('"'))
    tag = F.when((k == 2) & (p % 11 == 0), F.concat(F.lit("W/"), F.lit('"'), F.substring("digest", 17, 16), F.lit('"'))).when((k == 1) & (p % 2 == 0), F.concat(F.lit("W/"), tag)).otherwise(tag)
    tag = F.when((p % 7 == 0) | ((k == 3) & (p % 4 == 1)), None).otherwise(tag)
    modified = F.when((k == 3) & (p % 4 == 1), None).otherwise((start - 86400 + F.when((k == 2) & (p % 14 == 0), 60).otherwise(0)).cast("string"))
    headers = F.map_filter(
        F.create_map(
            F.lit("Date"), at.cast("string"), F.lit("ETag"), tag, F.lit("Last-Modified"), modified, F.lit("Cache-Control"), F.concat(F.lit("max-age="), (k * 60).cast("string")),
            F.lit("Content-Length"), F.when(status == 304, "0").otherwise("512"), F.lit("Content-Type"), F.when(status == 200, "text/html"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return pages.select((p * 10 + k).alias("record_id"), "url", F.timestamp_seconds(at).alias("captured_at"), status.alias("status"), headers.alias("headers"))
