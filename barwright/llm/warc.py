"""WARC: resolution of not-modified revisits by an as-of join over canonical URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch

# The fields that a 304 response may update (RFC 9110, 15.4.5, and the other validator).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that say where a visitor came from.
TRACKING = r"^(utm_[^=]*|gclid|fbclid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host (lower case, without user, `www.` and default port), path (without closing slashes) and the sorted query
    parameters but those of TRACKING; scheme and fragment go. Null where the URL is null or has no `://`."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*", 0), "^.*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    tail = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.when(scheme != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.when(path == "", "/").otherwise(path), tail))


def _lower_names(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only the last one's value stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]
    return F.coalesce(F.map_from_entries(F.transform(names, lambda n: F.struct(n, last(n)))), F.expr("cast(map() as map<string,string>)"))


def _opaque(etag: Column) -> Column:
    """What weak comparison of entity tags looks at."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit record: record_id, key (canonical URL), refers_to, verdict, headers (map) and body.

    records: record_id, url, fetched_at (any type with an order), type (`response`, `revisit` or another), status,
    headers (map of strings) and body. A full response has type `response`, status 200 and a body; a revisit has type
    `revisit` and status 304. Each revisit meets the latest full response of its canonical URL that is strictly earlier
    (of equal times the largest record_id). Its ETag, or else its Last-Modified, must be that response's (weak
    comparison); without either, the response must have neither. verdict: `resolved`; `changed` (the latest response
    has other validators; refers_to is null); `missing` (there is no earlier one). Headers are the response's, with
    those fields of the revisit put in that a 304 may update; where unresolved, the revisit's own, and a null body.

    The as-of join is one range partitioning by (URL, time), so a URL with a third of all records is cut into as many
    pieces as others are; in each piece a window carries the last response on, and what earlier pieces of the same URL
    end with is carried over in a table of one row per piece at most. Bodies are not sorted: they join by record_id.

    Null URLs and times have no earlier response (`missing`); null record_ids can't be referred to; repeated revisit
    rows each give a row; of rows that repeat a response's record_id, the greatest headers and body count; empty
    tables give no rows; other columns are ignored.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "warc")
    base = records.select("record_id", canonical_url(F.col("url")).alias("key"), "fetched_at", "type", "status", _lower_names(F.col("headers")).alias("headers"), "body")
    full = F.coalesce((F.col("type") == "response") & (F.col("status") == 200) & F.col("body").isNotNull() & F.col("record_id").isNotNull(), F.lit(False))
    revisit = F.coalesce((F.col("type") == "revisit") & (F.col("status") == 304), F.lit(False))
    slim = base.select("record_id", "key", "fetched_at", full.alias("full"), F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"), F.when(revisit, F.col("headers")).alias("own"), revisit.alias("revisit")).where("full or revisit")

    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = slim.where("key is not null and fetched_at is not null").repartitionByRange(pieces, "key", "fetched_at")
    dealt = scratch.keep(ordered.withColumn("piece", F.spark_partition_id()), "dealt")  # written, so that a rerun can't deal otherwise
    response = F.when(F.col("full"), F.struct("fetched_at", "record_id", "etag", "modified"))
    # at equal times revisits stand first, so that only strictly earlier responses lie before them
    sweep = Window.partitionBy("piece", "key").orderBy("fetched_at", "full", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("inside", F.last(response, ignorenulls=True).over(sweep)).where("revisit")

    # only the first URL of a piece can go on from earlier pieces: one row per piece
    firsts = dealt.groupBy("piece").agg(F.min("key").alias("key"))
    ends = dealt.join(F.broadcast(firsts.select("key").distinct()), "key").groupBy("key", "piece").agg(F.max(response).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    carried = scratch.keep(ends.select("key", "piece", before.alias("carried")).where("carried is not null").join(firsts, ["key", "piece"], "left_semi"), "carried")
    found = swept.join(F.broadcast(carried), ["key", "piece"], "left").withColumn("found", F.coalesce("inside", "carried"))

    fits = (
        F.when(F.col("etag").isNotNull(), _opaque(F.col("etag")) == _opaque(F.col("found.etag")))
        .when(F.col("modified").isNotNull(), F.trim("modified") == F.trim("found.modified"))
        .otherwise(F.col("found.etag").isNull() & F.col("found.modified").isNull())
    )
    verdict = F.when(F.col("found").isNull(), "missing").when(F.coalesce(fits, F.lit(False)), "resolved").otherwise("changed")
    judged = found.withColumn("verdict", verdict).select("record_id", "key", F.when(F.col("verdict") == "resolved", F.col("found.record_id")).alias("refers_to"), "verdict", "own")
    no_place = slim.where("revisit and (key is null or fetched_at is null)").select("record_id", "key", F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to"), F.lit("missing").alias("verdict"), "own")
    judged = scratch.keep(judged.unionByName(no_place), "judged")

    stored = base.where(full).select(F.col("record_id").alias("refers_to"), F.struct(F.array_sort(F.map_entries("headers")).alias("headers"), "body").alias("stored"))
    # ids are unique as a rule, and then bodies are moved once; only those of repeated ids are grouped
    repeated = scratch.keep(stored.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("refers_to"), "repeated")
    if not repeated.isEmpty():
        one = stored.join(repeated.hint("merge"), "refers_to", "left_semi").groupBy("refers_to").agg(F.max("stored").alias("stored"))
        stored = scratch.keep(stored.join(repeated.hint("merge"), "refers_to", "left_anti").unionByName(one), "stored")
    updates = F.map_filter("own", lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.map_from_entries("stored.headers"), lambda k, v: ~F.map_contains_key(updates, k))
    headers = F.when(F.col("stored").isNotNull(), F.map_concat(kept, updates)).otherwise(F.col("own"))
    # nothing stands between the join and its shuffles, so adaptive execution can split a response that very many
    # revisits refer to
    return judged.join(stored.hint("merge"), "refers_to", "left").select("record_id", "key", "refers_to", "verdict", headers.alias("headers"), F.col("stored.body").alias("body"))
