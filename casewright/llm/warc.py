"""WARC revisit resolution: 304 captures regain the response they stand for.

A not-modified capture is joined as of its time to the latest strictly earlier full
response (a status of ``COMPLETE``) of the same canonical URL. The join is a running maximum over both record kinds,
in two levels - buckets of a URL, then rows within a bucket. Buckets are ranges of (URL, time)
with about ``bucket_rows`` captures each, so a URL with a third of all captures is spread over
many tasks, however short the time they fall in; only captures of one URL and one time stay
together. Validators must agree (entity tags compared weakly,
else modification dates); then the response's headers are taken and the permitted ones of
the 304 replace them. Only DataFrame functions; bodies are not moved.

Defined cases: records without URL or time stay unresolved (``no_key``); a 304 with no
earlier full response is ``no_response``; header names match in any case, the first by name
counts where one is repeated; validators that differ, or are missing on either side,
give ``validator_mismatch``; responses of one time are ordered by record_id and later ids
win; repeated 304 rows are resolved each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.llm._store import materialize, table

#: Fields a 304 may update in the stored response.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Statuses whose response is the whole resource: not 206, redirects or errors.
COMPLETE = (200, 203)
#: Query parameters that do not choose the resource.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid|sid)(=|$)"
BUCKET_ROWS = 20_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, default port and user; no scheme, fragment, closing slash or tracking parameters; the others sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^[^@]*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r"(:80|:443)$", ""), r"^www[0-9]*\.", "")
    rest = F.regexp_replace(bare, r"^[^/?]*", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), r"/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_replace(rest, r"^[^?]*\??", ""), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def bucketed(captures: DataFrame, bucket_rows: int) -> DataFrame:
    """``captures`` with their ``bucket``, rising with (curl, ts). A written table, since every reading of sampled ranges could cut them anew."""
    ranges = max(1, -(-captures.count() // bucket_rows))
    return materialize(captures.repartitionByRange(ranges, "curl", "ts").withColumn("bucket", F.spark_partition_id()), "captures")


def resolve_revisits(records: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per 304 of ``records`` (record_id long, url, ts long, status int, headers map, digest).

    Returns record_id, curl, ts, resolution, response_id, response_ts, digest, headers (map).
    """
    fields = F.array_sort(F.map_entries("headers"))
    header = lambda name: F.get(F.filter(fields, lambda e: F.lower(e["key"]) == name), 0)["value"]
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("curl"), "ts", (F.col("status") == 304).alias("revisit"), F.col("status").isin(*COMPLETE).alias("complete"), header("etag").alias("etag"), header("last-modified").alias("modified"), fields.alias("fields"), "digest"
    )
    keyed = rows.where("curl is not null and ts is not null")
    keyed = bucketed(keyed, bucket_rows)
    full = F.when(F.col("complete"), F.struct("ts", "record_id", "etag", "modified", "digest", "fields"))
    ends = keyed.where("complete").groupBy("curl", "bucket").agg(F.max(full).alias("end"))
    wanted = keyed.where("revisit").select("curl", "bucket").distinct().withColumn("end", F.lit(None).cast(ends.schema["end"].dataType))
    before = Window.partitionBy("curl").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.unionByName(wanted).withColumn("carried", F.max("end").over(before)).groupBy("curl", "bucket").agg(F.max("carried").alias("carried"))
    inside = Window.partitionBy("curl", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    found = keyed.withColumn("near", F.max(full).over(inside)).where("revisit").join(carried, ["curl", "bucket"], "left")
    found = found.withColumn("response", F.coalesce("near", "carried"))
    tags = F.col("etag").isNotNull() & F.col("response.etag").isNotNull()
    agree = F.when(tags, _weak(F.col("etag")) == _weak(F.col("response.etag"))).otherwise(F.coalesce(F.col("modified") == F.col("response.modified"), F.lit(False)))
    resolution = F.when(F.col("response").isNull(), "no_response").when(agree, "resolved").otherwise("validator_mismatch")
    found = found.withColumn("resolution", resolution)
    unkeyed = rows.where("revisit and (curl is null or ts is null)").withColumn("resolution", F.lit("no_key"))
    found = found.unionByName(unkeyed, allowMissingColumns=True)
    ok = F.col("resolution") == "resolved"
    permitted = lambda e: F.lower(e["key"]).isin(*PERMITTED)
    updates = F.filter("fields", permitted)
    kept = F.filter("response.fields", lambda e: ~F.exists(updates, lambda u: F.lower(u["key"]) == F.lower(e["key"])))
    return found.select(
        "record_id", "curl", "ts", "resolution",
        F.when(ok, F.col("response.record_id")).alias("response_id"), F.when(ok, F.col("response.ts")).alias("response_ts"),
        F.when(ok, F.col("response.digest")).alias("digest"), F.when(ok, F.map_from_entries(F.concat(kept, updates))).alias("headers"),
    )


#: Ticks between the capture of a page and the repeated request for it.
REVISIT_AFTER = 2001


def page_captures(pages: DataFrame) -> DataFrame:
    """Capture log of ``pages`` (page_id, url, html): a full response at tick 2 * page_id and, for every page, a 304 with its entity tag ``REVISIT_AFTER`` ticks later."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    tag, ts = F.concat(F.lit('"'), F.md5(html), F.lit('"')), F.col("page_id").cast("long") * 2
    text = lambda c: c.cast("string")
    fields = lambda *kv: F.map_from_arrays(F.array(*[F.lit(k) for k, _ in kv]), F.array(*[v for _, v in kv]))
    full = pages.select(
        F.col("page_id").cast("long").alias("record_id"), "url", ts.alias("ts"), F.lit(200).alias("status"), F.md5(html).alias("digest"),
        fields(("content-type", F.lit("text/html")), ("content-length", text(F.octet_length(html))), ("etag", tag), ("cache-control", F.lit("max-age=60")), ("date", text(ts))).alias("headers"),
    )
    later = ts + REVISIT_AFTER
    again = pages.select(
        F.col("page_id").cast("long").alias("record_id"), "url", later.alias("ts"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("digest"),
        fields(("etag", F.concat(F.lit("W/"), tag)), ("date", text(later)), ("expires", text(later + 60)), ("content-length", F.lit("0"))).alias("headers"),
    )
    return full.unionByName(again)


def op9_revisit_resolution(spark, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "curl", "ts", "resolution", "response_id", "response_ts", "digest", F.array_join(lines, "\n").alias("headers"))


ORACLE = r"""
with p as (
  select page_id, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare, coalesce(html, '') as html from pages),
q as (
  select page_id, html, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^[^@]*@', ''), '(:80|:443)$', ''), '^www[0-9]*\.', '') as host,
         regexp_replace(bare, '^[^/?]*', '') as rest from p),
c as (
  select page_id, md5(html) as digest, strlen(html) as bytes, host, regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') as path,
         array_to_string(list_sort(list_filter(string_split(regexp_replace(rest, '^[^?]*\??', ''), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessid|sid)(=|$)'))), '&') as params from q),
u as (select page_id, digest, bytes, host || path || case when params <> '' then '?' || params else '' end as curl from c),
j as (
  select r.page_id as record_id, r.curl, 2 * r.page_id + 2001 as ts, r.digest as want,
         max_by(f.page_id, 2 * f.page_id) as fid from u r left join u f on f.curl = r.curl and 2 * f.page_id < 2 * r.page_id + 2001 group by all)
select j.record_id, j.curl, j.ts,
       case when f.page_id is null then 'no_response' when f.digest = j.want then 'resolved' else 'validator_mismatch' end as resolution,
       case when f.digest = j.want then f.page_id end as response_id, case when f.digest = j.want then 2 * f.page_id end as response_ts,
       case when f.digest = j.want then f.digest end as digest,
       case when f.digest = j.want then 'cache-control: max-age=60' || chr(10) || 'content-length: ' || f.bytes || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || j.ts || chr(10)
            || 'etag: W/"' || f.digest || '"' || chr(10) || 'expires: ' || (j.ts + 60) end as headers
from j left join u f on f.page_id = j.fid
"""
