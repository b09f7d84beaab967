"""Resolution of not-modified revisit records in web archives.

A revisit says that a page was unchanged; its payload is that of an earlier
full response. For every revisit we find the latest full response to the same
canonical URL that is not later, check that the validators agree (entity tags
by weak comparison, or else the modification dates), and merge the headers a
304 answer may update into the stored ones.

URLs of at most ``slot_rows`` records are resolved by a window each. The records
of larger ones, if there are any, are range-partitioned by URL, time and id, and
their responses and revisits are numbered by running sums over the partitions as
they lie: a revisit's response is the one that has the number reached there.
Revisits of one response go to it in runs of ``slot_rows``, so no group grows with
the data, not even where all records of a URL have one time.

Columns of ``records``: ``record_id``, ``kind`` (``response`` or ``revisit``),
``url``, ``ts``, ``headers`` (map), and any others.

Edge cases: a null URL or time never matches; null headers are none. Header
names compare without case, the last of equal names wins. Records of equal time
are ordered by ``record_id``; a response of the same time but no smaller id doesn't
count. Equal rows each give a row. Extra columns are ignored. A revisit without
earlier response is ``no_response``, one whose validators differ or are missing
on either side is ``validator_mismatch``; both have null ``response_id``. An
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import cut
from sievekit.operators.prefix import running_sum

#: fixed values: fields that a 304 answer doesn't update (HTTP caching, RFC 9111 section 3.2)
KEPT_FIELDS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection",
    "te", "trailer", "transfer-encoding", "upgrade",
)
SLOT_ROWS = 50_000


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, scheme, user and default port;
    path without a closing slash; query sorted, without ``utm_*``; no fragment."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^utm_"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _lower_names(headers: Column) -> Column:
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries) + 1), lambda x: x["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def same_validators(revisit: Column, response: Column) -> Column:
    """Entity tags agree if both have one; else the modification dates must."""
    a, b = revisit["etag"], response["etag"]
    tags = a.isNotNull() & b.isNotNull()
    dates = F.coalesce(revisit["last-modified"] == response["last-modified"], F.lit(False))
    return F.when(tags, _weak(a) == _weak(b)).otherwise(dates)


def merged_headers(revisit: Column, response: Column) -> Column:
    news = F.map_filter(revisit, lambda k, _: ~k.isin(*KEPT_FIELDS))
    return F.map_concat(F.map_filter(response, lambda k, _: ~F.map_contains_key(news, k)), news)


def _asof(rows: DataFrame, response: Column) -> DataFrame:
    """Revisits with the last response before them, a window per URL."""
    before = Window.partitionBy("canonical").orderBy("ts", "record_id", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("response", F.last(response, ignorenulls=True).over(before)).where("kind = 'revisit'")
    return out.select("record_id", "canonical", "headers", "response")


def _asof_hot(rows: DataFrame, n_rows: int, slot_rows: int) -> DataFrame:
    """The same for URLs of any size."""
    spark = rows.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // slot_rows))
    marked = rows.withColumns({"a": (F.col("kind") == "response").cast("long"), "b": (F.col("kind") == "revisit").cast("long")})
    order = [F.col("ts").asc(), F.col("record_id").asc(), F.col("kind").desc()]
    numbered = running_sum(marked, ["canonical"], order, ["a", "b"], partitions)
    run = F.floor(F.col("cum_b") / slot_rows)
    revisits = numbered.where("b = 1").select("record_id", "canonical", "headers", F.col("cum_a").alias("nth"), run.alias("run"))
    asked = revisits.select("canonical", "nth", "run").distinct()
    responses = numbered.where("a = 1").select("canonical", F.col("cum_a").alias("nth"), F.struct("ts", "record_id", "headers").alias("response"))
    answers = asked.join(responses, ["canonical", "nth"])
    return revisits.join(answers, ["canonical", "nth", "run"], "left").select("record_id", "canonical", "headers", "response")


def resolve(records: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Per revisit: ``record_id``, ``canonical``, ``status`` (``resolved``,
    ``no_response``, ``validator_mismatch``), ``response_id``, ``headers``."""
    rows = records.select(
        "record_id", "kind", "ts", canonical_url(F.col("url")).alias("canonical"), _lower_names(F.col("headers")).alias("headers")
    )
    usable = F.col("ts").isNotNull() & F.col("canonical").isNotNull()
    known = rows.where(usable & F.col("kind").isin("response", "revisit"))
    hot = cut(known.groupBy("canonical").agg(F.count(F.lit(1)).alias("n_url")).where(F.col("n_url") > slot_rows))
    n_hot = hot.agg(F.sum("n_url")).first()[0]
    last = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "headers"))
    if n_hot:
        dealt = known.join(hot, "canonical", "left")
        found = _asof(dealt.where("n_url IS NULL"), last).unionByName(_asof_hot(dealt.where("n_url IS NOT NULL").drop("n_url"), n_hot, slot_rows))
    else:
        found = _asof(known, last)
    never = rows.where(~F.coalesce(usable, F.lit(False)) & (F.col("kind") == "revisit")).select("record_id", "canonical", "headers", F.lit(None).cast(found.schema["response"].dataType).alias("response"))
    out = found.unionByName(never)
    fits = same_validators(F.col("headers"), F.col("response.headers"))
    status = F.when(F.col("response").isNull(), "no_response").when(fits, "resolved").otherwise("validator_mismatch")
    good = status == "resolved"
    return out.select(
        "record_id", "canonical", status.alias("status"),
        F.when(good, F.col("response.record_id")).alias("response_id"),
        F.when(good, merged_headers(F.col("headers"), F.col("response.headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Web-archive records derived from crawled pages: a full response per
    page, and a later revisit whose entity tag agrees for most pages."""
    day = 86_400
    made = F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(secs=F.col("page_id").cast("decimal(18,6)") * 60)
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    pick = F.conv(F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    text = F.col("page_id").cast("string")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), "url", made.alias("ts"),
        F.create_map(
            F.lit("ETag"), F.when(pick % 5 == 4, None).otherwise(tag), F.lit("Last-Modified"), F.concat(F.lit("day "), (pick % 365).cast("string")),
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60"),
        ).alias("headers"),
    )
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url",
        (made + F.make_dt_interval(secs=((pick % (30 * day)) - day).cast("decimal(18,6)"))).alias("ts"),
        F.create_map(
            F.lit("etag"), F.when(pick % 7 == 6, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag)), F.lit("last-modified"), F.concat(F.lit("day "), (pick % 365).cast("string")),
            F.lit("Content-Length"), F.lit("0"), F.lit("cache-control"), F.lit("no-cache"), F.lit("Date"), text,
        ).alias("headers"),
    )
    drop_null = lambda d: d.withColumn("headers", F.map_filter("headers", lambda _, v: v.isNotNull()))
    return drop_null(response).unionByName(drop_null(revisit))


def resolve_pages(pages: DataFrame) -> DataFrame:
    """``resolve`` over the pages' captures; ids as text, headers as sorted
    lines."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return resolve(captures(pages)).withColumns({"headers": lines, "response_id": F.col("response_id").cast("string")})
