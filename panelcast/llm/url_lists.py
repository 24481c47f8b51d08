"""URL filters: dated list entries as validity intervals, as-of joined with captures (DataFrame functions only).

An entry (key, time, action) holds from its time until the key's next entry.  A key is a host,
a parent domain or a host with a path prefix, as deep as the deepest entry.  A capture has the keys of its URL, most
specific first; the most specific key with an entry active at the fetch time decides, and a
capture that no entry speaks of is kept.

The as-of join is an equality join on (key, time bucket): an interval is copied into the buckets
it touches, so a capture meets the intervals around its own time only, and a hot host is dealt
over its buckets (what still is too much for one task is a skewed join that Spark splits).
Captures of one URL at one time are the same question and are asked once.

Defined cases: entries of one key at one time: ``block`` wins; entries without key, time or action are
ignored; an entry counts from its own instant on; a capture without URL or time matches nothing and is
kept; repeated captures give one row with their number; empty lists keep all, empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 32
LAST_DAY = 2932896  # 9999-12-31


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user or port; empty where there is none."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys(url: Column, path_parts: int = 2) -> Column:
    """Array of (key, rank): path prefixes, the host and its parent domains; a higher rank is more specific."""
    h, p = host(url), F.filter(F.split(path(url), "/"), lambda x: x != "")
    labels = F.split(h, "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), (F.size(labels) - i).alias("rank")))
    n = F.least(F.size(p), F.lit(path_parts))
    prefixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(h, F.lit("/"), F.array_join(F.slice(p, F.lit(1), i), "/")).alias("key"), (F.lit(1000) + i).alias("rank"))))
    return F.when(h != "", F.concat(F.filter(domains, lambda d: d["key"] != ""), F.coalesce(prefixes, F.slice(domains, F.lit(1), F.lit(0)))))


def intervals(entries: DataFrame) -> DataFrame:
    """``key, action, since, until`` (days, half open) of entries ``key, day, action``."""
    one = entries.where("key IS NOT NULL AND day IS NOT NULL AND action IS NOT NULL").groupBy("key", "day").agg(F.max("action").alias("action"))
    w = Window.partitionBy("key").orderBy("day")
    return one.select("key", "action", F.col("day").alias("since"), F.lead("day", 1, LAST_DAY).over(w).alias("until"))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day", bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """One row per capture (id, URL, day): ``n_captures, n_active, decided_by, action, kept``.

    Days are whole numbers.  An interval without an end is copied up to the last capture's bucket only.
    """
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(day_col).cast("long").alias("day"))
    rows = rows.groupBy("page_id", "url", "day").agg(F.count(F.lit(1)).alias("n_captures"))
    bounds = captures.agg(F.min(F.col(day_col).cast("long")).alias("lo"), F.max(F.col(day_col).cast("long")).alias("hi")).first()
    lo, hi = bounds["lo"] or 0, bounds["hi"] or 0

    parts = F.size(F.filter(F.split("key", "/"), lambda x: x != "")) - 1
    deepest = entries.where("key IS NOT NULL AND day IS NOT NULL AND action IS NOT NULL").agg(F.max(parts)).first()[0] or 0

    asked = rows.withColumn("k", F.explode_outer(keys(F.col("url"), deepest))).select("page_id", "url", "day", "n_captures", "k.key", "k.rank", F.floor(F.col("day") / bucket_days).alias("bucket"))
    lists = intervals(entries).where((F.col("since") <= hi) & (F.col("until") > lo))
    touched = F.sequence(F.floor(F.greatest("since", F.lit(lo)) / bucket_days), F.floor(F.least(F.col("until") - 1, F.lit(hi)) / bucket_days))
    lists = lists.withColumn("bucket", F.explode(touched))
    joined = asked.alias("a").join(lists.alias("b"), F.expr("a.key = b.key AND a.bucket = b.bucket AND a.day >= b.since AND a.day < b.until"), "left")
    best = F.max(F.when(F.col("b.action").isNotNull(), F.struct(F.col("a.rank").alias("rank"), F.col("a.key").alias("key"), F.col("b.action").alias("action"))))
    out = joined.groupBy("a.page_id", "a.url", "a.day", "a.n_captures").agg(F.count("b.action").alias("n_active"), best.alias("best"))
    return out.select("page_id", "url", "day", "n_captures", "n_active", F.col("best.key").alias("decided_by"), F.col("best.action").alias("action"), (~F.col("best.action").eqNullSafe("block")).alias("kept"))


def derived_entries(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Dated lists made from the pages' own hosts, for tables that bring none: by the digits of its MD5,
    every third host is blocked from a day on, every second of those is allowed again 90 days later, and
    every fifth host's first path part is blocked from another day on; hosts that sell pills are always blocked."""
    h = host(F.col(url_col))
    base = pages.select(h.alias("h"), F.get(F.filter(F.split(path(F.col(url_col)), "/"), lambda x: x != ""), F.lit(0)).alias("p")).where("h <> ''").distinct()
    number = lambda c, at: F.conv(F.substring(F.md5(c), at, 4), 16, 10).cast("long")
    hosts = base.select("h").distinct().withColumn("n", number(F.col("h"), 1)).withColumn("d", number(F.col("h"), 5) % 300)
    blocked = hosts.where("n % 3 = 0").select(F.col("h").alias("key"), F.col("d").alias("day"), F.lit("block").alias("action"))
    back = hosts.where("n % 6 = 0").select(F.col("h").alias("key"), (F.col("d") + 90).alias("day"), F.lit("allow").alias("action"))
    pills = hosts.where("h LIKE '%cheap-pills%'").select(F.col("h").alias("key"), F.lit(0).cast("long").alias("day"), F.lit("block").alias("action"))
    part = base.where("p IS NOT NULL").select(F.concat("h", F.lit("/"), "p").alias("key")).where(number(F.col("key"), 1) % 5 == 0)
    parts = part.select("key", (number(F.col("key"), 5) % 300).alias("day"), F.lit("block").alias("action"))
    return blocked.unionAll(back).unionAll(pills).unionAll(parts)


def capture_day(page_id: Column) -> Column:
    """A fetch day from 0 to 364, spread over the year by the id (the pages carry no fetch time)."""
    return F.pmod(page_id * 7919, F.lit(365))
