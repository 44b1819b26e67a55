"""URL lists as of each capture's fetch time (operator 9).

Native DataFrame operations only.

Dated list entries (``add`` or ``remove`` of a value) become validity intervals by one
window per list and value.  A capture has a key for its host, each parent domain and
each leading part of its path; an interval matches a capture of equal key that was fetched
in it.  The as-of join is an equi-join: the time between the first and last capture is cut into
at most ``buckets`` buckets, an interval has a row in each bucket it touches, and
the bucket is part of the key.  So a host with a third of all captures is dealt over the
buckets, and every capture meets only intervals of its own time.  Where one bucket of a value still has more
than ``hot_rows`` captures (and more than a 100,000th of all keys, so there are fewer than 100,000 such places, which are
broadcast), as after a bulk crawl or with one odd date that makes the buckets wide, its captures are dealt over
parts by their hash, and its intervals have a row in each part.

Kinds of values: ``host`` (this host), ``domain`` (this host and all below it) and ``path``
(host and leading path segments, as many as it has: captures get keys of the lengths that occur
among the entries, which the driver collects).  An entry holds from its date on; of entries of one
value and time, ``remove`` counts.  Repeated entries change nothing.  A null or odd URL, or a
null time, matches nothing.  Captures that repeat an id are rows of their own.  Entries with a null are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm._store import Workspace

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.rtrim(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1), F.lit(".")))


def path_lengths(entries: DataFrame) -> list[int]:
    """The distinct counts of path segments among the entries."""
    lengths = entries.filter("kind = 'path'").select((F.size(F.split("value", "/")) - 1).alias("n")).filter("n > 0").distinct()
    return sorted(r.n for r in lengths.collect())


def url_keys(url: Column, lengths: list[int]) -> Column:
    """``array<struct<kind, value>>``: all values that would list ``url``, its path cut at ``lengths``."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1), "/"), lambda p: p != "")

    def key(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: key("domain", F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.size(parts))
    paths = F.transform(cuts, lambda n: key("path", F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, n), "/"))))
    return F.when(host != "", F.concat(F.array(key("host", host)), domains, paths)).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))


def validity(entries: DataFrame) -> DataFrame:
    """``entries(list, kind, value, action, dated)`` to ``list, kind, value, valid_from, valid_to`` (null: open)."""
    known = entries.filter("list is not null and kind is not null and value is not null and dated is not null and action in ('add', 'remove')")
    at = known.groupBy("list", "kind", "value", "dated").agg(F.max("action").alias("action"))  # 'remove' is the greater
    over = Window.partitionBy("list", "kind", "value").orderBy("dated")
    changes = at.withColumn("before", F.lag("action").over(over)).filter("before is null and action = 'add' or before <> action")
    return (
        changes.withColumn("valid_to", F.lead("dated").over(over))
        .filter("action = 'add'")
        .select("list", "kind", "value", F.col("dated").alias("valid_from"), "valid_to")
    )


def listed(captures: DataFrame, entries: DataFrame, buckets: int = 64, hot_rows: int = 50_000) -> DataFrame:
    """``capture_id, url, fetched_at, blocked, n_lists, n_matches, lists`` for every capture."""
    span = captures.agg(F.min("fetched_at").alias("lo"), F.max("fetched_at").alias("hi")).first()
    base = captures.select("capture_id", "url", "fetched_at")
    if span["lo"] is None:
        return base.select("*", F.lit(False).alias("blocked"), F.lit(0).cast("long").alias("n_lists"), F.lit(0).cast("long").alias("n_matches"), F.lit("").alias("lists"))
    lo, hi = F.lit(span["lo"]), F.lit(span["hi"])
    width = F.greatest(F.lit(1.0), (F.unix_timestamp(hi) - F.unix_timestamp(lo) + 1) / buckets)

    def bucket(t: Column) -> Column:
        return F.floor((F.unix_timestamp(t) - F.unix_timestamp(lo)) / width).cast("int")

    spans = (
        validity(entries)
        .filter((F.col("valid_from") <= hi) & (F.col("valid_to").isNull() | (F.col("valid_to") > lo)))
        .withColumn("bucket", F.explode(F.sequence(bucket(F.greatest("valid_from", lo)), bucket(F.least(F.coalesce("valid_to", hi), hi)))))
    )
    keys = base.select("capture_id", "url", "fetched_at", F.explode(url_keys(F.col("url"), path_lengths(entries))).alias("k"), bucket(F.col("fetched_at")).alias("bucket"))
    keys = keys.select("capture_id", "url", "fetched_at", "k.kind", "k.value", "bucket")
    work = Workspace(captures.sparkSession, "urls")
    counts = work.settle(keys.groupBy("kind", "value", "bucket").agg(F.count("*").alias("n")), "counts")
    limit = max(hot_rows, (counts.agg(F.sum("n")).first()[0] or 0) // 100_000)
    hot = F.broadcast(counts.filter(F.col("n") > limit).select("kind", "value", "bucket", F.ceil(F.col("n") / limit).cast("int").alias("parts")))
    place = ["kind", "value", "bucket"]
    keys = keys.join(hot, place, "left").withColumn("part", F.pmod(F.xxhash64("capture_id", "url", "fetched_at"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    spans = spans.join(hot, place, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    hits = keys.join(spans, [*place, "part"]).filter("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    found = hits.groupBy("capture_id", "url", "fetched_at").agg(F.collect_set("list").alias("lists"), F.countDistinct("list", "kind", "value").alias("n_matches"))
    joined = base.join(found, ["capture_id", "url", "fetched_at"], "left")
    return joined.select(
        "capture_id",
        "url",
        "fetched_at",
        F.col("lists").isNotNull().alias("blocked"),
        F.coalesce(F.size("lists"), F.lit(0)).cast("long").alias("n_lists"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(F.array_sort("lists"), ","), F.lit("")).alias("lists"),
    )


def sample_captures(pages: DataFrame) -> DataFrame:
    """The captures of ``pages``: fetched on a day of 2024 that follows from the id."""
    day = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 4), 16, 10).cast("int") % 366
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.timestamp_add("DAY", day, F.lit("2024-01-01").cast("timestamp")).alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of ``pages``, by a rule on the host's digest."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int"))

    def entry(condition: str, name: str, kind: str, value: Column, action: str, day: str) -> DataFrame:
        dated = F.timestamp_add("DAY", F.expr(day), F.lit("2024-01-01").cast("timestamp"))
        return hosts.filter(condition).select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"), dated.alias("dated"))

    host, parent = F.col("host"), F.expr("substring(host, instr(host, '.') + 1)")
    out = entry("h % 3 < 2", "malware", "host", host, "add", "h % 300")
    for part in (
        entry("h % 3 < 2 and h % 2 = 0", "malware", "host", host, "remove", "h % 300 + 20 + h % 60"),
        entry("h % 3 < 2 and h % 10 = 0", "malware", "host", host, "add", "h % 300 + 90 + h % 60"),
        entry("h % 7 = 0 and host like '%.%.%.%'", "spam", "domain", parent, "add", "h % 200"),
        entry("h % 14 = 0 and host like '%.%.%.%'", "spam", "domain", parent, "remove", "h % 200 + 45"),
        entry("h % 4 = 1", "adult", "path", F.concat(host, F.lit("/en")), "add", "h % 250"),
    ):
        out = out.unionByName(part)
    return out


SQL = r"""
WITH c AS (
  SELECT page_id AS capture_id, url, TIMESTAMP '2024-01-01' + to_days(CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 4) AS INTEGER) % 366) AS fetched_at,
         rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts
  FROM pages
), hosts AS (
  SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS h, substr(host, instr(host, '.') + 1) AS parent FROM c WHERE host <> ''
), e AS (
  SELECT 'malware' AS list, 'host' AS kind, host AS value, 'add' AS action, h % 300 AS d FROM hosts WHERE h % 3 < 2
  UNION ALL SELECT 'malware', 'host', host, 'remove', h % 300 + 20 + h % 60 FROM hosts WHERE h % 3 < 2 AND h % 2 = 0
  UNION ALL SELECT 'malware', 'host', host, 'add', h % 300 + 90 + h % 60 FROM hosts WHERE h % 3 < 2 AND h % 10 = 0
  UNION ALL SELECT 'spam', 'domain', parent, 'add', h % 200 FROM hosts WHERE h % 7 = 0 AND host LIKE '%.%.%.%'
  UNION ALL SELECT 'spam', 'domain', parent, 'remove', h % 200 + 45 FROM hosts WHERE h % 14 = 0 AND host LIKE '%.%.%.%'
  UNION ALL SELECT 'adult', 'path', host || '/en', 'add', h % 250 FROM hosts WHERE h % 4 = 1
), states AS (
  SELECT list, kind, value, d, max(action) AS action FROM e GROUP BY ALL
), active AS (
  SELECT s.list, s.kind, s.value, c.capture_id, arg_max(s.action, s.d) AS action
  FROM c JOIN states s ON s.d <= date_diff('day', TIMESTAMP '2024-01-01', c.fetched_at)
    AND CASE s.kind WHEN 'host' THEN c.host = s.value WHEN 'domain' THEN c.host = s.value OR ends_with(c.host, '.' || s.value)
             ELSE c.host <> '' AND (s.value = c.host || '/' || array_to_string(c.parts[1:1], '/') OR s.value = c.host || '/' || array_to_string(c.parts[1:2], '/')
                                     OR s.value = c.host || '/' || array_to_string(c.parts[1:3], '/')) AND len(c.parts) > 0 END
  GROUP BY ALL
), m AS (
  SELECT capture_id, count(DISTINCT list) AS n_lists, count(*) AS n_matches, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM active WHERE action = 'add' GROUP BY capture_id
)
SELECT c.capture_id, c.url, c.fetched_at, m.capture_id IS NOT NULL AS blocked, coalesce(n_lists, 0) AS n_lists, coalesce(n_matches, 0) AS n_matches, coalesce(lists, '') AS lists
FROM c LEFT JOIN m USING (capture_id)
"""
