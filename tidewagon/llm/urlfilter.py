"""URL filters (5): a temporal list join.

Dated list entries (``add`` or ``remove`` of a pattern) become validity intervals. Each capture is
evaluated by an as-of join against the entries active on the day of its fetch. A pattern is a domain, which covers its
subdomains, or a host with the first segment of the path. Hosts are compared in lower case, segments as they are written.

All of it is DataFrame work. Captures are first reduced to their distinct (host, segment, day), so a host with
most of the captures is a few rows per day in the join; a capture's verdict depends on nothing else.

Cases: a capture without url or without fetch day matches nothing. Of several entries for one pattern on one day a
``remove`` wins. Columns of the captures that are named as those of the result (``RESULT``) come back with ``capture_`` before
their name. An entry without list, pattern, action or day is left out. A repeated entry changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RESULT = ("blocked", "lists", "matches", "pattern")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))


def segment_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SEGMENT, 1), F.lit(""))


def listed(pattern: Column) -> Column:
    """A pattern as captures have it: the host in lower case, a segment as it is written."""
    host = F.regexp_extract(pattern, r"^[^/]*", 0)
    return F.concat(F.lower(host), F.substring(pattern, F.length(host) + 1, F.length(pattern)))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to): when a pattern is on a list; ``valid_to`` is exclusive, null is open."""
    daily = (entries.where(F.col("action").isin("add", "remove"))
             .where("list is not null and pattern is not null and day is not null")
             .groupBy("list", listed(F.col("pattern")).alias("pattern"), "day")
             .agg(F.min(F.col("action") == "add").alias("active")))
    history = Window.partitionBy("list", "pattern").orderBy("day")
    # Only changes count, so every interval is as long as it can be and no two of a pattern touch.
    changes = (daily.withColumn("was", F.coalesce(F.lag("active").over(history), F.lit(False)))
               .where("active <> was"))
    return (changes.withColumn("valid_to", F.lead("day").over(history)).where("active")
            .select("list", "pattern", F.col("day").alias("valid_from"), "valid_to"))


def patterns_of(host: Column, segment: Column) -> Column:
    """Every pattern that can match: the host, its parent domains of two labels or more, host and segment."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)),
                          lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(segment == "", domains).otherwise(
        F.concat(domains, F.array(F.concat_ws("/", host, segment))))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Each capture with ``blocked``, ``lists`` (names, in order), ``matches`` and ``pattern`` (the longest match)."""
    named = captures.select(F.struct("*").alias("_capture"), host_of(F.col("url")).alias("_host"),
                            segment_of(F.col("url")).alias("_segment"), F.col("fetched").alias("_day"))
    asked = named.where("_host is not null and _day is not null").select("_host", "_segment", "_day").distinct()
    keyed = asked.withColumn("pattern", F.explode(patterns_of(F.col("_host"), F.col("_segment"))))
    valid = intervals(entries)
    active = keyed.join(valid, (keyed["pattern"] == valid["pattern"]) & (keyed["_day"] >= valid["valid_from"])
                        & (valid["valid_to"].isNull() | (keyed["_day"] < valid["valid_to"]))).drop(valid["pattern"])
    verdict = active.groupBy("_host", "_segment", "_day").agg(
        F.array_sort(F.collect_set("list")).alias("lists"), F.count("*").alias("matches"),
        F.max(F.struct(F.length("pattern").alias("n"), F.col("pattern").alias("p")))["p"].alias("pattern"))
    joined = named.join(verdict, ["_host", "_segment", "_day"], "left")
    return joined.select(
        *[F.col("_capture").getField(c).alias(f"capture_{c}" if c in RESULT else c) for c in captures.columns],
        F.col("matches").isNotNull().alias("blocked"),
        F.coalesce(F.array_join("lists", ","), F.lit("")).alias("lists"),
        F.coalesce("matches", F.lit(0)).alias("matches"), "pattern")


# --- dated lists and fetch days, derived from the pages themselves -----------------------------------------


def _number(text: Column) -> Column:
    """A number from 0 to 2^32 - 1 by the md5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


FIRST_DAY = "2024-01-01"


def derived_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day of one year."""
    return pages.select("page_id", "url", F.date_add(
        F.to_date(F.lit(FIRST_DAY)), (_number(F.concat(F.lit("fetch-"), F.col("page_id").cast("string"))) % 365).cast("int")
    ).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries about every third host, its parent domain or one of its paths: added, removed, added again."""
    seen = pages.select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("segment")).where(
        "host is not null").distinct()
    n = _number(F.concat_ws("/", "host", "segment"))
    parent = F.substring_index("host", ".", -3)
    # Some paths are listed with their host, some with their segment in capitals; the latter are other paths.
    path = F.concat_ws("/", F.when(F.col("n") % 4 == 0, F.upper("host")).otherwise(F.col("host")),
                       F.when(F.col("n") % 4 == 1, F.upper("segment")).otherwise(F.col("segment")))
    chosen = seen.withColumn("n", n).where("n % 3 = 0").select(
        F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), ((F.col("n") / 3).cast("long") % 3 + 1).cast("int")).alias("list"),
        F.when(F.col("n") % 5 == 0, parent).when(F.col("n") % 5 == 1, path)
        .otherwise(F.col("host")).alias("pattern"), "n")
    day = lambda offset: F.date_add(F.to_date(F.lit(FIRST_DAY)), offset.cast("int"))
    start = F.col("n") % 200
    steps = F.array(
        F.struct(F.lit("add").alias("action"), day(start).alias("day")),
        F.struct(F.lit("remove").alias("action"), day(start + 30 + F.col("n") % 90).alias("day")),
        F.struct(F.lit("add").alias("action"), day(start + 150 + F.col("n") % 60).alias("day")))
    return chosen.select("list", "pattern", F.explode(F.slice(steps, F.lit(1), (F.lit(1) + F.col("n") % 7 % 3).cast("int"))).alias("s")).select(
        "list", "pattern", "s.action", "s.day")


ORACLE_SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
         coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS segment,
         DATE '2024-01-01' + CAST(CAST('0x' || substr(md5('fetch-' || CAST(page_id AS VARCHAR)), 1, 8) AS BIGINT) % 365 AS INTEGER) AS fetched
  FROM pages),
seen AS (
  SELECT DISTINCT host, segment, CAST('0x' || substr(md5(concat_ws('/', host, segment)), 1, 8) AS BIGINT) AS n
  FROM parsed WHERE host IS NOT NULL),
chosen AS (
  SELECT (['adult', 'malware', 'spam'])[CAST((n // 3) % 3 + 1 AS INTEGER)] AS list, n,
         CASE n % 5 WHEN 0 THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')
                    WHEN 1 THEN concat_ws('/', CASE WHEN n % 4 = 0 THEN upper(host) ELSE host END,
                                          CASE WHEN n % 4 = 1 THEN upper(segment) ELSE segment END) ELSE host END AS raw,
         lower(regexp_extract(raw, '^[^/]*')) || substr(raw, length(regexp_extract(raw, '^[^/]*')) + 1) AS pattern
  FROM seen WHERE n % 3 = 0),
entries AS (
  SELECT list, pattern, 'add' AS action, DATE '2024-01-01' + CAST(n % 200 AS INTEGER) AS day FROM chosen
  UNION ALL
  SELECT list, pattern, 'remove', DATE '2024-01-01' + CAST(n % 200 + 30 + n % 90 AS INTEGER) FROM chosen WHERE n % 7 % 3 >= 1
  UNION ALL
  SELECT list, pattern, 'add', DATE '2024-01-01' + CAST(n % 200 + 150 + n % 60 AS INTEGER) FROM chosen WHERE n % 7 % 3 >= 2),
daily AS (SELECT list, pattern, day, bool_and(action = 'add') AS active FROM entries GROUP BY ALL),
changes AS (
  SELECT * FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY list, pattern ORDER BY day), FALSE) AS was FROM daily)
  WHERE active <> was),
spans AS (
  SELECT * FROM (SELECT list, pattern, active, day AS valid_from,
                        lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS valid_to FROM changes) WHERE active),
found AS (
  SELECT page_id, list, pattern FROM parsed JOIN spans ON fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to)
    AND (pattern = concat_ws('/', host, segment) AND segment <> ''
         OR (host = pattern OR ends_with(host, '.' || pattern)) AND (contains(pattern, '.') OR host = pattern) AND NOT contains(pattern, '/')))
SELECT page_id, url, fetched, max(pattern IS NOT NULL) AS blocked,
       coalesce(array_to_string(list_sort(list(DISTINCT list) FILTER (list IS NOT NULL)), ','), '') AS lists,
       count(pattern) AS matches, max_by(pattern, (length(pattern), pattern)) AS pattern
FROM parsed LEFT JOIN found USING (page_id) GROUP BY page_id, url, fetched
"""
