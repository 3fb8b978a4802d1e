"""Temporal URL-list join, in DataFrame operations only.

Dated list entries (a domain is added to or removed from a list) become validity intervals: an event holds from its
day until the next event of the same list and domain, and an add is an active interval.  A capture is judged by
the entries that were active on its day for its host or any parent domain; the most specific domain decides (ties:
list name).

Captures are reduced to distinct (host, day) before anything is joined, so a host with a third of all captures is
one row a day; the interval table is broadcast only if counted small, and Spark can split the join otherwise.

The host is what follows the last ``@`` of the authority, lower-cased, without port and closing dots; an IPv6 address
keeps its brackets, and addresses have no parent domains.

Defined results: a null or unusable URL has a null host and no active entry; a null day likewise; of events of one
list, domain and day the last by ``seq`` (then ``remove``) holds; repeated captures are each judged; list entries
with a null domain, day or action are ignored; other columns stay as they are, but those named like one of the seven new ones are replaced; empty lists block nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import small


#: The host of a URL, and an address in four numbers.
HOST, ADDRESS = r"^[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}(?:[^/\\?#]*@)?(\[[0-9A-Za-z:.%]*\]|[^/\\:?#@\[\]]*)", r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"


def host_of(url: Column) -> Column:
    found = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")
    return F.when(found != "", found)


def parents(host: Column) -> Column:
    """The host and its parent domains of two labels at least."""
    labels = F.split(host, r"\.")
    return F.when((F.size(labels) < 2) | host.startswith("[") | host.rlike(ADDRESS), F.array(host)).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def intervals(events: DataFrame) -> DataFrame:
    """list, domain, since, until (null: open) of the active intervals of events (list, domain, day, action, seq)."""
    usable = events.where("domain IS NOT NULL AND day IS NOT NULL AND action IS NOT NULL AND list IS NOT NULL")
    daily = usable.groupBy("list", "domain", "day").agg(F.max(F.struct(F.coalesce("seq", F.lit(0)), "action")).alias("last"))
    order = Window.partitionBy("list", "domain").orderBy("day")
    return daily.select("list", "domain", F.col("day").alias("since"), F.lead("day").over(order).alias("until"),
                        F.col("last.action").alias("action")).where("action = 'add'").drop("action")


NEW = ("host", "n_active", "matched_list", "matched_domain", "listed_since", "blocked")


def judge(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures (url, day and any others) with host, n_active, matched_list, matched_domain, listed_since, blocked."""
    at = {c: f"c{i}" for i, c in enumerate(captures.columns) if c not in NEW}  # columns by number: no name clashes
    rows = captures.select(*[F.col(f"`{c}`").alias(x) for c, x in at.items()]).withColumn("host", host_of(F.col(at["url"]))).withColumn("day", F.col(at["day"]))
    asked = rows.where("host IS NOT NULL AND day IS NOT NULL").select("host", "day").distinct()
    entries = intervals(events)
    hits = asked.withColumn("domain", F.explode(parents(F.col("host")))).join(small(entries), "domain").where(
        "since <= day AND (until IS NULL OR day < until)")
    best = F.min(F.struct((-F.length("domain")).alias("rank"), "list", "domain", "since"))
    verdict = hits.groupBy("host", "day").agg(F.count("*").alias("n_active"), best.alias("b")).select(
        "host", "day", "n_active", F.col("b.list").alias("matched_list"), F.col("b.domain").alias("matched_domain"),
        F.col("b.since").alias("listed_since"))
    return rows.join(verdict, ["host", "day"], "left").select(
        *[F.col(x).alias(c) for c, x in at.items()], "host", F.coalesce("n_active", F.lit(0)).alias("n_active"), "matched_list", "matched_domain",
        "listed_since", F.col("matched_domain").isNotNull().alias("blocked"))


# The query: the table pages has neither fetch days nor lists, so both are derived from it by rule.


def captures_of(pages: DataFrame) -> DataFrame:
    """page_id, url, and a fetch day in 2024 that follows from the id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("day"))


def events_of(pages: DataFrame) -> DataFrame:
    """Two lists over all hosts and their parents; digits of the domain's MD5 say when it was added and removed."""
    domains = pages.select(F.explode(parents(host_of(F.col("url")))).alias("domain")).distinct().withColumn("h", F.md5("domain"))
    digit = lambda a: F.conv(F.substring("h", a, 2), 16, 10).cast("int")
    add, gone = digit(1), digit(1) + 1 + digit(3)
    back = gone + 1 + digit(5)
    event = lambda name, after, action, seq: F.struct(F.lit(name).alias("list"), after.alias("after"), F.lit(action).alias("action"), F.lit(seq).alias("seq"))
    told = F.array(event("abuse", add, "add", 1), event("abuse", gone, "remove", 2), event("abuse", back, "add", 3), event("adult", back, "add", 1), event("adult", back + digit(7), "remove", 2))
    return domains.where(digit(9) < 160).select("domain", F.explode(told).alias("e")).select(
        "e.list", "domain", F.date_add(F.lit("2024-01-01").cast("date"), F.col("e.after")).alias("day"), "e.action", "e.seq")


SQL = r"""
WITH p AS (
  SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*:[/\\]{2}(?:[^/\\?#]*@)?(\[[0-9A-Za-z:.%]*\]|[^/\\:?#@\[\]]*)', 1)), '.'), '') AS host,
         DATE '2024-01-01' + CAST(((page_id * 37) % 366 + 366) % 366 AS INTEGER) AS day
  FROM pages
), q AS (
  SELECT *, string_split(host, '.') AS l FROM p
), r AS (
  SELECT *, CASE WHEN host IS NULL THEN []
         WHEN len(l) < 2 OR starts_with(host, '[') OR regexp_matches(host, '^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$') THEN [host] ELSE list_transform(range(1, len(l)), lambda i: array_to_string(l[i:], '.')) END AS ds FROM q
), d AS (
  SELECT DISTINCT unnest(ds) AS domain FROM r
), n AS (
  SELECT domain, CAST('0x' || substr(md5(domain), 1, 2) AS INTEGER) AS a, CAST('0x' || substr(md5(domain), 3, 2) AS INTEGER) AS b,
         CAST('0x' || substr(md5(domain), 5, 2) AS INTEGER) AS c, CAST('0x' || substr(md5(domain), 7, 2) AS INTEGER) AS e,
         CAST('0x' || substr(md5(domain), 9, 2) AS INTEGER) AS g
  FROM d
), v AS (
  SELECT 'abuse' AS list, domain, a AS after, 'add' AS action, 1 AS seq FROM n WHERE g < 160
  UNION ALL SELECT 'abuse', domain, a + 1 + b, 'remove', 2 FROM n WHERE g < 160
  UNION ALL SELECT 'abuse', domain, a + 1 + b + 1 + c, 'add', 3 FROM n WHERE g < 160
  UNION ALL SELECT 'adult', domain, a + 1 + b + 1 + c, 'add', 1 FROM n WHERE g < 160
  UNION ALL SELECT 'adult', domain, a + 1 + b + 1 + c + e, 'remove', 2 FROM n WHERE g < 160
), w AS (
  SELECT list, domain, DATE '2024-01-01' + after AS day, arg_max(action, seq) AS action FROM v GROUP BY ALL
), i AS (
  SELECT * FROM (SELECT list, domain, day AS since, lead(day) OVER (PARTITION BY list, domain ORDER BY day) AS until, action FROM w) WHERE action = 'add'
), hit AS (
  SELECT x.page_id, x.url, i.*, row_number() OVER (PARTITION BY x.page_id ORDER BY length(i.domain) DESC, i.list, i.domain, i.since) AS rn,
         count(*) OVER (PARTITION BY x.page_id) AS n_active
  FROM (SELECT page_id, url, day, unnest(ds) AS domain FROM r) x JOIN i ON x.domain = i.domain AND i.since <= x.day AND (i.until IS NULL OR x.day < i.until)
)
SELECT r.page_id, r.host, r.day, coalesce(hit.n_active, 0) AS n_active, hit.list AS matched_list, hit.domain AS matched_domain,
       hit.since AS listed_since, hit.domain IS NOT NULL AS blocked
FROM r LEFT JOIN hit ON r.page_id = hit.page_id AND hit.rn = 1
"""
