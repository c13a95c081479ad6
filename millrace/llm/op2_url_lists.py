"""URL filters by a temporal list join.

A list's history is dated entries (list, key, action, at): ``add`` puts a key on the list, ``remove`` takes it off.
For each list and key they become validity intervals [from, to), which never overlap, and these become rows of at most
``CHUNK`` intervals in order of time, each with the time it is for.  A capture (url, fetched_at) has one key for its host
and one for each parent domain; an equi-join on the key brings, for each list, the row whose time it is, and a binary
search finds the last interval that begins by ``fetched_at``: an as-of join.  A capture so costs a few rows and a
logarithm, however long the history is.  Different captures of one host and time are evaluated once, and the result goes
back by (host, fetched_at), so captures of a very common host are spread by time; AQE splits a very common key.  The
interval table is broadcast only where it has at most ``BROADCAST`` intervals, counted.  DataFrame functions only.

Entries of one list and key at the same time: ``remove`` counts last.  Entries with nulls are ignored.  A null or
host-less URL or a null time is on no list (blocked false, lists empty).  A very long URL is read as any other; one whose
host has many labels has as many keys.  Repeated captures each give a row; other columns are ignored; empty tables give
no rows, or no blocked ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Intervals up to which their table is broadcast, and intervals of a row.
BROADCAST, CHUNK = 50_000, 1024


def intervals(entries: DataFrame) -> DataFrame:
    """key, list, spans (array of (from, to) in order, ``to`` null while the entry stands), low, high (the time that the
    row is for: from ``low``, before ``high`` unless that is null)."""
    rows = entries.select(F.col("list"), F.lower("key").alias("key"), F.lower("action").alias("action"), F.col("at").cast("timestamp").alias("at"))
    rows = rows.where("list is not null and key is not null and at is not null and action in ('add', 'remove')")
    rows = rows.groupBy("list", "key", "at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "key").orderBy("at")
    rows = rows.withColumn("change", F.coalesce(F.lag("action").over(order) != F.col("action"), F.col("action") == "add")).where("change")
    rows = rows.withColumn("to", F.lead("at").over(order)).where("action = 'add'")
    rows = rows.withColumn("chunk", F.floor((F.row_number().over(order) - 1) / CHUNK))
    rows = rows.groupBy("key", "list", "chunk").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("from"), "to"))).alias("spans"), F.min("at").alias("low"))
    return rows.withColumn("high", F.lead("low").over(Window.partitionBy("key", "list").orderBy("chunk"))).drop("chunk")


def last_begun(spans, at) -> F.Column:
    """The last of the spans (a column, in order) that begins by ``at``; null if none does.  Binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def step(s, _):
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        begun = F.get(spans, mid)["from"] <= at
        return F.when(s["lo"] >= s["hi"], s).when(begun, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))

    steps = F.expr(f"sequence(1, {CHUNK.bit_length() + 1})")
    return F.get(spans, F.aggregate(steps, start, step)["lo"] - 1)


def host(url) -> F.Column:
    """Lower-case host without user, port and final dot; null if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.$", ""), F.lit(""))


def host_keys(name) -> F.Column:
    """The host and its parent domains of two labels or more."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(parts, i, n), "."))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, host, fetched_at, n_lists, lists (sorted, by comma), listed_since and blocked of every capture."""
    spans = intervals(entries)
    few = (spans.agg(F.sum(F.size("spans"))).first()[0] or 0) <= BROADCAST
    rows = captures.select(F.col(id_col).alias("id"), F.col("fetched_at").cast("timestamp").alias("fetched_at"), host(F.col("url")).alias("host"))
    places = rows.where("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    keyed = places.withColumn("key", F.explode(host_keys(F.col("host"))))
    hit = keyed.join(F.broadcast(spans) if few else spans, "key").where((F.col("low") <= F.col("fetched_at")) & (F.col("high").isNull() | (F.col("fetched_at") < F.col("high"))))
    hit = hit.withColumn("span", last_begun(F.col("spans"), F.col("fetched_at"))).where(F.col("span.to").isNull() | (F.col("fetched_at") < F.col("span.to")))
    hit = hit.groupBy("host", "fetched_at").agg(F.sort_array(F.collect_set("list")).alias("lists"), F.min("span.from").alias("listed_since"))
    rows = rows.join(hit, ["host", "fetched_at"], "left")
    n = F.when(F.col("lists").isNull(), F.lit(0)).otherwise(F.size("lists")).cast("long")
    return rows.select(F.col("id").alias(id_col), "host", "fetched_at", n.alias("n_lists"), F.coalesce(F.array_join("lists", ","), F.lit("")).alias("lists"), "listed_since", F.col("lists").isNotNull().alias("blocked"))


#: A list history over the hosts and parent domains that occur in ``pages``, for want of a table of its own: by the md5 of
#: list and key, some keys are added on some day of 2023, and some of these are removed later and some added again.
HISTORY = r"""
WITH h AS (
  SELECT DISTINCT regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS host FROM pages WHERE url IS NOT NULL
), k AS (SELECT host AS key FROM h WHERE host <> ''),
l AS (SELECT key, list, md5(concat(list, '|', key)) AS m FROM (SELECT key, LISTED AS list FROM k) v),
n AS (SELECT key, list, m, ascii(substr(m, 1, 1)) * 7 + ascii(substr(m, 2, 1)) * 3 + ascii(substr(m, 3, 1)) AS a, ascii(substr(m, 4, 1)) * 2 + ascii(substr(m, 5, 1)) AS b FROM l)
"""


def derived_entries(pages: DataFrame) -> DataFrame:
    """The list history that the query uses."""
    spark = pages.sparkSession
    part = HISTORY.replace("FROM pages", "FROM {pages}").replace("LISTED", "explode(array('abuse', 'adult', 'spam'))")
    day = lambda n: f"timestampadd(DAY, {n}, timestamp '2023-01-01 00:00:00')"
    body = f"""{part}
SELECT list, key, 'add' AS action, {day('a % 365')} AS at FROM n WHERE substr(m, 6, 1) < '8'
UNION ALL SELECT list, key, 'remove', {day('a % 365 + 1 + b % 200')} FROM n WHERE substr(m, 6, 1) < '4'
UNION ALL SELECT list, key, 'add', {day('a % 365 + 201 + b % 90')} FROM n WHERE substr(m, 6, 1) < '2'"""
    return spark.sql(body, pages=pages)


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, fetched one a quarter of an hour from 2023 on (by page_id, over two years), against the history."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.expr("timestampadd(MINUTE, cast(15 * (page_id % 70080) as int), timestamp '2023-01-01 00:00:00')"))
    return evaluate(captures, derived_entries(pages))


ORACLE = HISTORY.replace("LISTED", "unnest(['abuse', 'adult', 'spam'])") + r""", e AS (
  SELECT list, key, 'add' AS action, TIMESTAMP '2023-01-01' + to_days(CAST(a % 365 AS INT)) AS at FROM n WHERE substr(m, 6, 1) < '8'
  UNION ALL SELECT list, key, 'remove', TIMESTAMP '2023-01-01' + to_days(CAST(a % 365 + 1 + b % 200 AS INT)) FROM n WHERE substr(m, 6, 1) < '4'
  UNION ALL SELECT list, key, 'add', TIMESTAMP '2023-01-01' + to_days(CAST(a % 365 + 201 + b % 90 AS INT)) FROM n WHERE substr(m, 6, 1) < '2'
), c AS (
  SELECT page_id, TIMESTAMP '2023-01-01' + to_minutes(CAST(15 * (page_id % 70080) AS INT)) AS fetched_at,
         nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') AS host FROM pages
), x AS (
  SELECT c.page_id, q.list, (SELECT max_by(e.action, e.at) FROM e WHERE e.list = q.list AND e.key = q.key AND e.at <= c.fetched_at) AS last,
         (SELECT max(e.at) FROM e WHERE e.list = q.list AND e.key = q.key AND e.at <= c.fetched_at) AS since
  FROM c JOIN (SELECT DISTINCT list, key FROM e) q ON q.key = c.host OR ends_with(c.host, '.' || q.key)
), g AS (SELECT page_id, count(DISTINCT list) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(since) AS since FROM x WHERE last = 'add' GROUP BY page_id)
SELECT c.page_id, c.host, c.fetched_at, coalesce(g.n, 0) AS n_lists, coalesce(g.lists, '') AS lists, g.since AS listed_since, g.n IS NOT NULL AS blocked
FROM c LEFT JOIN g ON g.page_id = c.page_id
"""
