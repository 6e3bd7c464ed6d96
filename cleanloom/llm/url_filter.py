"""URL filters by a temporal list join.

Dated list entries (pattern, since, action) become validity intervals, each ending where the pattern's next
entry starts; an as-of join then evaluates every capture against the entries active at its fetch date.
A pattern is a host, which also covers its subdomains, or host/segment, which covers URLs of that very host
whose path starts with that segment. The most specific active entry decides: host/segment, then longer hosts.

Captures are first reduced to their distinct (host, segment, date), so a host that a third of all captures share meets
the list once a date and segment; intervals and dates meet by (pattern, month), so that no pattern's whole
history meets one task.

Actions: `block`, `allow`, and `remove`, which ends what was before it. Of entries of one pattern and date, block
goes before allow, allow before remove; entries with a null or a different action are as `remove`.

Defined results: entries without pattern or date are left out; a null URL, one without a host, a null date and a capture
that no active entry covers have a null action and aren't blocked; repeated rows get equal results; empty
tables are allowed; other columns aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)"


def host(url: Column) -> Column:
    """The lower-cased host, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def segment(url: Column) -> Column:
    """The first segment of the path, empty where there is none."""
    return F.coalesce(F.regexp_extract(url, SEGMENT, 1), F.lit(""))


def _month(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def intervals(entries: DataFrame, pattern_col: str = "pattern", since_col: str = "since", action_col: str = "action") -> DataFrame:
    """pattern, since, until (null: open), action of `block` or `allow`."""
    rank = F.when(F.col(action_col) == "block", 2).when(F.col(action_col) == "allow", 1).otherwise(0)
    one = entries.select(F.lower(F.col(pattern_col)).alias("pattern"), F.col(since_col).cast("date").alias("since"), rank.alias("__rank"))
    one = one.where("pattern IS NOT NULL AND since IS NOT NULL").groupBy("pattern", "since").agg(F.max("__rank").alias("__rank"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return one.withColumn("until", until).where("__rank > 0").select("pattern", "since", "until", F.when(F.col("__rank") == 2, "block").otherwise("allow").alias("action"))


def evaluated(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """A row for each capture: page_id, host, fetched, action, pattern, since, blocked."""
    mine = captures.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), segment(F.col(url_col)).alias("__segment"), F.col(fetched_col).cast("date").alias("fetched"))
    cases = mine.where("host IS NOT NULL AND fetched IS NOT NULL").select("host", "__segment", "fetched").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct((F.size(labels) - i + 1).alias("rank"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    exact = F.array(F.struct(F.lit(1 << 20).alias("rank"), F.concat_ws("/", "host", F.lower("__segment")).alias("pattern")))
    keys = cases.withColumn("__key", F.explode(F.concat(exact, hosts))).select("host", "__segment", "fetched", F.col("__key.rank").alias("__rank"), F.col("__key.pattern").alias("pattern"), _month(F.col("fetched")).alias("__month"))
    # Open intervals reach to the last fetch date.
    first, last = mine.agg(F.min("fetched"), F.max("fetched")).first()
    until = F.coalesce("until", F.date_add(F.lit(last).cast("date"), 1))
    spans = intervals(entries).where(F.col("since") <= F.lit(last).cast("date")).where(until > F.lit(first).cast("date"))
    begin = F.greatest("since", F.lit(first).cast("date"))
    spans = spans.withColumn("__month", F.explode(F.sequence(_month(begin), _month(F.least(until, F.lit(last).cast("date"))))))
    active = keys.join(spans, ["pattern", "__month"]).where("since <= fetched AND (until IS NULL OR fetched < until)")
    best = active.groupBy("host", "__segment", "fetched").agg(F.max(F.struct("__rank", "pattern", "since", "action")).alias("__best"))
    found = mine.join(best, ["host", "__segment", "fetched"], "left")
    return found.select("page_id", "host", "fetched", F.col("__best.action").alias("action"), F.col("__best.pattern").alias("pattern"), F.col("__best.since").alias("since"), F.coalesce(F.col("__best.action") == "block", F.lit(False)).alias("blocked"))
