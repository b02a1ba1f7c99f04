"""URL filters: dated list entries as validity intervals, joined as of the time of each fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, without user, port or trailing dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, since, until): when each pattern stood on each list; until is exclusive, null while it still does.

    entries: list_name, pattern, at, action ('add' or 'remove'). An addition holds
    until the next dated entry of its list and pattern. Of entries of one moment
    'remove' counts last. Repeated entries are one; entries without a list,
    pattern, date or known action have no effect.
    """
    dated = entries.select("list_name", F.lower("pattern").alias("pattern"), "at", "action").filter("list_name is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    last = dated.groupBy("list_name", "pattern", "at").agg(F.max("action").alias("action"))
    later = F.lead("at").over(Window.partitionBy("list_name", "pattern").orderBy("at"))
    return last.withColumn("until", later).filter("action = 'add'").select("list_name", "pattern", F.col("at").alias("since"), "until")


def url_filter(captures: DataFrame, entries: DataFrame, bucket_days: int = 30) -> DataFrame:
    """The captures (columns url and fetched_at, and any others), with host, lists and blocked added.

    A capture is on a list when an entry of its host, or of a domain above it, was
    active when it was fetched. `lists` has those lists, sorted; `blocked` says
    whether there are any. Both sides are joined on the domain and on buckets of
    bucket_days, so that a pattern with many entries or captures is spread over
    time; the bounds of the interval are then compared. Each host and moment is
    looked up once, whatever the number of its captures; a host with a third of
    all captures is a skewed side of plain joins, which adaptive execution splits.

    A url without a host, or a null time, is on no list. Urls of any length are read
    whole; a host is looked up once for each of its labels. Repeated captures get a
    row each; empty tables on either side are fine. Columns of the captures that
    are named host, lists or blocked are replaced.
    """
    width = bucket_days * 86400
    bucket = lambda t: F.floor(F.unix_timestamp(t) / width)
    others = [c for c in captures.columns if c.lower() not in ("host", "lists", "blocked")]
    found = captures.select(*[F.col(f"`{c}`") for c in others], host_of(F.col("url")).alias("host"))
    asked = found.filter("host is not null and fetched_at is not null").select("host", "fetched_at").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = asked.select("host", "fetched_at", F.explode(above).alias("pattern"), bucket(F.col("fetched_at")).alias("bucket"))
    newest = F.lit(captures.agg(F.max("fetched_at")).first()[0]).cast("timestamp")  # bounds the intervals that are still open
    spans = intervals(entries).filter(F.col("since") <= newest)
    end = F.least(F.coalesce("until", newest), newest)
    spans = spans.select("list_name", "pattern", "since", "until", F.explode(F.sequence(bucket(F.col("since")), bucket(end))).alias("bucket"))
    met = probes.join(spans, ["pattern", "bucket"]).filter("since <= fetched_at and (until is null or fetched_at < until)")
    lists = met.groupBy("host", "fetched_at").agg(F.array_sort(F.collect_set("list_name")).alias("lists"))
    out = found.join(lists, ["host", "fetched_at"], "left")
    none = F.expr("cast(array() as array<string>)")
    return out.select(*[F.col(f"`{c}`") for c in others], "host", F.coalesce("lists", none).alias("lists"), F.col("lists").isNotNull().alias("blocked"))
