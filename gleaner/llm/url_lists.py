"""URL filter by a dated list: entries become validity intervals, and each capture is held against those active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import apart, materialize

#: A production list: domain, what happened, when. A domain covers its subdomains.
LIST = (
    ("cheap-pills.example.com", "add", "2023-02-01"),
    ("cheap-pills.example.com", "remove", "2023-09-01"),
    ("cheap-pills.example.com", "add", "2024-03-15"),
    ("spam-farm.example.org", "add", "2022-06-01"),
    ("spam-farm.example.org", "remove", "2024-08-01"),
    ("m.theres.example.net", "add", "2024-01-10"),
    ("example.net", "add", "2024-11-01"),
    ("example.net", "remove", "2024-11-08"),
)


def values(entries: tuple[tuple[str, str, str], ...]) -> str:
    """Entries as rows of SQL VALUES."""
    text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return ", ".join(f"({', '.join(map(text, e))})" for e in entries)


def host_of(url: Column) -> Column:
    """The lower-case host of an http or https URL without user, port and a last dot; null if there is none. Hosts stay as they are written: a
    name in its Unicode form and the same in its ASCII form (xn--) are two."""
    authority = F.regexp_extract(url, r"^[hH][tT][tT][pP][sS]?://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.nullif(F.lower(F.regexp_replace(host, r"\.$", "")), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and each domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """domain, valid_from, valid_to (null: still valid) from entries domain, action (add or remove), day.

    Null domains, days and actions are left out. Of several entries of a domain on a day, remove wins. An add while valid changes
    nothing, nor does a remove while not.
    """
    events = entries.where(F.col("domain").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    events = events.groupBy(F.lower("domain").alias("domain"), "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("domain").orderBy("day")
    events = events.withColumn("before", F.lag("action").over(order)).where("before is null and action = 'add' or before is not null and before <> action")
    events = events.withColumn("valid_to", F.lead("day").over(order))
    return events.where("action = 'add'").select("domain", F.col("day").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched, and any others) with host, listed, list_domain and listed_since.

    An interval holds from its first day until the day before its last. Of several domains the longest counts. A URL without a host, a
    null time or an empty list is not listed. Every capture is kept as it is, and rows that repeat stay; columns of those four names, in any case, are replaced. URLs of any length are taken whole; no captures give no rows. The list is
    matched with distinct hosts, so captures of a common host meet only in the last join, on one small row for each host.
    """
    own, back = apart(captures, ("url", "fetched"), ("host", "listed", "list_domain", "listed_since"))
    rows = own.withColumn("host", host_of(F.col("url")))
    names = rows.where("host is not null").select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
    spans = F.sort_array(F.collect_list(F.struct(F.length("domain").alias("n"), "domain", "valid_from", "valid_to")), asc=False)
    by_host = names.join(intervals(entries), "domain").groupBy("host").agg(spans.alias("__gleaner_spans"))
    by_host = materialize(by_host, "listed-hosts")  # read anew, so that Spark can split a common host's captures in the join
    active = lambda s: (s["valid_from"] <= F.col("fetched")) & (s["valid_to"].isNull() | (F.col("fetched") < s["valid_to"]))
    joined = rows.join(by_host, "host", "left").withColumn("__gleaner_hit", F.get(F.filter("__gleaner_spans", active), F.lit(0)))
    told = joined.withColumns({"listed": F.col("__gleaner_hit").isNotNull(), "list_domain": F.col("__gleaner_hit.domain"), "listed_since": F.col("__gleaner_hit.valid_from")})
    return back(told, "host", "listed", "list_domain", "listed_since")
