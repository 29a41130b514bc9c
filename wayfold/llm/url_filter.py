"""URL filter: an as-of join of captures with a dated domain list.

Entries of one domain become validity intervals, each ending where the next
begins.  A capture is decided by the entry, active when it was fetched, of its
host's longest listed suffix.  Decisions are made once for each distinct host
and time and joined back, so a host with very many captures costs no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: List entries up to which the intervals are broadcast (under 100 MB); beyond, both sides are shuffled.
BROADCAST_ENTRIES = 500_000


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, since, until) from dated entries (domain, action, since).

    until is when the domain's next entry begins, null for its last.  Entries
    without domain or date are no entries; of several at one date 'block' beats
    every other action, then the alphabetically last stands.
    """
    dated = entries.select(F.lower("domain").alias("domain"), "action", "since").where("domain is not null and since is not null")
    once = dated.groupBy("domain", "since").agg(F.max(F.struct((F.col("action") == "block").alias("first"), "action"))["action"].alias("action"))
    following = F.lead("since").over(Window.partitionBy("domain").orderBy("since"))
    return once.select("domain", "action", "since", following.alias("until"))


def filter_urls(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """The captures' columns with host, action, domain and since of the deciding entry.

    Without an active entry, a host or a time the action is 'allow' and domain
    and since are null.  Repeated captures are decided each for itself; input
    columns named like new ones give way.
    """
    valid = intervals(entries)
    valid = F.broadcast(valid) if entries.count() <= BROADCAST_ENTRIES else valid
    new = {"host", "action", "domain", "since"}
    kept = [F.col(f"`{c}`") for c in captures.columns if c.lower() not in new]
    hosted = captures.select(F.struct(*kept).alias("kept"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{time_col}`").alias("time"))
    times = hosted.select("host", F.col("time").alias("at")).where("host is not null and at is not null").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    active = times.select("host", "at", F.explode(suffix).alias("suffix")).join(
        valid, (F.col("suffix") == F.col("domain")) & (F.col("since") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    decided = active.groupBy("host", "at").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "action", "since")).alias("entry"))
    decided = decided.select(F.col("host").alias("its_host"), F.col("at"), "entry")
    joined = hosted.join(decided, (F.col("host") == F.col("its_host")) & (F.col("time") == F.col("at")), "left")
    return joined.select("kept.*", "host", F.coalesce("entry.action", F.lit("allow")).alias("action"), F.col("entry.domain").alias("domain"), F.col("entry.since").alias("since"))
