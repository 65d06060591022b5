"""URL filters by a temporal join with dated lists.

A list entry says that a host name (or any parent domain) was added to or
removed from a list on a day. Per list and key the entries become validity
intervals: an ``add`` holds from its day until the next entry of that list and
key. Every capture is then judged against the entries that were active when it
was fetched, not against today's list: an as-of join on the key and the fetch
day. Built of DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_join, written

FAR_DAY = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def parent_domains(host: Column) -> Column:
    """The host and its parent domains of at least two labels; a bare label is its own only one."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(parts, i, n), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``list, key, active_from, active_to`` (half-open) of entries ``list, key, action, day``.

    Entries of one list, key and day: a removal wins. Repeated additions only
    extend the interval's chain; a removal without an addition has no effect.
    Entries with a null in any of the four columns, or another action, say
    nothing and are left out.
    """
    known = entries.where(F.col("action").isin("add", "remove")).dropna(subset=["list", "key", "action", "day"])
    known = known.groupBy("list", F.lower("key").alias("key"), "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("list", "key").orderBy("day"))
    return known.withColumn("_next", following).where("action = 'add'").select("list", "key", F.col("day").alias("active_from"), F.coalesce("_next", F.lit(FAR_DAY).cast("date")).alias("active_to"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "fetch_day") -> DataFrame:
    """One row for each capture: ``page_id, host, fetch_day, blocked, n_active, lists, matched``.

    ``n_active`` counts the (list, key) pairs active for the host on the fetch
    day, ``lists`` names their lists in order, joined by commas ('' if none),
    ``matched`` is the longest matching key (of equally long the greatest,
    null if none).

    Each (host, day) is judged once, however many captures it has; the verdict
    goes back by a join of plain tables, so a host with a third of all captures is no
    single task. A null or malformed URL has host '' and matches nothing, and
    so does a null fetch day. Repeated captures each get their row; an empty
    table on either side is fine. Other columns are not looked at.
    """
    rows = captures.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(day_col).cast("date").alias("fetch_day"))
    pairs = rows.where("host <> '' and fetch_day is not null").select("host", "fetch_day").distinct()
    keys = pairs.select("host", "fetch_day", F.explode(parent_domains(F.col("host"))).alias("key"))
    # two plain tables: a parent domain of very many hosts is dealt to several tasks
    keys, active = written(keys, "url-keys"), written(intervals(entries), "url-intervals")
    hits = keys.join(active, (keys["key"] == active["key"]) & (keys["fetch_day"] >= active["active_from"]) & (keys["fetch_day"] < active["active_to"]))
    verdicts = hits.groupBy("host", "fetch_day").agg(
        F.count("*").alias("_n"),
        F.array_join(F.sort_array(F.collect_set("list")), ",").alias("_lists"),
        F.max_by(keys["key"], F.struct(F.length(keys["key"]), keys["key"])).alias("matched"),
    )
    out = keyed_join(rows, verdicts, ["host", "fetch_day"], "left", "url-verdicts")
    n = F.coalesce("_n", F.lit(0)).cast("long")
    return out.select("page_id", "host", "fetch_day", (n > 0).alias("blocked"), n.alias("n_active"), F.coalesce("_lists", F.lit("")).alias("lists"), "matched")
