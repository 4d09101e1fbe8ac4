"""URL filters by an as-of join with dated lists, in DataFrame functions only.

List events (domain, listed_at, action 'block' | 'allow' | 'remove') make validity intervals: an
event holds from its time (inclusive) until the next event of the same domain (exclusive). A
capture is matched on its host and each parent domain with the event that holds at its fetch time;
the longest domain with a block or an allow decides, so 'allow' on it overrules 'block' above it.

The as-of join orders a domain's events and fetch times in one sequence and carries the last event
forward. Only distinct times of listed domains take part, and a domain's sequence is cut into
buckets of ``BUCKET`` units of time, each with the event that held before it, so a domain that a
third of all captures have is neither one row for each capture nor one group. Of events of one
domain at one time 'block' goes before 'allow' before 'remove', and equal events count once.

A host may have any length and any number of parents: of its parents only those are made that
have as many labels as some listed domain, so a host costs its length times the few numbers of labels on
the list. An IPv6 address in brackets is a host without them, and has no parents.

Times are numbers, dates or timestamps. Nulls: a capture without a url, host or fetch time is not
blocked. A url without a scheme and '//' has no host ('//host/x', 'http:\\\\host', 'host/x'). List rows
with a null field or another action are left out. Repeated captures give repeated results. Empty
tables give empty results; an empty list blocks nothing. Other columns of the captures are passed on;
those named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, fresh, small

ACTIONS = ["block", "allow", "remove"]
RESULTS = ["matched_domain", "list_action", "listed_at", "blocked"]
#: Units of time (days, seconds) in a bucket.
BUCKET = 86_400


def host_of(url: Column) -> Column:
    """Lower-case host without port, user, final dot and the brackets of an IPv6 address; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)", 1)
    host = F.regexp_replace(host, r"^\[|\]$|\.+$", "")
    return F.when(host != "", host)


def labels_in(name: Column) -> Column:
    """How many labels a domain has; an IPv6 address counts as one."""
    return F.when(name.contains(":"), 1).otherwise(F.size(F.split(name, r"\.")))


def parents(host: Column, depths: list[int]) -> Column:
    """The host's last labels, as many as each of ``depths`` says, where it has so many."""
    own = F.filter(F.array(*map(F.lit, depths)).cast("array<int>"), lambda k: k <= labels_in(host))
    return F.transform(own, lambda k: F.when(host.contains(":"), host).otherwise(F.call_function("substring_index", host, F.lit("."), -k)))


def number_of(df: DataFrame, name: str) -> Column:
    """A time column as a number that orders and equals like it."""
    own = F.col(f"`{name}`")
    return (own.cast("timestamp") if isinstance(df.schema[name].dataType, T.DateType) else own).cast("double")


def folded(events: DataFrame) -> DataFrame:
    """(domain, x, event): one event for each domain and time, with the time as a number."""
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 2)
    own = events.select(F.lower("domain").alias("domain"), number_of(events, "listed_at").alias("x"), F.struct(rank.alias("rank"), "listed_at").alias("event"))
    return own.where("domain is not null and x is not null and event.rank is not null").groupBy("domain", "x").agg(F.min("event").alias("event"))


def as_of(points: DataFrame, events: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(domain, x, event): for each of the distinct points (domain, x) the last event of the domain at or before x, if there is one."""
    of = F.floor(F.col("x") / bucket).alias("bucket")
    own, listed = points.select("domain", of, "x"), events.select("domain", of, "x", "event")
    begins = own.select("domain", "bucket").distinct()

    def carried(rows: DataFrame, keys: list[str]) -> DataFrame:
        before = Window.partitionBy(*keys).orderBy("x", F.col("event").isNull()).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("last", F.last("event", ignorenulls=True).over(before)).where("event is null and last is not null")

    marks = begins.select("domain", "bucket", (F.col("bucket") * bucket).cast("double").alias("x"))
    # what holds as a bucket begins, from the domain's events and one row for each of its buckets
    held = carried(listed.unionByName(marks, allowMissingColumns=True), ["domain"]).select("domain", "bucket", "x", F.col("last").alias("event"))
    inside = listed.join(begins, ["domain", "bucket"], "left_semi")
    rows = inside.unionByName(held).unionByName(own, allowMissingColumns=True)
    return carried(rows, ["domain", "bucket"]).select("domain", "x", F.col("last").alias("event"))


def verdicts(captures: DataFrame, events: DataFrame) -> DataFrame:
    """``captures`` (with url, fetched_at) plus matched_domain, list_action, listed_at and blocked."""
    host, time = fresh(captures, "_host"), fresh(captures, "_time")
    own = captures.withColumn(host, host_of(F.col("url"))).withColumn(time, number_of(captures, "fetched_at"))
    keys = own.select(F.col(host).alias("host"), F.col(time).alias("x")).dropna().distinct()
    listed = checkpoint(folded(events))
    # numbers of labels on the list: k of them take a list of k * k / 2 labels at least
    depths = sorted(r[0] for r in listed.select(labels_in(F.col("domain"))).distinct().collect())
    domains = parents(F.col("host"), depths)
    # top-level domains and other names that no list has go before anything is dealt out by domain
    each = keys.select("host", "x", F.explode(domains).alias("domain")).join(small(listed.select("domain")), "domain", "left_semi")
    state = as_of(each.select("domain", "x").distinct(), listed).where("event.rank < 2")
    hit = each.join(state, ["domain", "x"])
    best = hit.groupBy("host", "x").agg(F.max_by(F.struct("domain", "event"), F.length("domain")).alias("b"))
    named = small(checkpoint(best.select(F.col("host").alias(fresh(own, "_h")), F.col("x").alias(fresh(own, "_x")), F.col("b").alias(fresh(own, "_b")))))
    h, x, b = named.columns
    joined = own.join(named, (F.col(host) == F.col(h)) & (F.col(time) == F.col(x)), "left")
    rank = F.col(f"{b}.event.rank")
    action = F.when(rank == 0, ACTIONS[0]).when(rank == 1, ACTIONS[1])
    results = [F.col(f"{b}.domain"), action, F.col(f"{b}.event.listed_at"), F.coalesce(action == "block", F.lit(False))]
    return joined.select(*[F.col(f"`{c}`") for c in captures.columns if c.lower() not in RESULTS], *[c.alias(n) for c, n in zip(results, RESULTS, strict=True)])


def keep_allowed(captures: DataFrame, events: DataFrame) -> DataFrame:
    """The captures that are not blocked, with their own columns."""
    renamed = {c: fresh(captures, f"_own_{c}") for c in captures.columns if c.lower() in RESULTS}
    out = verdicts(captures.withColumnsRenamed(renamed), events).where("not blocked")
    return out.select(*[F.col(f"`{renamed.get(c, c)}`").alias(c) for c in captures.columns])
