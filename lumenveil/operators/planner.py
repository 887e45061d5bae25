"""Capacity planning for host pools as pure functions of one tick.

A pool is a small dimension (hosts of one controller, at most MAX_HOSTS rows);
tasks and workers are only counted, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenveil.functions import scalars
from lumenveil.operators.control import numbered

MAX_HOSTS = 10_000


def readiness(hosts: DataFrame, workers: DataFrame) -> DataFrame:
    """Hosts with their slots, ready slots and whether all slots are ready."""
    seen = workers.groupBy(F.col("controller_seen_ip").alias("private_ip")).agg(F.count("*").alias("slots"), F.count_if(F.col("status") == "ready").alias("ready"), F.bool_and(F.col("status") == "ready").alias("all_ready"))
    joined = hosts.join(seen, "private_ip", "left")
    return joined.select("name", "private_ip", "status", "capacity", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("ready", F.lit(0)).alias("ready"), F.coalesce("all_ready", F.lit(False)).alias("all_ready"))


def shortfall(pending: int, ready: int, requested: int = 0) -> int:
    return max(0, max(0, pending - ready) - requested)


def start_order(hosts: DataFrame, needed: int) -> DataFrame:
    """Stopped hosts ranked: the smallest that covers the need, else the largest."""
    covers = F.col("capacity") >= needed
    order = [F.when(covers, 0).otherwise(1), F.when(covers, F.col("capacity")).otherwise(-F.col("capacity")), "name"]
    return numbered(hosts.filter("status = 'stopped'"), order, "rank")


def first_ranked(ranked: DataFrame, needed: int, most: int) -> DataFrame:
    """The hosts of least ``rank``, at most ``most``, until their capacity covers the need.

    ``most`` bounds the rows that the running sum sees.
    """
    order = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    begun = ranked.filter(F.col("rank") <= most).withColumn("before", F.coalesce(F.sum("capacity").over(order), F.lit(0)))
    return begun.filter(F.col("before") < needed)


def cumulative_fill(hosts: DataFrame, needed: int, most: int) -> DataFrame:
    """The hosts to start, largest first, until the need is covered."""
    return first_ranked(numbered(hosts.filter("status = 'stopped'"), [F.desc("capacity"), "name"], "rank"), needed, most)


def actions(hosts: DataFrame, *, pending: int, oldest_age: float, now: float, needed: int, max_start: int = 2, max_stop: int = 1, min_hosts: int = 1, pending_grace: float = 60, start_grace: float = 900, stop_grace: float = 1800, idle_seconds: float = 1800) -> DataFrame:
    """(kind, name, reason) for one tick.

    hosts: name, status, capacity, all_ready, idle_since, start_requested_at,
    stop_requested_at. Pending work of the grace age starts hosts beyond what is
    already requested; any pending work keeps every host; otherwise hosts idle long
    enough stop, down to min_hosts.
    """
    if pending:
        requested = hosts.filter((F.col("status") == "stopped") & (F.col("start_requested_at") > now - start_grace)).agg(F.coalesce(F.sum("capacity"), F.lit(0)).alias("n")).first().n
        free = hosts.filter(~F.coalesce(F.col("start_requested_at") > now - start_grace, F.lit(False)))
        missing = max(0, needed - requested)
        begin = first_ranked(start_order(free, missing), missing, max_start) if oldest_age >= pending_grace else free.limit(0)
        return begin.select(F.lit("start").alias("kind"), "name", F.lit("pending work").alias("reason"))
    running = hosts.filter("status = 'running'")
    idle = running.filter(F.col("all_ready") & (F.col("idle_since") <= now - idle_seconds) & ~F.coalesce(F.col("stop_requested_at") > now - stop_grace, F.lit(False)))
    room = max(0, min(max_stop, running.count() - min_hosts))
    return idle.orderBy("idle_since", "name").limit(room).select(F.lit("stop").alias("kind"), "name", F.lit("idle").alias("reason"))


def idle_since(samples: DataFrame) -> DataFrame:
    """(name, idle_since): start of each host's current all-ready run.

    samples: name, at, all_ready. Null if the latest sample is not all-ready.
    """
    last_busy = samples.groupBy("name").agg(F.max(F.when(~F.col("all_ready"), F.col("at"))).alias("busy"))
    since = samples.join(last_busy, "name").filter(F.col("busy").isNull() | (F.col("at") > F.col("busy"))).groupBy("name").agg(F.min("at").alias("idle_since"))
    return samples.select("name").distinct().join(since, "name", "left")


def changes(samples: DataFrame) -> DataFrame:
    """(name, at, before, after) wherever a host's status changes."""
    before = F.lag("status").over(Window.partitionBy("name").orderBy("at"))
    return samples.withColumn("before", before).filter("before <> status").select("name", "at", "before", F.col("status").alias("after"))


def map_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, old, new) of keys that came, went or changed."""
    joined = old.select("key", F.col("value").alias("old")).join(new.select("key", F.col("value").alias("new")), "key", "full")
    return joined.filter(~F.col("old").eqNullSafe(F.col("new")))


def unlisted(managed: DataFrame, listed: DataFrame) -> DataFrame:
    """Managed addresses that no listing shows."""
    return managed.select("private_ip").distinct().join(listed.select("private_ip"), "private_ip", "left_anti")


def allowed(hosts: DataFrame, addresses: DataFrame) -> DataFrame:
    """Hosts whose address is on the list of managed ones."""
    return hosts.join(addresses.select("private_ip").distinct(), "private_ip", "left_semi").select(hosts.columns)


def configured(entries: DataFrame, most: int = 16) -> DataFrame:
    """(pool, place, entry, ip, slots, problem) of entries (pool, place, entry) such as ``10.0.0.1=4``.

    problem: ``invalid`` (no address or no number), ``slots`` (a number outside 1 to
    ``most``), ``duplicate`` (the address stands in an earlier right entry of the
    pool), else null. Entries of a pool are told apart by their places.
    """
    ip, number = F.regexp_extract("entry", "^([^=]*)=", 1), F.regexp_extract("entry", "=(-?[0-9]+)$", 1).try_cast("int")
    read = entries.select("pool", "place", "entry", ip.alias("ip"), number.alias("slots"))
    problem = F.when(~scalars.is_ip(F.col("ip")) | F.col("slots").isNull(), "invalid").when(~F.col("slots").between(1, most), "slots")
    judged = read.withColumn("problem", problem)
    first = judged.filter("problem is null").groupBy("pool", "ip").agg(F.min("place").alias("first"))
    again = F.col("problem").isNull() & (F.col("place") > F.col("first"))
    return judged.join(first, ["pool", "ip"], "left").select("pool", "place", "entry", "ip", "slots", F.when(again, "duplicate").otherwise(F.col("problem")).alias("problem"))
