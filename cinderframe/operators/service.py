"""Service sites, rules for actions, and registries of evidence: stock drawn in order, what a task asks of a resource, faults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.operators.fleet import compatible
from cinderframe.operators.selection import admit
from cinderframe.operators.statistics import quantiles

#: Kinds that carry a payload, and services that give back endurance.
AERIAL = ("water", "retardant")
ENDURANCE = ("fuel", "charge")


def running_before(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the sum of value in the rows of their keys that come before.

    chunk must not fall along order. A key's chunks are summed first and only these sums meet in one task; within a
    chunk rows are sorted by themselves, so a key with most rows is many tasks. Rows with a null key or chunk are left out.
    """
    first = Window.unboundedPreceding
    x = rows.withColumn("_chunk", chunk)
    sums = x.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_sum"))
    base = sums.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(first, -1)), F.lit(0)).alias("_base"))
    inner = F.coalesce(F.sum(value).over(Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(first, -1)), F.lit(0))
    return x.withColumn("_inner", inner).join(base, [*keys, "_chunk"]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_chunk", "_base", "_inner")


def served(queue: DataFrame, sites: DataFrame, site: str, moment: str, age: str, index: list[str], missing: str, takes: Column, chunk: float = 1440.0) -> DataFrame:
    """Who is served at each moment, what each loads and how long it takes.

    queue: rows waiting at a site at a moment (minutes), with their age and what is missing. sites: a row per site with
    bays (free at a moment), stock, open_minute, close_minute, fixed_minutes and rate. A site admits only while it is
    open, the oldest first, of equals by index, as many as it has bays. The admitted load what is missing, if the site
    offers it (takes), as long as the stock of the site lasts, in order of moment, age and index. Returns the
    admitted rows with load, stock_left and minutes (rounded up, at least 1).
    """
    x = queue.join(sites, site).filter((F.col(moment) >= F.col("open_minute")) & (F.col(moment) < F.col("close_minute")))
    x = x.withColumn("_first", F.struct(*index))
    x = admit(x, [site, moment], age, "_first", "bays").withColumns({"_want": F.when(takes, F.col(missing)).otherwise(0.0), "_age": -F.col(age)})
    x = running_before(x, [site], F.floor(F.col(moment) / chunk), [moment, "_age", "_first"], "_want", "_before")
    left = lambda used: F.greatest(F.lit(0.0), F.col("stock") - used)
    x = x.withColumn("stock_left", left(F.col("_before") + F.col("_want"))).withColumn("load", left(F.col("_before")) - F.col("stock_left"))
    return x.withColumn("minutes", F.greatest(F.lit(1), F.ceil(F.col("fixed_minutes") + F.col("load") / F.col("rate")))).drop("_first", "_want", "_before", "_age")


def action_rules(task: Column, kind: Column, status: Column, resource: dict[str, Column], site: dict[str, Column], minute: Column, travel: Column, wind: Column, intensity: Column, reserve_ok: Column, least_payload: float, most_wind: float, most_intensity: float) -> dict[str, Column]:
    """What must hold for a resource to take a task, by name, for fleet.feasible(); to hold breaks nothing.

    resource: payload (a share), flown, latency, modes, max_wind, max_intensity, depth, length. site (null columns where a
    task has none): mode, services, bays, open, close, max_wind, depth, length, stock.
    """
    hold, service, aerial = task == "hold", task == "service", kind.isin(*AERIAL)
    gives = F.array_contains(site["services"], kind)
    refills = (resource["payload"] < 1 - 1e-6) & gives
    recovers = (resource["flown"] > 1e-6) & F.arrays_overlap(site["services"], F.array(*[F.lit(s) for s in ENDURANCE]))
    arrival = minute + F.ceil(travel) + resource["latency"]
    at_site = {
        "mode": F.array_contains(resource["modes"], site["mode"]),
        "use": refills | recovers,
        "bays": site["bays"] > 0,
        "hours": (arrival >= site["open"]) & (arrival < site["close"]),
        "site_wind": wind <= site["max_wind"],
        "depth": site["depth"] >= resource["depth"],
        "length": site["length"] >= resource["length"],
        "stock": ~gives | (site["stock"] > 0),
    }
    rules = {"kind": compatible(task, kind, status)} | {name: ~service | ok for name, ok in at_site.items()}
    rules["payload"] = ~aerial | service | (resource["payload"] >= least_payload)
    rules["wind"] = ~aerial | (wind <= F.least(resource["max_wind"], F.lit(most_wind)))
    rules["intensity"] = (kind != "crew") | (intensity <= F.least(resource["max_intensity"], F.lit(most_intensity)))
    rules["reserve"] = reserve_ok
    return {name: hold | ok for name, ok in rules.items()}


def registry_faults(documents: DataFrame, evidence: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(registry_id, fault, name) of what sources.tables.read_registries() gives: documents and profiles named twice, evidence
    that cites unknown documents, and, against a catalogue's profiles (registry_id, profile_id), those without evidence and
    evidence for unknown ones. Joins and counts by registry and name; no registry is brought together."""
    at = ["registry_id", "name"]
    docs = documents.select("registry_id", F.col("document_id").alias("name"))
    own = evidence.select("registry_id", F.col("profile_id").alias("name"), "position").distinct().drop("position")
    cited = evidence.select("registry_id", F.explode("document_ids").alias("name")).distinct()
    twice = lambda x: x.groupBy(*at).count().filter("count > 1").drop("count")
    faults = {"document twice": twice(docs), "profile twice": twice(own), "unknown document": cited.join(docs, at, "left_anti")}
    if profiles is not None:
        known = profiles.select("registry_id", F.col("profile_id").alias("name")).distinct()
        faults |= {"no evidence": known.join(own, at, "left_anti"), "unknown profile": own.distinct().join(known, at, "left_anti")}
    named = [x.select("registry_id", F.lit(fault).alias("fault"), "name") for fault, x in faults.items()]
    out = named[0]
    for x in named[1:]:
        out = out.union(x)
    return out


def stretched(rows: DataFrame, by: list[str], value: str, name: str, low: float = 0.02, high: float = 0.98, gamma: float = 1.0) -> DataFrame:
    """rows with value brought to 0..1 between two quantiles of its group, then to the power 1 / gamma; a group without spread
    takes 1 as its width. Null and not-a-number values, and groups of these alone, give null."""
    q = quantiles(rows, by, value, {"_low": low, "_high": high})
    q = q.withColumnsRenamed({c: f"_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    width = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - F.col("_low")) / width))
    return rows.join(q, on, "left").withColumn(name, F.when(F.col(value).isNotNull() & ~F.isnan(value), F.pow(share, 1.0 / gamma))).select(*rows.columns, name)
