"""Joins and folds along time: as-of, bracketing, bands, gaps, runs, trailing frames and recurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinderframe.functions.weather import wind_components, wind_from


def minutes(ts: str | Column) -> Column:
    """Minutes since 1970 of a timestamp, as a double."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / F.lit(60_000_000.0)


def bracket(samples: DataFrame, queries: DataFrame, keys: list[str], time: str, chunk: float = 1440.0) -> DataFrame:
    """For each row of queries, the last sample at or before its time and the first one after it, by keys.

    Both frames have keys and a numeric column `time`; the result has the columns of queries and two structs
    `before` and `after` of the samples' columns, null where there is none. Ties among samples: the greatest
    row. Keys are cut into chunks of time, so a hot key is many sorted groups; the nearest samples of other
    chunks come from a row per key and chunk.
    """
    value = F.struct(F.col(time).alias("t"), *[F.col(c) for c in samples.columns if c != time and c not in keys])
    kind = samples.select(value.alias("s")).schema["s"].dataType
    left = samples.select(*keys, F.col(time).alias("_t"), value.alias("_s"), F.lit(0).alias("_kind"), F.lit(None).cast(queries.select(F.struct("*").alias("q")).schema["q"].dataType).alias("_q"))
    right = queries.select(*keys, F.col(time).alias("_t"), F.lit(None).cast(kind).alias("_s"), F.lit(1).alias("_kind"), F.struct(*queries.columns).alias("_q"))
    both = left.union(right).withColumn("_chunk", F.floor(F.col("_t") / chunk))
    ends = both.groupBy(*keys, "_chunk").agg(F.max("_s").alias("hi"), F.min("_s").alias("lo"))
    in_key = Window.partitionBy(*keys).orderBy("_chunk")
    ends = ends.select(*keys, "_chunk", F.last("hi", True).over(in_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_early"), F.first("lo", True).over(in_key.rowsBetween(1, Window.unboundedFollowing)).alias("_late"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_t", "_kind", "_s")
    both = both.withColumn("before", F.last("_s", True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    both = both.withColumn("after", F.first("_s", True).over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    both = both.filter("_kind = 1").join(ends, [*keys, "_chunk"])
    return both.select("_q.*", F.coalesce("before", "_early").alias("before"), F.coalesce("after", "_late").alias("after"))


def asof_last(samples: DataFrame, queries: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """queries with the value of the last sample at or before, or of the first one where all are later."""
    found = bracket(samples.select(*keys, time, value), queries, keys, time)
    return found.select(*queries.columns, F.coalesce(F.col(f"before.{value}"), F.col(f"after.{value}")).alias(value))


def asof_linear(samples: DataFrame, queries: DataFrame, keys: list[str], time: str, value: str, circle: float | None = None) -> DataFrame:
    """queries with the value between the bracketing samples, clamped at the ends; circle is the period of angles."""
    found = bracket(samples.select(*keys, time, value), queries, keys, time)
    a, b = F.col(f"before.{value}"), F.col(f"after.{value}")
    w = (F.col(time) - F.col("before.t")) / (F.col("after.t") - F.col("before.t"))
    step = b - a
    if circle:
        step = F.pmod(step + circle / 2, F.lit(circle)) - circle / 2
    between = a + w * step
    if circle:
        between = F.pmod(between, F.lit(circle))
    return found.select(*queries.columns, F.when(a.isNull(), b).when(b.isNull(), a).otherwise(between).alias(value))


def asof_wind(samples: DataFrame, queries: DataFrame, keys: list[str], time: str, speed: str, direction: str) -> DataFrame:
    """queries with speed and direction between the bracketing samples: the wind's components are interpolated, never its angle,
    and held at the ends."""
    u, v = wind_components(F.col(speed), F.col(direction))
    found = bracket(samples.select(*keys, time, u.alias("_u"), v.alias("_v")), queries, keys, time)
    w = (F.col(time) - F.col("before.t")) / (F.col("after.t") - F.col("before.t"))
    between = lambda c: F.when(F.col("before").isNull(), F.col(f"after.{c}")).when(F.col("after").isNull(), F.col(f"before.{c}")).otherwise(F.col(f"before.{c}") + w * (F.col(f"after.{c}") - F.col(f"before.{c}")))
    s, d = wind_from(between("_u"), between("_v"))
    return found.select(*queries.columns, s.alias(speed), d.alias(direction))


def nearest(samples: DataFrame, queries: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """queries with the value of the sample nearest in time; of two as near, the earlier."""
    found = bracket(samples.select(*keys, time, value), queries, keys, time)
    early = F.col(time) - F.col("before.t") <= F.col("after.t") - F.col(time)
    pick = F.when(F.col("after").isNull() | (F.col("before").isNotNull() & early), F.col(f"before.{value}")).otherwise(F.col(f"after.{value}"))
    return found.select(*queries.columns, pick.alias(value))


def overlay(background: DataFrame, analysis: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """background with the analysis' interpolated value where the analysis covers the time, ends included."""
    found = bracket(analysis.select(*keys, time, value), background, keys, time)
    a, b, t = F.col(f"before.{value}"), F.col(f"after.{value}"), F.col(time)
    at = F.when(F.col("before.t") == t, a).when(b.isNotNull(), a + (t - F.col("before.t")) / (F.col("after.t") - F.col("before.t")) * (b - a))
    return found.select(*[c for c in background.columns if c != value], F.coalesce(at, F.col(value)).alias(value), at.isNotNull().alias("replaced"))


def band_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, width: float) -> DataFrame:
    """Pairs of rows with equal keys and |time difference| <= width, as structs l and r.

    Times are put into buckets of the width; each left row meets its own and both neighbouring buckets.
    """
    r = right.select(*keys, F.floor(F.col(time) / width).alias("_b"), F.struct(*right.columns).alias("r"))
    at = F.floor(F.col(time) / width)
    x = left.select(*keys, F.explode(F.array(at - 1, at, at + 1)).alias("_b"), F.struct(*left.columns).alias("l"))
    return x.join(r, [*keys, "_b"]).filter(F.abs(F.col(f"l.{time}") - F.col(f"r.{time}")) <= width).select("l", "r")


def lagged(rows: DataFrame, keys: list[str], time: str, ties: list[str], values: list[str], chunk: float = 43_200.0, ahead: bool = False) -> DataFrame:
    """rows with `_c`, their chunk of time, and `_prev`, a struct of the values in the row before in (time, ties) of their key,
    null for the first; with ahead, `_next` of the row behind.

    Only rows of a chunk are sorted together; the row before a chunk's first comes from a row per key and chunk. So a
    key that holds most of all rows is many sorted groups.
    """
    x = rows.withColumn("_c", F.floor(F.col(time) / chunk)).withColumn("_v", F.struct(*values)).withColumn("_o", F.struct(time, *ties))
    ends = x.groupBy(*keys, "_c").agg(F.max_by("_v", "_o").alias("hi"), F.min_by("_v", "_o").alias("lo"))
    beside = lambda c, w: (F.lead if ahead else F.lag)(c).over(w)
    ends = ends.select(*keys, "_c", beside("lo" if ahead else "hi", Window.partitionBy(*keys).orderBy("_c")).alias("_edge"))
    name = "_next" if ahead else "_prev"
    x = x.withColumn(name, beside("_v", Window.partitionBy(*keys, "_c").orderBy("_o"))).join(ends, [*keys, "_c"])
    return x.withColumn(name, F.coalesce(name, "_edge")).drop("_v", "_o", "_edge")


def with_gap(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """rows with `gap`, the time since the row before, null for the first of its key."""
    return lagged(rows, keys, time, [tie], [time]).withColumn("gap", F.col(time) - F.col(f"_prev.{time}")).drop("_c", "_prev")


def cadence(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Per key, of the gaps in hours: number, median, tenths, and shares up to 18 and 30 and above 36."""
    from cinderframe.operators.statistics import quantiles

    hours = with_gap(rows, keys, time, tie).select(*keys, (F.col("gap") / 60).alias("h")).filter("h is not null")
    share = lambda cond: F.avg(cond.cast("double"))
    q = quantiles(hours, keys, "h", {"q10": 0.1, "median": 0.5, "q90": 0.9})
    out = hours.groupBy(*keys).agg(F.count("*").alias("n"), share(F.col("h") <= 18).alias("le18"), share(F.col("h") <= 30).alias("le30"), share(F.col("h") > 36).alias("gt36"))
    return out.join(q, keys).select(*keys, "n", "q10", "median", "q90", "le18", "le30", "gt36")


def longest_run(rows: DataFrame, keys: list[str], time: str, tie: str, low: float, high: float, chunk: float = 43_200.0) -> DataFrame:
    """Per key, the longest run of consecutive gaps in [low, high] (minutes), the first of equals: run, start.

    Each chunk of time gives its runs; a run that reaches a chunk's end goes on in the next, which a second pass over
    a row per chunk and run puts together.
    """
    x = lagged(rows, keys, time, [tie], [time], chunk).withColumn("gap", F.col(time) - F.col(f"_prev.{time}"))
    x = x.withColumn("ok", F.coalesce(F.col("gap").between(low, high), F.lit(False)))
    w = Window.partitionBy(*keys, "_c").orderBy(time, tie)
    x = x.withColumn("_n", F.row_number().over(w)).withColumn("_breaks", F.sum((~F.col("ok")).cast("long")).over(w))
    parts = x.groupBy(*keys, "_c", "_breaks").agg(F.count_if("ok").alias("run"), F.min(F.when(F.col("ok"), F.col("_n"))).alias("first"))
    size = x.groupBy(*keys, "_c").agg(F.count("*").alias("_rows"))
    over = Window.partitionBy(*keys).orderBy("_c")
    size = size.select(*keys, "_c", (F.sum("_rows").over(over) - F.col("_rows")).alias("_before"))
    parts = parts.join(size, [*keys, "_c"])
    # a break opens every part but a chunk's first (0 breaks), which belongs to the last part before it
    order = Window.partitionBy(*keys).orderBy("_c", "_breaks")
    parts = parts.withColumn("island", F.sum((F.col("_breaks") > 0).cast("long")).over(order))
    runs = parts.groupBy(*keys, "island").agg(F.sum("run").alias("run"), F.min(F.col("_before") + F.col("first")).alias("start")).filter("run > 0")
    return runs.groupBy(*keys).agg(F.max(F.struct("run", -F.col("start"))).alias("m")).select(*keys, F.col("m.run").alias("run"), (-F.col("m")["col2"]).cast("long").alias("start"))


def hour_blocks(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Blocks of consecutive hours that have rows: keys, block, first and last hour (hours since 1970), n."""
    hours = rows.select(*keys, F.floor(minutes(ts) / 60).cast("long").alias("hour")).distinct()
    x = hours.withColumn("g", F.col("hour") - F.row_number().over(Window.partitionBy(*keys).orderBy("hour")))
    x = x.groupBy(*keys, "g").agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count("*").alias("n"))
    return x.withColumn("block", F.row_number().over(Window.partitionBy(*keys).orderBy("first_hour"))).drop("g")


def monotone_fraction(rows: DataFrame, keys: list[str], order: list[str], value: str, least: float = 5.0, share: float = 0.01) -> DataFrame:
    """Share of steps that do not fall by more than max(least, share of the value before); 1 for a single row."""
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    x = rows.select(*keys, prev.alias("p"), F.col(value).alias("v")).withColumn("ok", F.when(F.col("p").isNotNull(), (F.col("v") - F.col("p") >= -F.greatest(F.lit(least), F.lit(share) * F.col("p"))).cast("double")))
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.avg("ok"), F.lit(1.0)).alias("monotone"))


def first_true(rows: DataFrame, keys: list[str], frame: str, flag: Column) -> DataFrame:
    """Per key, the first frame where flag holds, else -1."""
    return rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(flag, F.col(frame))), F.lit(-1)).alias("first_frame"))


def trailing(rows: DataFrame, keys: list[str], order: str, value: str, n: int, name: str, how: str = "sum") -> DataFrame:
    """rows with the trailing sum or mean over the last n rows, itself included; fewer at the start."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - n, Window.currentRow)
    return rows.withColumn(name, (F.sum(value) if how == "sum" else F.avg(value)).over(w))


def trim(rows: DataFrame, keys: list[str], time: str, start: Column, end: Column) -> DataFrame:
    """rows from the last at or before start to the first at or after end, by key, with time counted from start."""
    edges = rows.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(time) <= start, F.col(time))), F.min(time)).alias("_a"), F.coalesce(F.min(F.when(F.col(time) >= end, F.col(time))), F.max(time)).alias("_b"))
    return rows.join(edges, keys).filter(F.col(time).between(F.col("_a"), F.col("_b"))).drop("_a", "_b").withColumn("rebased", F.col(time) - start)


def ordered(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row per key with `x`, the array of (order, values) in order: what a fold runs over."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *values))).alias("x"))


def discounted_return(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], value: str, gamma: float, done: Column | None = None) -> DataFrame:
    """(keys, ret): sum of gamma ** k times the k-th value of each key in order, up to and with the first row where done holds.

    A key's rows are folded in chunks (of time, say; chunk must not fall in order), each to its own sum, factor and
    whether it ends; a second fold over the chunks puts these together. So a hot key is many small groups.
    """
    stop = F.coalesce(done, F.lit(False)) if done is not None else F.lit(False)
    x = rows.select(*keys, chunk.alias("_c"), *order, F.col(value).cast("double").alias("_v"), stop.alias("_d"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("g"), F.lit(False).alias("end"))
    step = lambda a, r: F.struct(F.when(a.end, a.s).otherwise(a.s + a.g * r["_v"]).alias("s"), (a.g * gamma).alias("g"), (a.end | r["_d"]).alias("end"))
    parts = ordered(x, [*keys, "_c"], order, ["_v", "_d"]).select(*keys, "_c", F.aggregate("x", start, step).alias("f"))
    both = lambda a, r: F.struct(F.when(a.end, a.s).otherwise(a.s + a.g * r.f.s).alias("s"), (a.g * r.f.g).alias("g"), (a.end | r.f.end).alias("end"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_c", "f"))).alias("x"))
    return whole.select(*keys, F.aggregate("x", start, both, lambda a: a.s).alias("ret"))


def advantages(rows: DataFrame, keys: list[str], chunk: Column, order: list[str], reward: str, value: str, done: str, gamma: float, lam: float) -> DataFrame:
    """(keys, order, advantage) of every step: generalised advantages, a reverse recurrence that starts anew where done holds.

    A chunk's fold leaves open the advantage A and the value V of the step behind it: every advantage in it is
    p + q A + r V. A reverse fold over the chunks finds A and V for each, and only then are the steps written.
    """
    x = rows.select(*keys, chunk.alias("_c"), *order, F.col(reward).cast("double").alias("_r"), F.col(value).cast("double").alias("_v"), F.when(F.col(done), 0.0).otherwise(1.0).alias("_go"))
    parts = ordered(x, [*keys, "_c"], order, ["_r", "_v", "_go"])
    number = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])

    def step(a: Column, e: Column) -> Column:
        pull = gamma * lam * e["_go"]
        ahead = gamma * e["_go"]
        return number(p=e["_r"] - e["_v"] + ahead * a.n + pull * a.p, q=pull * a.q, r=ahead * a.m + pull * a.r, n=e["_v"], m=F.lit(0.0))

    start = number(p=F.lit(0.0), q=F.lit(1.0), r=F.lit(0.0), n=F.lit(0.0), m=F.lit(1.0))
    heads = parts.select(*keys, "_c", F.aggregate(F.reverse("x"), start, step).alias("f"))
    chain = heads.groupBy(*keys).agg(F.reverse(F.array_sort(F.collect_list(F.struct("_c", "f")))).alias("x"))
    empty = F.struct(F.lit(0.0).alias("A"), F.lit(0.0).alias("V"))
    kind = chain.select(F.transform("x", lambda h: F.struct(h["_c"].alias("_c"), F.lit(0.0).alias("A"), F.lit(0.0).alias("V"))).alias("t")).schema["t"].dataType
    link = lambda a, h: F.struct((h.f.p + h.f.q * a.now.A + h.f.r * a.now.V).alias("A"), h.f.n.alias("V"))
    walk = lambda a, h: F.struct(link(a, h).alias("now"), F.concat(a.out, F.array(F.struct(h["_c"].alias("_c"), a.now.A.alias("A"), a.now.V.alias("V")))).alias("out"))
    edges = chain.select(*keys, F.explode(F.aggregate("x", F.struct(empty.alias("now"), F.array().cast(kind).alias("out")), walk, lambda a: a.out)).alias("e"))
    parts = parts.join(edges.select(*keys, F.col("e._c").alias("_c"), F.col("e.A").alias("A"), F.col("e.V").alias("V")), [*keys, "_c"])

    def back(a: Column, e: Column) -> Column:
        delta = e["_r"] + gamma * e["_go"] * a.next - e["_v"]
        adv = delta + gamma * lam * e["_go"] * a.adv
        return F.struct(adv.alias("adv"), e["_v"].alias("next"), F.concat(a.out, F.array(F.struct(*[e[o].alias(o) for o in order], adv.alias("advantage")))).alias("out"))

    kind = parts.select(F.transform("x", lambda e: F.struct(*[e[o].alias(o) for o in order], F.lit(0.0).alias("advantage"))).alias("t")).schema["t"].dataType
    begin = F.struct(F.col("A").alias("adv"), F.col("V").alias("next"), F.array().cast(kind).alias("out"))
    return parts.select(*keys, F.explode(F.aggregate(F.reverse("x"), begin, back, lambda a: a.out)).alias("e")).select(*keys, *[F.col(f"e.{o}").alias(o) for o in order], F.col("e.advantage").alias("advantage"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, width: float) -> DataFrame:
    """Pairs (l, r) of rows with equal keys whose half-open intervals [start, end) overlap.

    An interval is put into every bucket of `width` that it touches; a pair is taken only in the bucket in
    which its overlap begins, so it comes once. Choose width near the usual length of an interval.
    """
    touched = lambda: F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.greatest(F.col(end), F.col(start))) / width)))
    l = left.select(*keys, touched().alias("_b"), F.struct(*left.columns).alias("l"))
    r = right.select(*keys, touched().alias("_b"), F.struct(*right.columns).alias("r"))
    first = F.floor(F.greatest(F.col(f"l.{start}"), F.col(f"r.{start}")) / width)
    cond = (F.col(f"l.{start}") < F.col(f"r.{end}")) & (F.col(f"r.{start}") < F.col(f"l.{end}")) & (F.col("_b") == first)
    return l.join(r, [*keys, "_b"]).filter(cond).select("l", "r")
