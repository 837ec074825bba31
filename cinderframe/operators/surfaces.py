"""Look-ups in tables on one or two axes, many tables at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _bracket(x: Column, axis: Column) -> tuple[Column, Column]:
    """(index from 0 of the axis value below, share of the way to the next) of x brought within the axis."""
    inside = F.greatest(axis[0], F.least(x, F.element_at(axis, -1)))
    below = F.greatest(F.lit(0), F.least(F.size(F.filter(axis, lambda a: a <= inside)) - 1, F.size(axis) - 2))
    low, high = F.get(axis, below), F.get(axis, below + 1)
    return below, (inside - low) / (high - low)


def _outside(x: Column, axis: Column) -> Column:
    return (x < axis[0]) | (x > F.element_at(axis, -1))


def linear(rows: DataFrame, table: DataFrame, keys: list[str], axis: str, values: list[str]) -> DataFrame:
    """rows with `values` of their key's table between the two nearest of its axis, held at the ends, and `<axis>_outside`.

    The table holds a row per key and axis value, two values of the axis or more; a row without a table gets nulls.
    """
    axes = table.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(axis, *values))).alias("_t"))
    x = rows.join(axes, keys, "left")
    below, share = _bracket(F.col(axis), F.col(f"_t.{axis}"))
    x = x.withColumns({"_i": below, "_s": share, f"{axis}_outside": _outside(F.col(axis), F.col(f"_t.{axis}"))})
    at = lambda v, k: F.get(F.col(f"_t.{v}"), F.col("_i") + k)
    return x.withColumns({v: (1 - F.col("_s")) * at(v, 0) + F.col("_s") * at(v, 1) for v in values}).drop("_t", "_i", "_s")


def bilinear(rows: DataFrame, surface: DataFrame, keys: list[str], first: str, second: str, values: list[str]) -> DataFrame:
    """rows with `values` of their key's surface between the four nearest corners, held at the edges, and whether each of the
    two coordinates lies outside its axis (`<axis>_outside`).

    The surface holds a row per key and corner of a full grid over two axes. Each row finds its bracket on both axes
    (arrays of a key's axis values, which are short) and meets the cell that starts there: a table of cells with
    their four corners, joined by key and place, so the surfaces themselves may be many and large. A row without a
    surface gets nulls.
    """
    axes = surface.groupBy(*keys).agg(F.sort_array(F.collect_set(first)).alias("_a"), F.sort_array(F.collect_set(second)).alias("_b"))
    corner = surface.join(axes, keys).select(*keys, (F.array_position("_a", F.col(first)) - 1).cast("int").alias("_i"), (F.array_position("_b", F.col(second)) - 1).cast("int").alias("_j"), F.struct(*values).alias("v"))
    spread = corner.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])))
    pick = lambda i, j: F.first(F.when((F.col("o.i") == i) & (F.col("o.j") == j), F.col("v")), True).alias(f"_v{i}{j}")
    cells = spread.groupBy(*keys, (F.col("_i") - F.col("o.i")).alias("_i"), (F.col("_j") - F.col("o.j")).alias("_j")).agg(*[pick(i, j) for i in (0, 1) for j in (0, 1)])
    x = rows.join(axes, keys, "left")
    (i, s), (j, t) = _bracket(F.col(first), F.col("_a")), _bracket(F.col(second), F.col("_b"))
    x = x.withColumns({"_i": i, "_s": s, "_j": j, "_t": t, f"{first}_outside": _outside(F.col(first), F.col("_a")), f"{second}_outside": _outside(F.col(second), F.col("_b"))}).drop("_a", "_b")
    x = x.join(cells, [*keys, "_i", "_j"], "left")

    def mixed(v: str) -> Column:
        across = lambda k: (1 - F.col("_t")) * F.col(f"_v{k}0.{v}") + F.col("_t") * F.col(f"_v{k}1.{v}")
        return (1 - F.col("_s")) * across(0) + F.col("_s") * across(1)

    return x.withColumns({v: mixed(v) for v in values}).drop("_i", "_j", "_s", "_t", *[f"_v{i}{j}" for i in (0, 1) for j in (0, 1)])
