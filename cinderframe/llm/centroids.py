"""Centroid clustering in exact integers: distances by matrix products in float64 where all of them stay below 2^53."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cinderframe.llm._bytes import release
from cinderframe.llm._frames import Scratch

#: Vectors in a packed block: 1 MB at 64 components.
BLOCK = 4096
LONG = (1 << 63) - 1
#: Integers of float64 are exact below this.
EXACT = 1 << 53


def _scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, for values too large for a matrix product; a product over the double
    range is taken in integers."""
    out = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        y = float(v) * scale
        out[at] = int(np.floor(y)) if np.isfinite(y) else int(v) * scale
    return out


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def _split(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each vector's integers fit 32 bits, and the integers of those that do."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    fits = (np.abs(y) < 2**31).all(axis=1)
    return fits, y[fits].astype("<i4")


def _pack(dims: int, scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of vectors as bytes: 32-bit integers where they fit, else the doubles themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = _vectors(batch.column("x").slice(at, BLOCK), dims)
                fits, small = _split(x, scale)
                wide = x[~fits].astype("<f8")
                out = [(k, d.tobytes()) for k, d in ((True, small), (False, wide)) if len(d)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.bool_()), pa.array([d for _, d in out], pa.binary())], names=["small", "data"])
        release()

    return run


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors to centres as |x|^2 - 2 x.c + |c|^2.

    While four times the number of components times the largest square is below 2^53, every term and every partial
    sum of the expansion is an integer that float64 holds, so the matrix product is exact whatever its order. Below
    2^63 the same holds for 64-bit integers; beyond, Python's own integers are used.
    """
    largest = max(int(abs(x).max()), int(abs(centres).max()))
    bound = 4 * x.shape[1] * largest * largest
    kind = np.float64 if bound < EXACT else np.int64 if bound <= LONG else object
    a, c = x.astype(kind), centres.astype(kind)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, of equals the smaller number, and the squared distance."""
    d = _distances(x, centres)
    best = np.argmin(d, axis=1)
    return best, d[np.arange(len(d)), best]


def _parts(x: np.ndarray, scaled: bool, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their integer vectors): those fit for an exact matrix product, those of 32 bits, and the largest.

    scaled: x holds integers of 32 bits already.
    """
    fits, small = (np.ones(len(x), bool), x) if scaled else _split(x, scale)
    rows, small = np.flatnonzero(fits), small.astype(np.int64)
    fine = np.abs(small).max(axis=1, initial=0) <= math.isqrt((EXACT - 1) // (4 * x.shape[1]))
    for pick in (fine, ~fine):
        if pick.any():
            yield rows[pick], small[pick]
    if not fits.all():
        yield np.flatnonzero(~fits), _scaled(x[~fits], scale)


Totals = tuple[np.ndarray, np.ndarray, np.ndarray]


def _add_block(total: Totals, block: tuple[bool, bytes], dims: int, scale: int, centres: np.ndarray) -> Totals:
    """Add a block's vectors, numbers and squared distances by nearest centre; sums are Python integers."""
    sums, counts, inertia = total
    small, data = block
    for _, x in _parts(np.frombuffer(data, "<i4" if small else "<f8").reshape(-1, dims), small, scale):
        best, d = _nearest(x, centres)
        d = d.astype(np.int64 if d.dtype != object and d.max() < LONG // BLOCK else object)  # a block's sum fits
        for k in np.unique(best):
            mine = best == k
            sums[k] += x[mine].sum(axis=0).astype(object)  # at most 4096 integers of 32 bits, or Python's own
            counts[k] += int(mine.sum())
            inertia[k] += int(d[mine].sum())
    return total


def _merge(a: Totals, b: Totals) -> Totals:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _zero(k: int, dims: int) -> Totals:
    return np.zeros((k, dims), object), np.zeros(k, object), np.zeros(k, object)


def _assign(dims: int, scale: int, centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _vectors(part.column("x"), dims)
                cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
                for rows, y in _parts(x, False, scale):
                    cluster[rows], d = _nearest(y, centres)
                    distance[rows] = d if d.dtype != object else [min(int(v), LONG) for v in d]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster), pa.array(distance)], names=["id", "cluster", "distance"])
        release()

    return run


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector.

    A vector counts if it has exactly `dims` components, none of them null or not finite; others give no row. Its
    components become floor(scale * x). The first centroids are the k vectors with the smallest SHA-256 of
    `seed:id`, null ids last, of equal ids the smaller vector; with fewer than k vectors there are fewer centroids.
    `rounds` times every vector goes to the nearest centroid and each centroid to the exact floor of its vectors'
    mean; an empty one stays.

    Vectors are packed into blocks once and written; each round is one treeAggregate over the blocks, which brings k
    sums of Python integers to the driver, whatever the number of vectors or the size of a cluster. Distances beyond
    the range of a long are given as the largest long; clusters and centroids stay exact. Repeated rows are vectors
    like others and get equal results; other columns are not read; an empty table gives an empty result.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "centroids")
    id_type = vectors.schema[id_col].dataType
    out_schema = T.StructType([T.StructField(id_col, id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.filter((F.size(vector_col) == dims) & finite).select(F.col(id_col).alias("id"), F.col(vector_col).alias("x"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(rank.asc_nulls_last(), "x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], out_schema)
    centres = _narrow(_scaled(np.array([r.x for r in first], np.float64), scale))
    blocks = scratch.cut(kept.mapInArrow(_pack(dims, scale), "small boolean, data binary")).rdd.map(lambda r: (r.small, bytes(r.data)))

    def totals(centres: np.ndarray) -> Totals:
        return blocks.treeAggregate(_zero(len(centres), dims), partial(_add_block, dims=dims, scale=scale, centres=centres), _merge)

    for _ in range(rounds):
        sums, counts, _inertia = totals(centres)
        centres = _narrow(np.array([[s // n for s in row] if n else list(map(int, old)) for row, n, old in zip(sums, counts, centres, strict=True)], object))
    inertia = totals(centres)[2]
    shas = [hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in centres]

    def of_cluster(values: list) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)

    kind = T.StructType([T.StructField("id", id_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = kept.mapInArrow(_assign(dims, scale, centres), kind)
    return assigned.select(
        F.col("id").alias(id_col), "cluster", "distance", of_cluster([min(v, LONG) for v in inertia]).cast("long").alias("cluster_inertia"), F.lit(min(sum(inertia), LONG)).cast("long").alias("inertia"), of_cluster(shas).alias("centroid_sha256")
    )


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers as 64 bits if all fit."""
    return x.astype(np.int64) if all(abs(v) <= LONG for v in x.flat) else x


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ROUND = """
a{i} AS MATERIALIZED (
  SELECT v.n, v.x, list_sort(list_transform(c.c, lambda k, i: {{'d': list_sum(list_transform(range(1, 65), lambda j: (v.x[j] - k[j]) * (v.x[j] - k[j])))::BIGINT, 'k': i}}))[1] AS b
  FROM v, c{i} c)"""
_MEANS = """,
s{i} AS (SELECT b.k AS k, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, 65) t(j) GROUP BY ALL),
m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS m FROM s{i} GROUP BY k),
c{n} AS MATERIALIZED (SELECT list_transform(c.c, lambda o, i: coalesce(m[i], o)) AS c FROM c{i} c, (SELECT map(list(k), list(m)) AS m FROM m{i}))"""

QUERIES = {"op12_centroids": op12_centroids}
SQL = {
    "op12_centroids": """
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = 64),
v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda y: floor(1024 * y::DOUBLE)::BIGINT) AS x FROM kept),
c0 AS MATERIALIZED (SELECT list(x ORDER BY h, x) AS c FROM (SELECT x, sha256('3:' || vec_id) AS h FROM v ORDER BY h, x LIMIT 8)),"""
    + ",".join(_ROUND.format(i=i) + (_MEANS.format(i=i, n=i + 1) if i < 10 else "") for i in range(11))
    + """
SELECT v.vec_id, (b.k - 1)::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.k))::BIGINT AS cluster_inertia,
  (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c[b.k], ',')) AS centroid_sha256
FROM a10 a JOIN v ON v.n = a.n, c10 c
"""
}
