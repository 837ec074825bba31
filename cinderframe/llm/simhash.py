"""SimHash near-duplicate groups: fingerprints meet in a grid of their segments' bit counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cinderframe.llm._bytes import blocks, byte_class, release
from cinderframe.llm._frames import Scratch
from cinderframe.llm.near_dedup import components

SPACE = ~byte_class(r"[^\x20\x09-\x0D]")
BITS = 64
#: Shingle hashes whose bits are counted at once: 4 MB of bits.
STEP = 1 << 16
#: ASCII white space becomes one space, A-Z become small.
_PLAIN = bytes(32 if s else b for b, s in zip(bytes(range(256)).lower(), SPACE, strict=True))


def fingerprint(text: bytes, words: int) -> int:
    """The SimHash of one text: bit i is set if it is set in over half of its shingles' XXH64 hashes, repeats counted."""
    tokens = [w for w in text.translate(_PLAIN).split(b" ") if w]
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    ones = np.zeros(BITS, np.int64)
    hashes = (xxhash.xxh64_intdigest(line[a:b], 42) for a, b in spans)
    for at in range(0, n, STEP):
        h = np.fromiter(hashes, "<u8", min(STEP, n - at))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(BITS) if 2 * ones[i] > n)


def _fingerprints(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            prints = np.array([fingerprint(t, words) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "print"])
        release()

    return run


def _counts(x: Column) -> Column:
    """The bit count of each segment of four bits, in the segment's own place: sixteen numbers from 0 to 4 in a long."""
    lowest = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(x, i).bitwiseAND(lowest) for i in range(1, 4)), x.bitwiseAND(lowest))


def _cells(prints: DataFrame) -> DataFrame:
    """(cell, step, print): the grid cell of a fingerprint's bit counts and those one step beside it.

    Two count vectors at Manhattan distance 2 or less have a cell between them that is at most one step from each.
    """
    own = prints.select("print", _counts(F.col("print")).alias("own"))
    steps = [F.struct(F.lit(0).alias("step"), F.col("own").alias("cell"))]
    for i in range(16):
        count = F.shiftrightunsigned("own", 4 * i).bitwiseAND(F.lit(15))
        unit = F.shiftleft(F.lit(1).cast("long"), 4 * i)
        steps += [F.when(count < 4, F.struct(F.lit(i + 1).alias("step"), (F.col("own") + unit).alias("cell"))), F.when(count > 0, F.struct(F.lit(-i - 1).alias("step"), (F.col("own") - unit).alias("cell")))]
    return own.select("print", F.explode(F.filter(F.array(*steps), lambda s: s.isNotNull())).alias("s")).select("s.cell", "s.step", "print")


def links(prints: DataFrame, scratch: Scratch, crowd: int = 32) -> DataFrame:
    """(a, b) that connect distinct fingerprints (print) wherever a chain of differences of at most two bits does.

    Segment bit counts differ in sum by no more than the fingerprints differ in bits (Manhattan distance as a lower
    bound), so pairs are sought in cells of the grid of counts and verified bit by bit. In a cell with more than
    `crowd` fingerprints the segments are cut to single bits: there a cell is a fingerprint and holds only what
    differs from it in one bit, at most 65 of them, which are all linked with each other, and the smallest stands
    for all. So the work grows with the number of fingerprints, however many are alike.
    """
    cells = scratch.cut(_cells(prints))
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    met = scratch.cut(cells.join(shared, "cell"))
    scratch.drop(cells)
    some = met.filter(F.col("n") <= crowd)
    left, right = (some.select("cell", F.col("step").alias(f"step_{s}"), F.col("print").alias(s)) for s in "ab")
    # fingerprints of one cell meet there and in every cell beside it by the same step: once is enough
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2) & ((F.col("step_a") != F.col("step_b")) | (F.col("step_a") == 0))
    pairs = left.join(right, "cell").filter(close).select("a", "b")
    crowded = met.filter(F.col("n") > crowd).select("print").distinct()
    near = F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)])
    balls = crowded.select("print", F.explode(near).alias("centre")).groupBy("centre").agg(F.sort_array(F.collect_list("print")).alias("all")).filter(F.size("all") > 1)
    stars = balls.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", F.lit(2), F.size("all") - 1)).alias("b"))
    out = scratch.cut(pairs.union(stars).distinct())
    scratch.drop(met)
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, hot: int = 1000) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id of every row.

    Texts are lower-cased (A-Z) and split at ASCII white space. Each shingle of `words` words (of fewer, the whole
    sequence), repeats included, is hashed with XXH64 (seed 42); a fingerprint's bit is 1 if it is set in over half
    of the hashes. Two rows are linked if their fingerprints differ in two bits or fewer; component_id is the
    smallest id in reach, itself included.

    Rows of one fingerprint are one class, which is made before anything is compared; so a third of all rows in one
    class costs no more than one. Classes with over a `hot`-th of all rows, at most `hot` of them, get their
    component by a broadcast, all others by a join.

    A null, empty or wordless text has fingerprint zero and is linked like any other. A null id is nobody's
    smallest; where all ids in reach are null, component_id is null. Repeated rows get equal results; other columns
    are not read; an empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "simhash")
    id_type = docs.schema[id_col].dataType
    kind = T.StructType([T.StructField("id", id_type), T.StructField("print", T.LongType())])
    rows = scratch.cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(_fingerprints(words), kind))
    classes = scratch.cut(rows.groupBy("print").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    edges = links(classes.select("print"), scratch)
    linked = components(edges, scratch)
    named = classes.join(linked, F.col("print") == F.col("node"), "left").select("print", "low", "n", F.coalesce("label", "print").alias("label"))
    named = scratch.cut(named)
    scratch.drop(edges, classes)
    least = named.groupBy("label").agg(F.min("low").alias("component_id"))
    whole = scratch.cut(named.join(least, "label").select("print", "n", "component_id"))
    scratch.drop(named)
    limit = rows.count() // hot
    many = F.broadcast(whole.filter(F.col("n") > limit).select("print", F.struct("component_id").alias("c")))
    rows = rows.join(many, "print", "left")
    found = rows.filter("c is not null").select("id", "print", "c.component_id")
    rest = rows.filter("c is null").select("id", "print").join(whole.filter(F.col("n") <= limit).select("print", "component_id"), "print")
    return found.union(rest.select("id", "print", "component_id")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3)


QUERIES = {"op11_simhash": op11_simhash}
#: SQL has no XXH64 of strings; tests hold the query against brute force.
SQL: dict[str, str] = {}
