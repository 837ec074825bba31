"""Cheapest repairs of conversations whose turns are blank, repeated, cut short or in an illegal order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cinderframe.llm._bytes import release
from cinderframe.llm._frames import Scratch

#: Rows of a conversation that are worked on together, as a power of two.
CHUNK_BITS = 16
FAR = 1 << 60
DELETE, RELABEL, ADD, CUT_SHORT = 2, 1, 5, 5
#: States of the pattern (s?(ua)+)?: nothing yet, system, user, assistant; the state each initial leads to.
STEPS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
ROLES = {"u": "user", "a": "assistant"}
ADDED = "uuau"  # the initial that can be added in each state
#: Cost and initials of the turns that must be added at the end, by state.
END_COST, END = (0, 2 * ADD, ADD, 0), ("", "ua", "a", "")
INITIALS, FAULTS = "sua?", ("none", "blank", "duplicate", "truncated")


@lru_cache(maxsize=None)
def _arcs(code: str) -> tuple[tuple[str, int, int, int], ...]:
    """(edit, state, next state, cost) of a row: D, K and R where they are allowed, in this order."""
    initial, fault = divmod(int(code, 16), 4)
    out = [("D", q, q, DELETE) for q in range(4)]
    if fault in (1, 2):
        return tuple(out)
    more = CUT_SHORT if fault == 3 else 0
    for edit, cost, letters in (("K", 0, INITIALS[initial]), ("R", RELABEL, "".join(ROLES).replace(INITIALS[initial], ""))):
        out += [(edit, q, STEPS[x][q], cost + more) for x in letters if x in STEPS for q in range(4) if STEPS[x][q] is not None]
    return tuple(out)


def _before_row(f: list[int]) -> list[int]:
    """Minimum costs once turns may have been added before the next row."""
    user = min(f[2], min(f[0], f[1], f[3]) + ADD)
    return [f[0], f[1], user, min(f[3], user + ADD)]


def _forward(shape: str, start: list[int]) -> tuple[list[list[int]], list[int]]:
    """Minimum cost of reaching each state before each row (added turns included), and behind the last."""
    f, out = list(start), []
    for code in shape:
        f = _before_row(f)
        out.append(f)
        new = [FAR] * 4
        for _, q, to, cost in _arcs(code):
            new[to] = min(new[to], f[q] + cost)
        f = new
    return out, f


def _backward(shape: str, end: list[int]) -> list[list[int]]:
    """Minimum cost from each state before each row to the end of the conversation, and from behind the last row."""
    b, out = list(end), [list(end)]
    for code in reversed(shape):
        new = [FAR] * 4
        for _, q, to, cost in _arcs(code):
            new[q] = min(new[q], cost + b[to])
        new[2] = min(new[2], ADD + new[3])
        b = [min(new[0], ADD + new[2]), min(new[1], ADD + new[2]), new[2], min(new[3], ADD + new[2])]
        out.append(b)
    return out[::-1]


def _least_edits(shape: str, start: tuple[int, ...], end: tuple[int, ...], best: int) -> list[str | None]:
    """For each state at the chunk's start, the ASCII-least edits among the cheapest; None where no cheapest repair passes.

    An arc is tight if the forward cost of its tail, its own cost and the backward cost of its head add up to the
    optimum. From the set of states reached so far, the least letter on any tight arc is taken, and all tight arcs
    with it lead to the next set.
    """
    ahead, behind = _forward(shape, start)[0], _backward(shape, end)
    out: list[str | None] = []
    for first in range(4):
        if start[first] + behind[0][first] != best:
            out.append(None)
            continue
        frontier, edits, i = {first}, [], 0
        while i < len(shape):
            f, tight = ahead[i], {}
            for q in frontier:
                to = STEPS[ADDED[q]][q]
                if f[q] + ADD + behind[i][to] == best:
                    tight.setdefault("I", set()).add(to)
            for edit, q, to, cost in _arcs(shape[i]):
                if q in frontier and f[q] + cost + behind[i + 1][to] == best:
                    tight.setdefault(edit, set()).add(to)
            least = min(tight)
            edits.append(least)
            frontier, i = tight[least], i + (least != "I")
        out.append("".join(edits))
    return out


@lru_cache(maxsize=1 << 14)
def _short_edits(shape: str, start: tuple[int, ...], end: tuple[int, ...], best: int) -> list[str | None]:
    return _least_edits(shape, start, end, best)


@lru_cache(maxsize=1 << 14)
def _costs(shape: str) -> list[int]:
    """Minimum cost from each state at a chunk's start to each behind its last row, row by row of a 4 x 4 matrix."""
    return [c for q in range(4) for c in _forward(shape, [0 if k == q else FAR for k in range(4)])[1]]


def _illegal(shape: str) -> int:
    initials = [INITIALS[int(c, 16) // 4] for c in shape]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _rows(make: Callable[[dict], Iterator[dict]], schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows from rows, one dict at a time, in batches."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_pylist([r for row in batch.slice(at, 256).to_pylist() for r in make(row)], schema=arrow)
        release()

    return run


def _measure(row: dict) -> Iterator[dict]:
    shape = row["shape"]
    yield {"conv": row["conv"], "p": row["p"], "costs": _costs(shape) if len(shape) < 64 else _costs.__wrapped__(shape), "illegal": _illegal(shape), "ends": shape[0] + shape[-1]}


def _fold(row: dict) -> Iterator[dict]:
    """Costs at the start and behind the end of every chunk of a conversation, from the chunks' cost matrices."""
    chunks = row["chunks"]
    starts, f = [], [0, FAR, FAR, FAR]
    for c in chunks:
        starts.append(f)
        f = [min(f[q] + c["costs"][4 * q + to] for q in range(4)) for to in range(4)]
    best = min(x + y for x, y in zip(f, END_COST, strict=True))
    ends, b = [], list(END_COST)
    for c in reversed(chunks):
        ends.append(b)
        b = [min(c["costs"][4 * q + to] + b[to] for to in range(4)) for q in range(4)]
    seams = _illegal_seams([c["ends"] for c in chunks])
    for c, start, end in zip(chunks, starts, reversed(ends), strict=True):
        yield {"p": c["p"], "start": start, "end": end, "cost": best, "illegal": sum(c["illegal"] for c in chunks) + seams}


def _illegal_seams(ends: list[str]) -> int:
    return sum(_illegal(a[-1] + b[0]) for a, b in zip(ends, ends[1:]))


def _choose(row: dict) -> Iterator[dict]:
    shape, start, end = row["shape"], tuple(row["start"]), tuple(row["end"])
    edits = (_short_edits if len(shape) < 64 else _least_edits)(shape, start, end, row["cost"])
    yield {"conv": row["conv"], "p": row["p"], "edits": edits, "cost": row["cost"], "illegal": row["illegal"]}


_START = object()


def _apply(schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edited rows, from rows in order with each chunk's edits in front of it; only the state of one conversation is held."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, edits, at, chunk = _START, 0, "", 0, None
        out: list[dict] = []

        def emit(edit: str, role: str, text: str, turn: int | None) -> None:
            out.append({"conv": conv, "edit": edit, "role": role, "text": text, "turn": turn, "cost": chunk["cost"], "illegal": chunk["illegal"]})

        def finish() -> None:
            if conv is not _START:
                for x in END[state]:
                    emit("I", ROLES[x], "", None)

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                for row in batch.slice(begin, 256).to_pylist():
                    if conv is _START or row["conv"] != conv:
                        finish()
                        conv, state = row["conv"], 0
                    if row["kind"] == 0:
                        edits, at, chunk = row["edits"][state], 0, row
                        continue
                    while edits[at] == "I":
                        emit("I", ROLES[ADDED[state]], "", None)
                        state, at = STEPS[ADDED[state]][state], at + 1
                    edit, at = edits[at], at + 1
                    role = ROLES[ADDED[state]] if edit == "R" else row["role"]
                    if edit != "D":
                        state = STEPS[role[0]][state]
                    emit(edit, role, row["text"], row["turn"])
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        finish()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)
        release()

    return run


def _digest(schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per conversation from its edited rows, which follow each other."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, last, audit, digest, lines = _START, None, [], None, 0
        out: list[dict] = []

        def finish() -> None:
            if conv is not _START:
                out.append({"conv": conv, "cost": last["cost"], "illegal": last["illegal"], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()})

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                for row in batch.slice(begin, 256).to_pylist():
                    if conv is _START or row["conv"] != conv:
                        finish()
                        conv, audit, digest, lines = row["conv"], [], hashlib.sha256(), 0
                    last = row
                    audit.append(row["edit"])
                    if row["edit"] != "D":
                        digest.update(f"{chr(10) if lines else ''}{row['role']}:{row['text']}".encode())
                        lines += 1
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out.clear()
        finish()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)
        release()

    return run


def _plain(c: str) -> Column:
    """A column as text; null is one space."""
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with the faults that crc32 of `conv_id:turn` modulo 20 chooses; null text and role are one space.

    0 drops the row, 1 empties its text, 2 removes its stops, 3 repeats it, 4 makes it the user's.
    """
    fault = F.crc32(F.concat(_plain("conv_id"), F.lit(":"), _plain("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(_plain("text"), "[.!?]", "")).otherwise(_plain("text"))
    out = turns.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(_plain("role")).alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0")
    return out.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("fault", "copy")


def inspected(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The turns in order (p, conv, turn, role, text) and the code of each (p, conv, code): initial and first fault.

    Turns are range-sorted, so one conversation may lie in many partitions. A row is a duplicate if it is not the
    first of its conversation, role and text, which one aggregation finds, whatever the number of copies.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "key", "copy"]
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("key"), F.monotonically_increasing_id().alias("copy"))
    rows = scratch.cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("p"), "conv", "turn", "role", "text", "key"))
    first = rows.groupBy("conv", "role", "key").agg(F.min("p").alias("p")).select("p", F.lit(True).alias("first"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    short = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    marks = rows.select("p", "conv", F.substring("role", 1, 1).alias("x"), blank.alias("blank"), short.alias("short")).join(first, "p", "left")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("short"), 3).otherwise(0)
    initial = F.when(F.col("x") == "s", 0).when(F.col("x") == "u", 4).when(F.col("x") == "a", 8).otherwise(12)
    codes = marks.select("p", "conv", (initial + fault).alias("code"))
    return rows.drop("key"), scratch.cut(codes)


def repaired_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edited turns of every conversation, and (conv, blank, duplicate, truncated) counts of faults.

    turns holds conv_id, turn, role and text, none of the last two null. A conversation's rows are taken by turn,
    nulls first, then role and text digest. Its cheapest edits that give the initials of roles the form (s?(ua)+)?
    are found, of equally cheap ones the least in ASCII order: Keep (0), Rerole to user or assistant (1), Delete
    (2, required for blank and duplicate rows), Insert an empty turn (5); a kept row that is cut short adds 5. A
    role without an initial can't be kept. Edited rows are (conv, edit, role, text, turn, cost, illegal), each
    conversation's in one partition and in order, deleted rows included.

    Rows are cut into chunks of 65,536. Each chunk is a matrix of minimum costs between the four states of the
    pattern; a fold over a conversation's matrices gives the forward costs at each chunk's start and the backward
    costs at its end, and with these each chunk finds its tight arcs by itself. Applying the edits streams a
    conversation in order through one task, as its digest must; nothing but one state is held there.
    """
    scratch = Scratch(turns.sparkSession, "turns")
    conv = T.StructField("conv", turns.schema["conv_id"].dataType)
    p, costs = T.StructField("p", T.LongType()), T.ArrayType(T.LongType())
    cost, illegal = T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType())
    rows, codes = inspected(turns, scratch)
    fault = F.col("code") % 4
    counts = codes.groupBy("conv").agg(*[F.count(F.when(fault == i, 1)).alias(FAULTS[i]) for i in (1, 2, 3)])
    digit = F.substring(F.lit("0123456789abcdef"), F.col("code") + 1, F.lit(1))
    chunks = codes.groupBy("conv", F.shiftright("p", CHUNK_BITS).alias("chunk")).agg(F.min("p").alias("p"), F.sort_array(F.collect_list(F.struct("p", digit.alias("digit")))).alias("rows"))
    shapes = scratch.cut(chunks.select("conv", "p", F.array_join(F.transform("rows", lambda r: r["digit"]), "").alias("shape")))
    kind = T.StructType([conv, p, T.StructField("costs", costs), illegal, T.StructField("ends", T.StringType())])
    measured = shapes.mapInArrow(_rows(_measure, kind), kind).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("p", "costs", "illegal", "ends"))).alias("chunks"))
    kind = T.StructType([p, T.StructField("start", costs), T.StructField("end", costs), cost, illegal])
    folded = measured.mapInArrow(_rows(_fold, kind), kind)
    kind = T.StructType([conv, p, T.StructField("edits", T.ArrayType(T.StringType())), cost, illegal])
    chosen = shapes.join(folded, "p").mapInArrow(_rows(_choose, kind), kind)
    both = rows.withColumn("kind", F.lit(1)).unionByName(chosen.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    schema = T.StructType([conv, *[T.StructField(c, T.StringType()) for c in ("edit", "role", "text")], T.StructField("turn", turns.schema["turn"].dataType), cost, illegal])
    edited = both.repartition("conv").sortWithinPartitions("conv", "p", "kind").mapInArrow(_apply(schema), schema)
    return edited, counts


def repair_report(turns: DataFrame, originals: DataFrame) -> DataFrame:
    """What was wrong with each conversation of originals (conv_id) and how it is repaired, one row each.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A null conv_id is a
    conversation; one without turns has zeros, an empty audit and the digest of no bytes. A null turn is before all
    others and leaves gaps alone. Repeated rows are duplicates; other columns are not read; empty tables give no rows.
    """
    edited, counts = repaired_turns(turns)
    id_type = turns.schema["conv_id"].dataType
    kind = T.StructType([T.StructField("conv", id_type), T.StructField("cost", T.LongType()), T.StructField("illegal", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    digests = edited.mapInArrow(_digest(kind), kind)
    # distinct turns are counted apart from ids, so a conversation's turns are added up in many tasks
    spans = turns.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1)).groupBy(F.col("conv_id").alias("conv")).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    out = originals.select("conv_id").distinct()
    for part in (spans, counts, digests):
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("conv")), "left").drop("conv")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(damaged(turns), turns)


def _sql_arcs() -> str:
    """(state, code, next state, cost, edits, lines in front, edit, new role): at most two added turns, then an edit of a row."""
    out = []
    for q in range(4):
        at, head, edits = q, "", ""
        for n in range(3):
            for code in range(16):
                for edit, a, to, cost in _arcs(f"{code:x}"):
                    if a == at:
                        role = ROLES[ADDED[at]] if edit == "R" else ""
                        out.append(f"({q},{code},{to},{n * ADD + cost},'{edits}{edit}','{head}','{edit}','{role}')")
            head, edits = f"{head}\n{ROLES[ADDED[at]]}:", edits + "I"
            at = STEPS[ADDED[at]][at]
    return ",".join(out)


QUERIES = {"op13_turn_repair": op13_turn_repair}
SQL = {
    "op13_turn_repair": r"""
WITH RECURSIVE
z AS MATERIALIZED (SELECT list(c ORDER BY b) AS z FROM (
  SELECT b, list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) t(b))),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
      lambda c, x: xor(c >> 8, z[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS k
  FROM conversations, z),
t AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, range(2) r(r) WHERE k <> 0 AND (r = 0 OR k = 3)),
o AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM t),
e AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS short, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS y
  FROM o),
f AS MATERIALIZED (
  SELECT *, CASE x WHEN 's' THEN 0 WHEN 'u' THEN 4 WHEN 'a' THEN 8 ELSE 12 END + CASE WHEN blank THEN 1 WHEN again THEN 2 WHEN short THEN 3 ELSE 0 END AS code FROM e),
a(q, code, nxt, cost, edits, head, edit, new) AS (VALUES """
    + _sql_arcs()
    + r"""),
b AS (
  SELECT g, n + 1 AS i, q, {'c': c, 'l': l, 't': t} AS v
  FROM (SELECT g, max(i) AS n FROM f GROUP BY g), (VALUES (0, 0, '', ''), (1, 10, 'II', E'\nuser:\nassistant:'), (2, 5, 'I', E'\nassistant:'), (3, 0, '', '')) s(q, c, l, t)
  UNION ALL
  SELECT f.g, f.i, a.q, min({'c': a.cost + v.c, 'l': a.edits || v.l,
    't': a.head || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN E'\n' || role || ':' || text ELSE E'\n' || new || ':' || text END || v.t})
  FROM b JOIN f ON f.g = b.g AND f.i = b.i - 1 JOIN a ON a.nxt = b.q AND a.code = f.code
  GROUP BY f.g, f.i, a.q),
s AS (
  SELECT g, any_value(conv_id) AS conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (code % 4 = 1) AS blank,
    count(*) FILTER (code % 4 = 2) AS duplicate, count(*) FILTER (code % 4 = 3) AS truncated, count(*) FILTER (y || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY g)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(v.c, 0)::BIGINT AS cost, coalesce(v.l, '') AS audit, sha256(coalesce(v.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv IS NOT DISTINCT FROM c.conv_id
LEFT JOIN b ON b.g = s.g AND b.i = 1 AND b.q = 0
""",
}
