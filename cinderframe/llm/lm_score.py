"""Language-model scores from a hierarchical Pitman-Yor model with sampled seating.

A text is its words, each with a space behind it, and one end; the model predicts it byte by byte. Every context of up
to ORDER bytes, also across the edges of words, has a restaurant whose parent is that of the context without its first
byte; the parent of the empty context is the uniform distribution. A word's probability is the product of those of its
bytes, so words that training never saw are spelt.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cinderframe.llm._bytes import Words, blocks, byte_class, mix, release
from cinderframe.llm._frames import Scratch
from cinderframe.llm._seating import Hierarchy, _distinct, sample_parameters

SPACE_WORDS = byte_class(r"[^\x20\x09-\x0D]")
#: Bytes of context; a run of ORDER + 1 bytes is one number.
ORDER = 6
#: Signs that no word holds: behind a word, at the end of a text, before a text. Symbols that can follow: 250 bytes, space and end.
SPACE, END, START, SYMBOLS = b" ", b"\r", b"\t", 252
#: Contexts of fewer bytes are sampled in one place: at most 256 * 256 dishes, whatever the corpus.
SHARED = 2
#: Bytes of text after which a task begins a new chunk, bytes looked up at once, entries merged at once, and keys sorted at once.
CHUNK_BYTES, STEP_BYTES, MERGE, SORT = 16 << 20, 1 << 20, 700_000, 2 << 20
#: The hash that stands for the end in the table of words.
END_HASH = 0


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text is 2 modulo 7. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def symbols(text: bytes) -> bytes:
    """A text as the model reads it: lower-cased (A-Z) words, a space behind each, and the end."""
    words = text.lower().split()
    return SPACE.join(words) + SPACE * bool(words) + END


def run_keys(texts: list[bytes], order: int) -> np.ndarray:
    """For every symbol of texts made by symbols(): `order` symbols before it with it as one number."""
    a = np.frombuffer(b"".join([*(START * order + x for x in texts), START * 7]), np.uint8)  # 7 more: 8 bytes can be read anywhere
    n = max(0, len(a) - 7 - order)
    key = np.ndarray(n, ">u8", a, strides=(1,)).astype(np.uint64)
    key >>= np.uint64(8 * (7 - order))
    return key[a[order : n + order] != START[0]]


def runs(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and run of every symbol."""
    return np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts))), run_keys(texts, order)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every word and every end."""
    w = Words(texts, SPACE_WORDS)
    return np.concatenate((w.doc, np.arange(len(texts)))), np.concatenate((w.hash, np.full(len(texts), END_HASH, np.uint64)))


def tally(keys: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their c. The sort is fast where the keys are a few ordered runs."""
    order = np.argsort(keys, kind="stable")
    keys, c = keys[order], c[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.add.reduceat(c, at) if len(at) else c


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each occurs; sorting alone, here in place, is much faster than sorting with places."""
    keys.sort()
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[at], np.diff(np.append(at, len(keys)))


def pack(x: np.ndarray) -> bytes:
    """Numbers of 8 or 4 bytes as compressed planes of bytes; rising 64-bit keys by their differences."""
    if x.dtype == np.uint64:
        x = np.diff(x, prepend=np.uint64(0))
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T), codec="zstd", asbytes=True) if len(x) else b""


def unpack(data: bytes, n: int, kind: type) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x, dtype=np.uint64) if kind is np.uint64 else x


class _Counts:
    """Keys with sums, merged as they come."""

    def __init__(self) -> None:
        self.keys, self.c, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        self.seen: tuple[list, list] = ([], [])

    def see(self, keys: np.ndarray, count: bool) -> None:
        """Keys in any order, as often as they occur; without count they add nothing to the sums."""
        self.seen[count].append(keys)
        if sum(len(k) for x in self.seen for k in x) > SORT:
            self._sorted()

    def _sorted(self) -> None:
        for times, x in enumerate(self.seen):
            if x:
                keys, n = counted(np.concatenate(x))
                x.clear()
                self.add(keys, n * times)

    def add(self, keys: np.ndarray, c: np.ndarray) -> None:
        """Distinct keys in order."""
        self.new.append((keys, c))
        if sum(len(k) for k, _ in self.new) > MERGE:
            self._merge()

    def _merge(self) -> None:
        if self.new:
            self.keys, self.c = tally(*(np.concatenate(x) for x in zip((self.keys, self.c), *self.new, strict=True)))
            self.new.clear()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        self._sorted()
        self._merge()
        return self.keys, self.c


def _shards_of(keys: np.ndarray, kind: int, shards: int) -> np.ndarray:
    """Runs go by the last SHARED bytes of context, so that all longer contexts that share a parent lie together; words by hash."""
    return (mix((keys >> np.uint64(8)) & np.uint64((1 << 8 * SHARED) - 1) if kind == RUNS else keys) % np.uint64(shards)).astype(np.int32)


#: Kinds of rows.
RUNS, WORDS, TEXT = 0, 1, 2


def _rows(size: int, schema: T.StructType, id_type: pa.DataType, **made) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "shard": pa.int32(), "chunk": pa.int64(), "n": pa.int64(), "keys": pa.binary(), "c": pa.binary(), "text": pa.binary(), "ids": pa.list_(id_type), "held": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int32()), "v": pa.int64()}
    names = schema.names
    arrays = [pa.nulls(size, kinds[x]) if x not in made else made[x] if isinstance(made[x], pa.Array) else pa.array(made[x] if isinstance(made[x], list) else [made[x]] * size, kinds[x]) for x in names]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _count(shards: int, order: int, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of texts as rows: the texts, step by step, and for each shard the distinct runs, and words, with their counts in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        counts, size, id_type = (_Counts(), _Counts()), 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in (RUNS, WORDS):
                keys, c = counts[kind].merged()
                own = _shards_of(keys, kind, shards)
                by = np.argsort(own.astype(np.uint16) if shards <= 1 << 16 else own, kind="stable")  # a radix sort
                keys, c, own = keys[by], c[by], own[by]
                at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                parts = list(zip(at, np.append(at[1:], len(own)), strict=True))
                yield _rows(len(at), schema, id_type, kind=kind, chunk=chunk, shard=own[at].tolist(), n=[int(b - a) for a, b in parts], keys=[pack(keys[a:b]) for a, b in parts], c=[pack(c[a:b]) for a, b in parts])

        for batch, raw in blocks(batches, limit=STEP_BYTES):
            new = [symbols(x) for x in raw]
            for held in (True, False):
                some = [x for x, h in zip(new, batch.column("held_out").to_pylist(), strict=True) if h == held]
                if some:
                    counts[RUNS].see(run_keys(some, order), not held)
                    counts[WORDS].see(words_of(some)[1], not held)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            lengths = pa.array([len(x) for x in new], pa.int32())
            n, id_type = sum(map(len, new)), batch.column("id").type
            yield _rows(1, schema, id_type, kind=TEXT, chunk=chunk, n=n, text=[pa.Codec("zstd", compression_level=6).compress(b"".join(new), asbytes=True)], ids=one(batch.column("id")), held=one(batch.column("held_out")), lengths=one(lengths))
            size += n
            if size >= CHUNK_BYTES:
                yield from flush()
                chunk, size, counts = chunk + 1, 0, (_Counts(), _Counts())
                release()
        if size:
            yield from flush()
            counts = ()
            release()

    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows in order of shard, shard by shard."""
    from itertools import groupby

    def rows() -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from batch.slice(i, 1).to_pylist()
        release()

    return groupby(rows(), lambda row: row["shard"])


def _merge(schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each shard: the sums over all chunks; n is their number, v that of keys with customers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            counts = _Counts()
            for row in rows:
                counts.add(unpack(row["keys"], row["n"], np.uint64), unpack(row["c"], row["n"], np.int64))
            keys, c = counts.merged()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "n": len(keys), "keys": pack(keys), "c": pack(c), "v": int((c > 0).sum()), "total": int(c.sum())}], schema=_arrow(schema))

    return run


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _fit(schema: T.StructType, order: int, last: bool, top: np.ndarray, parameters: list[tuple[float, float]], seed: list[int], sweeps: int, burn_in: int, groups: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sample the restaurants of every shard under the probabilities behind one byte (top, by two bytes).

    At last: a row of the shard's keys and the logs of their probabilities. Before: the customers that the shard
    sends to the dishes behind one byte, and the evidence for each length's discount and strength.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            row = next(rows)
            keys, c = unpack(row["keys"], row["n"], np.uint64), unpack(row["c"], row["n"], np.int64)
            rng = np.random.default_rng([*seed, shard])
            model = Hierarchy(keys, c, SHARED, order, parameters)
            p = model.run(top[model.roots.astype(np.int64)], sweeps, burn_in, groups, rng)
            if last:
                made = [{"shard": shard, "n": len(keys), "keys": pack(keys), "c": pack(np.log10(p).astype(np.float32))}]
            else:
                made = [{"dish": int(k), "sent": int(n)} for k, n in zip(model.roots, model.sent(), strict=True) if n]
                made += [{"level": SHARED + k, "evidence": level.evidence(rng).tolist()} for k, level in enumerate(model.levels)]
            yield pa.RecordBatch.from_pylist(made, schema=_arrow(schema))

    return run


def _answer(kind: type, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Behind a shard's row of values (without chunk) come the chunks' rows of keys: each gets its keys' values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            first = next(rows)
            known, value = unpack(first["keys"], first["n"], np.uint64), unpack(first["c"], first["n"], kind)
            for row in rows:
                at = np.searchsorted(known, unpack(row["keys"], row["n"], np.uint64))
                yield pa.RecordBatch.from_pylist([{"kind": row["kind"], "chunk": row["chunk"], "n": row["n"], "keys": row["keys"], "c": pack(value[at])}], schema=_arrow(schema))

    return run


def _score(order: int, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunk by chunk, first the values of all its runs and words, then its texts, whose values are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: tuple[list, list] = ([], [])
        tables: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                kind, n = row.column("kind")[0].as_py(), row.column("n")[0].as_py()
                if kind != TEXT:
                    if tables:
                        tables.clear()
                        release()
                    got[kind].append((unpack(row.column("keys")[0].as_py(), n, np.uint64), unpack(row.column("c")[0].as_py(), n, (np.float32, np.int64)[kind])))
                    continue
                for parts in got if not tables else ():
                    keys, values = (np.concatenate(x) for x in zip(*parts, strict=True))
                    parts.clear()
                    by = np.argsort(keys)
                    tables.append((keys[by], values[by]))
                yield from _added(row, tables, n, order, schema)
        tables.clear()
        release()

    return run


def _added(row: pa.RecordBatch, tables: list[tuple[np.ndarray, np.ndarray]], n: int, order: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    ids, held = (row.column(x).flatten() for x in ("ids", "held"))
    ends = np.cumsum(row.column("lengths").flatten().to_numpy())
    raw = memoryview(pa.decompress(row.column("text")[0].as_py(), n, codec="zstd", asbytes=True))
    a = 0
    while a < len(ends):
        start = int(ends[a - 1]) if a else 0
        b = min(a + 256, max(a + 1, int(np.searchsorted(ends, start + STEP_BYTES, "right"))))
        texts = [bytes(raw[int(ends[k - 1]) if k else 0 : int(ends[k])]) for k in range(a, b)]
        doc, keys = runs(texts, order)
        keys, times = counted((keys << np.uint64(8)) | doc.astype(np.uint64))  # runs have 7 bytes, texts a number below 256
        own = keys >> np.uint64(8)
        at, which = _distinct(own)
        logs = tables[RUNS][1][np.searchsorted(tables[RUNS][0], own[at])].astype(float)
        sums = {"score": np.bincount((keys & np.uint64(255)).astype(np.int64), logs[which] * times, b - a)}
        doc, keys = words_of(texts)
        own, which = np.unique(keys, return_inverse=True)
        c = tables[WORDS][1][np.searchsorted(tables[WORDS][0], own)]
        sums |= {"n_tokens": np.bincount(doc, minlength=b - a), "n_known": np.bincount(doc, (c > 0)[which], b - a).astype(np.int64), "logs": np.bincount(doc, np.log10(c + 1.0)[which], b - a)}
        made = {"id": ids.slice(a, b - a), "held_out": held.slice(a, b - a)} | {k: pa.array(x) for k, x in sums.items()}
        yield pa.RecordBatch.from_arrays([made[x] for x in schema.names], names=schema.names)
        a = b


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 3, burn_in: int = 1, groups: int = 16, rounds: int = 1, parameters: tuple[float, float] = (0.5, 1.0), sampled: bool = True, order: int = ORDER, seed: int = 0) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Words are lower-cased (A-Z) and split at ASCII white space; one end follows. Training uses documents that
    are not held out. base_score is add-one unigram, score the log10 probability of the whole text under the
    model: predictive probabilities averaged over the sweeps after burn_in; perplexity is
    10 ** (-score / n_tokens).

    Tasks turn chunks of documents into distinct runs of order + 1 bytes with counts (order is 2 to 6). All restaurants whose
    contexts end in the same SHARED bytes lie in one shard, where Gibbs sweeps move customers: one leaves and
    sits down given all others, tables that open or close change the parents' customers. In a sweep every
    customer of every dish moves once: one at a time in a dish of up to `groups` (2 at least) customers, in a larger
    one in so many groups, whose customers leave and sit down side by side; dishes move side by side, too.
    The few restaurants behind one byte or none are sampled from the shards' tables. In each of the rounds
    before the last, of one sweep, discounts and strengths of all lengths (at first `parameters`) are sampled
    from the seating, unless sampled is false. Chunks then get the probabilities of their runs back and add them up over their texts. Draws
    depend on seed, round and shard alone: partitions, retries and the order of rows change nothing.

    Null and empty texts are one end. Repeated rows are scored each for itself and count each in training. A
    null id is not held out. Other columns are not read. Empty in, empty out.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "score")
    source = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, math.ceil(3 * math.sqrt(size / CHUNK_BYTES)))  # distinct runs grow slower than the text
    plain = T.StructType.fromDDL("kind int, shard int, chunk long, n long, keys binary, c binary, text binary")
    kinds = T.StructType([*plain, T.StructField("ids", T.ArrayType(source.schema["id"].dataType)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.IntegerType()))])
    chunked = scratch.cut(source.mapInArrow(_count(shards, order, kinds), kinds))

    def dealt(rows: DataFrame, by: str, then: str, parts: int = shards) -> DataFrame:
        return rows.repartitionByRange(parts, by).sortWithinPartitions(by, F.col(then).asc_nulls_first())

    sums = T.StructType.fromDDL("shard int, n long, keys binary, c binary, v long, total long")
    asked = {k: chunked.filter(F.col("kind") == k).select("kind", "shard", "chunk", "n", "keys", "c") for k in (RUNS, WORDS)}
    merged = {k: scratch.cut(dealt(asked[k], "shard", "chunk").mapInArrow(_merge(sums), sums)) for k in (RUNS, WORDS)}
    total = merged[WORDS].agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()

    values = [parameters] * (order + 1)
    pairs, base = np.arange(1 << 16, dtype=np.uint64), np.full(256, 1 / SYMBOLS)
    top = np.full(1 << 16, 1 / SYMBOLS)
    found = T.StructType.fromDDL("dish long, sent long, level int, evidence array<double>")
    each = dealt(merged[RUNS].select("shard", "n", "keys", "c"), "shard", "n")
    for r in range(rounds):
        out = scratch.cut(each.mapInArrow(_fit(found, order, False, top, values, [seed, r], 1, 0, groups), found))
        sent = np.zeros(1 << 16, np.int64)
        for x in out.filter("dish is not null").groupBy("dish").agg(F.sum("sent").alias("sent")).collect():  # at most 256 * 256 rows
            sent[x.dish] = x.sent
        rng = np.random.default_rng([seed, r])
        few = Hierarchy(pairs, sent, 0, SHARED - 1, values)
        top = few.run(base[few.roots.astype(np.int64)], sweeps, burn_in, groups, rng)
        evidence = {x.level: np.array(x.e) for x in out.filter("level is not null").groupBy("level").agg(F.array(*[F.sum(F.col("evidence")[i]) for i in range(4)]).alias("e")).collect()}
        evidence |= {k: level.evidence(rng) for k, level in enumerate(few.levels)}
        if sampled:
            values = [sample_parameters(evidence.get(k, np.zeros(4)), rng) for k in range(order + 1)]
        scratch.drop(out)

    answers = T.StructType.fromDDL("kind int, chunk long, n long, keys binary, c binary")
    one = T.StructType.fromDDL("shard int, n long, keys binary, c binary")
    model = scratch.cut(each.mapInArrow(_fit(one, order, True, top, values, [seed, rounds], sweeps, burn_in, groups), one))
    told = []
    for k, known, kind in ((RUNS, model, np.float32), (WORDS, merged[WORDS], np.int64)):
        first = known.select(F.lit(k).alias("kind"), "shard", F.lit(None).cast("long").alias("chunk"), "n", "keys", "c")
        told.append(dealt(first.union(asked[k].withColumn("c", F.lit(None).cast("binary"))), "shard", "chunk").mapInArrow(_answer(kind, answers), answers))
    rows = told[0].unionByName(told[1]).unionByName(chunked.filter(F.col("kind") == TEXT).drop("shard", "keys", "c"), allowMissingColumns=True)
    done = T.StructType([source.schema["id"], *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, logs double, score double")])
    out = dealt(rows, "chunk", "kind", max(shards, 3 * math.ceil(size / CHUNK_BYTES))).mapInArrow(_score(order, done), done)
    base_score = F.col("logs") - F.col("n_tokens") * F.lit(math.log10(total.n + total.v + 1))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total.n).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_lm_score": op8_lm_score}
SQL: dict[str, str] = {}
