"""Benchmark decontamination with a suffix array over the words of every shard of documents."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cinderframe.llm._bytes import Words, blocks, byte_class, mix, powers
from cinderframe.llm._frames import Scratch

LETTER_WORDS = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes of documents in a shard, but for a longer text or a larger test set; bytes of test text that one pass over the
#: documents holds in memory: more test text takes more passes.
SHARD_BYTES, PASS_BYTES = 2 << 20, 4 << 20
SPAN = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType()), T.StructField("n_words", T.LongType())]))


class SuffixArray:
    """All suffixes of some texts, by words, each up to the end of its text, in order of their first `depth` words or more.

    Words compare by their hashes, and a text's end is before all words. Built by doubling: suffixes ranked by their
    first k words are ranked by 2 k through the rank k words further on.
    """

    def __init__(self, texts: list[bytes], depth: int):
        self.words = Words(texts, LETTER_WORDS)
        self.hash, n = self.words.hash, len(self.words.hash)
        first = np.concatenate(([0], np.cumsum(self.words.counts)))
        self.begin, self.end = first[self.words.doc], first[self.words.doc + 1]
        up, self.down = powers(n + 1)
        self.run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=self.run[1:])
        rank, k = self._ranked(self.hash), 1
        while k < depth and n and rank.max() < n:
            later = np.minimum(np.arange(n) + k, n - 1)
            beyond = np.where(np.arange(n) + k < self.end, rank[later], 0)
            rank, k = self._ranked((rank * (n + 1) + beyond).astype(np.uint64)), 2 * k
        self.order = np.argsort(rank, kind="stable")

    @staticmethod
    def _ranked(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.cumsum(np.append(True, keys[order][1:] != keys[order][:-1])[: len(keys)])
        return rank

    def prefix(self, at: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hash of `length` words from each place; it says nothing about where they stand."""
        return (self.run[at + length] - self.run[at]) * self.down[at]

    def common(self, at: np.ndarray, other: SuffixArray, there: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words, `most` at most, are equal from each place here and there."""
        n = np.zeros(len(at), np.int64)
        step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
        while step:
            fits = np.flatnonzero(n + step <= most)
            a, b = at[fits] + n[fits], there[fits] + n[fits]
            n[fits[self.prefix(a, step) == other.prefix(b, step)]] += step
            step //= 2
        return n

    def bounds(self, other: SuffixArray, there: np.ndarray, length: np.ndarray, above: bool) -> np.ndarray:
        """Binary search: of each run of `length` words there, the first suffix here that is not before it, or, if above,
        the first that does not begin with it."""
        lo, hi = np.zeros(len(there), np.int64), np.full(len(there), len(self.order))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            p, t, m = self.order[mid], there[open_], length[open_]
            n = self.common(p, other, t, np.minimum(m, self.end[p] - p))
            more = n < np.minimum(m, self.end[p] - p)
            before = np.where(n == m, above, True)  # a suffix that ends inside the run is before it
            before[more] = self.hash[p[more] + n[more]] < other.hash[t[more] + n[more]]
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        return lo

    def longest(self, other: SuffixArray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place here, words) of the longest run that each suffix there shares with one here: a neighbour in the order."""
        rest = other.end[there] - there
        at = self.bounds(other, there, rest, False)
        best, size = np.zeros(len(there), np.int64), np.zeros(len(there), np.int64)
        for side in (at - 1, at):
            near = np.flatnonzero((side >= 0) & (side < len(self.order)))
            p = self.order[side[near]]
            n = self.common(p, other, there[near], np.minimum(rest[near], self.end[p] - p))
            better = n > size[near]
            best[near[better]], size[near[better]] = p[better], n[better]
        return best, size


class Tests:
    """The suffixes of some test items; equal windows are searched once and know the set of items that hold them."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.names, self.window = [name for name, _ in items], window
        texts = [text for _, text in items]
        self.bytes = sum(map(len, texts))
        self.array = SuffixArray(texts, window)
        a = self.array
        self.depth = int(a.words.counts.max(initial=1))
        length = np.minimum(a.words.counts[a.words.doc], window)
        at = np.flatnonzero(a.end - np.arange(len(a.hash)) >= length)
        keys = mix(a.prefix(at, length[at]) + length[at].astype(np.uint64))
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        self.at, self.length = at[first], length[at[first]]
        # windows with the same items share one set: (set, item) pairs, and where each set's begin
        pairs = np.unique(np.stack((which, a.words.doc[at])), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        starts = np.searchsorted(pairs[0], np.arange(len(first) + 1))
        sets: dict[bytes, int] = {}
        members: list[np.ndarray] = []
        self.set = np.zeros(len(first), np.int64)
        for w in range(len(first)):
            own = pairs[1][starts[w] : starts[w + 1]]
            if own.tobytes() not in sets:
                sets[own.tobytes()] = len(members)
                members.append(own)
            self.set[w] = sets[own.tobytes()]
        self.members = members

    def search(self, texts: list[bytes]) -> tuple[SuffixArray, np.ndarray, np.ndarray]:
        """A shard's suffix array, and every occurrence of a window in it: (word, window)."""
        shard = SuffixArray(texts, max(self.window, self.depth))
        lo = shard.bounds(self.array, self.at, self.length, False)
        n = shard.bounds(self.array, self.at, self.length, True) - lo
        found = np.repeat(np.arange(len(n)), n)
        place = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else found
        return shard, shard.order[place], found

    def spans(self, shard: SuffixArray, pos: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, ...]:
        """Longest verbatim matches: (word, item, word in the item, words), one for each place where one begins that is
        not the rest of the one before."""
        order = np.lexsort((-self.length[found], pos))
        pos, found = pos[order], found[order]
        new = np.flatnonzero(np.append(True, pos[1:] != pos[:-1])[: len(pos)])
        pos, found = pos[new], found[new]
        at, size = self.array.longest(shard, pos)
        short = size < self.window  # the neighbour may be the inside of a longer item; then the window itself counts
        at[short], size[short] = self.at[found[short]], self.length[found[short]]
        inner = np.zeros(len(pos), bool)
        inner[1:] = (pos[1:] == pos[:-1] + 1) & (size[1:] <= size[:-1] - 1)
        pos, at, size = pos[~inner], at[~inner], size[~inner]
        a = self.array
        return pos, a.words.doc[at], at - a.begin[at], size


def _hit(shard: SuffixArray, pos: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words lie inside an occurrence."""
    edge = np.zeros(len(shard.hash) + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.add.at(edge, pos + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _passes(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Tests]:
    """The test items in blocks of about PASS_BYTES, one at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / PASS_BYTES))
    for i in range(n):
        yield Tests([(x.item, bytes(x.text)) for x in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).collect()], window)


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """Verbatim matches of test items in documents: id_col, n_words, n_hit, items and spans, one row per document.

    Texts are lower-cased (A-Z); words are runs of digits, a-z and characters outside ASCII. Each shard of
    documents (2 MB of text, or as much as the test items have) gets a suffix array, in which every distinct
    test suffix of at least `window` words (an item of fewer words: the whole item) is looked up by two binary
    searches: between them lie all its occurrences. n_hit counts document words inside an occurrence of a
    window; items holds the distinct item ids as strings. spans has the longest verbatim matches and where they
    are: item, word in the document, word in the item and number of words; where several items match as far,
    one of them.

    Null and empty texts have no words; an item without words occurs nowhere. Items with a null id count for
    n_hit and spans, not for items. Repeated rows are judged each for itself; other columns are not read.
    Each document is searched within one task, without a shuffle. Equal windows of many items are one search
    and one row per occurrence. The test set is held in memory in blocks of PASS_BYTES; each block takes a
    pass, and with more than one the state between passes is written.
    """
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.lit(b"").alias("hit"), F.array().cast("array<string>").alias("items"), F.array().cast(SPAN).alias("spans"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"))
    scratch, first = Scratch(docs.sparkSession, "matches"), True
    for tests in _passes(benchmark, item_col, item_text_col, window):
        out = (out if first else scratch.cut(out)).mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(tests)), out.schema)
        first = False
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans")


def _search(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: Tests = shared.value
        names = tests.names
        for batch, texts in blocks(batches, limit=max(SHARD_BYTES, tests.bytes)):
            shard, pos, found = tests.search(texts)
            hit = _hit(shard, pos, tests.length[found])
            ends = np.concatenate(([0], np.cumsum(shard.words.counts)))
            sets = np.unique(np.stack((shard.words.doc[pos], tests.set[found])), axis=1) if len(pos) else np.zeros((2, 0), np.int64)
            of_doc = np.searchsorted(sets[0], np.arange(len(texts) + 1))
            at, item, place, n = tests.spans(shard, pos, found)
            cut = np.searchsorted(at, ends)
            had = [batch.column(x).to_pylist() for x in ("hit", "items", "spans")]
            rows: dict[str, list] = {x: [] for x in ("hit", "items", "spans", "n_hit")}
            for k in range(len(texts)):
                own, a, b = hit[ends[k] : ends[k + 1]], cut[k], cut[k + 1]
                if had[0][k]:
                    own = own | np.unpackbits(np.frombuffer(had[0][k], np.uint8), count=len(own)).astype(bool)
                rows["n_hit"].append(int(own.sum()))
                rows["hit"].append(np.packbits(own).tobytes() if rows["n_hit"][-1] else b"")
                new = {names[i] for s in sets[1][of_doc[k] : of_doc[k + 1]] for i in tests.members[s]}
                rows["items"].append(sorted({*had[1][k], *new} - {None}))
                rows["spans"].append(had[2][k] + [{"item_id": names[i], "doc_word": int(p - ends[k]), "item_word": int(j), "n_words": int(m)} for p, i, j, m in zip(at[a:b], item[a:b], place[a:b], n[a:b], strict=True)])
            made = {"n_words": pa.array(shard.words.counts.astype(np.int64))} | {c: pa.array(rows[c], batch.schema.field(c).type) for c in rows}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The documents, with all their columns, in which no test suffix occurs; see find_matches."""
    out = docs
    for tests in _passes(benchmark, item_col, item_text_col, window):
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in blocks(batches, text_col, max(SHARD_BYTES, shared.value.bytes)):
                shard, pos, _ = shared.value.search(texts)
                yield batch.filter(pa.array(np.bincount(shard.words.doc[pos], minlength=len(texts)) == 0))

        out = out.mapInArrow(clean, docs.schema)
    return out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op2_decontamination": op2_decontamination}
SQL = {
    "op2_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' '))) AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i+m-1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hits AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
