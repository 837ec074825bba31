"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cinderframe.llm._bytes import Words, blocks, byte_class, mix, powers
from cinderframe.llm._frames import Scratch

SPACE_WORDS = byte_class(r"[^\x20\x09-\x0D]")
STOPS = np.isin(np.arange(256), [ord(x) for x in ".!?"])
#: A sentence is long if it has at least twice this many words; in a long one, cuts leave as many at both ends.
MARGIN = 8
#: A long sentence is cut behind words whose bytes, with those of the word before, add up to a multiple of this.
CUT = 4
#: Of all spans, this many hashes at most can each hold more than this part; they are joined without a shuffle.
HOT = 10_000


class Sentences:
    """Sentences of a few texts, by word: where each begins, its text and its number of words."""

    def __init__(self, texts: list[bytes]):
        self.words = w = Words(texts, SPACE_WORDS)
        buf = np.frombuffer(w.raw, np.uint8)
        n = len(w.hash)
        run = np.concatenate(([0], np.cumsum(buf, dtype=np.int64)))
        lines = np.concatenate(([0], np.cumsum(buf == 10)))
        ends = STOPS[buf[w.ends - 1]] if n else np.zeros(0, bool)
        ends[:-1] |= (w.doc[1:] != w.doc[:-1]) | (lines[w.starts[1:]] > lines[w.ends[:-1]])  # the end of a line or of a text
        ends[-1:] = True
        own, word, last = run[w.ends] - run[w.starts], np.arange(n), np.flatnonzero(ends)
        of = np.cumsum(ends) - ends
        inner = (word - np.concatenate(([-1], last))[of] >= MARGIN) & (last[of] - word >= MARGIN)
        ends |= inner & ((own + np.roll(own, 1)) % CUT == 0)
        #: First word of every sentence, and behind the last; the sentence's text; each text's first sentence.
        self.first = np.concatenate(([0], np.flatnonzero(ends) + 1)) if n else np.zeros(1, np.int64)
        self.doc = w.doc[self.first[:-1]]
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.begin = np.concatenate(([0], np.cumsum(self.counts)))

    def spans(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(first sentence, sentence behind) of every span: from each sentence on, and up to each, the fewest, two at
        least, that hold `least` words; a text without any is one span."""
        n = len(self.doc)
        a, e = np.arange(n), np.arange(1, n + 1)
        begin, end = self.begin[self.doc], self.begin[self.doc + 1]
        b = np.maximum(a + 2, np.searchsorted(self.first, self.first[:-1] + least))
        b = np.where(a == begin, np.minimum(b, end), b)
        c = np.minimum(e - 2, np.searchsorted(self.first, self.first[1:] - least, "right") - 1)
        more = (c >= begin) & (b[c] != e)
        return np.concatenate((a[b <= end], c[more])), np.concatenate((b[b <= end], e[more]))

    def hashes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the words of each span."""
        up, down = powers(len(self.words.hash) + 1)
        out = []
        for h in (self.words.hash, mix(self.words.hash ^ np.uint64(0x5851F42D4C957F2D))):
            run = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(h * up[:-1], out=run[1:])
            s, e = self.first[a], self.first[b]
            out.append(mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)))
        return out[0], out[1]


def _hashes(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches):
            s = Sentences(texts)
            h, n = np.unique(s.hashes(*s.spans(least))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return run


def _places(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            s = Sentences(texts)
            a, b = s.spans(least)
            h, g = s.hashes(a, b)
            doc = s.doc[a]
            rows = batch.select(["id", "key"]).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.astype(np.uint32).view(np.int32)), rows.column(0), rows.column(1), pa.array(((a - s.begin[doc]) << 32) + (b - s.begin[doc]))], names=["h", "g", "id", "key", "pos"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the sentences of their spans."""
    for batch, texts in blocks(batches):
        s = Sentences(texts)
        kept, gone = [], []
        for k, (text, spans) in enumerate(zip(texts, batch.column("spans"), strict=True)):
            if not spans.is_valid:
                kept.append(text), gone.append(0)
                continue
            at = np.array(spans.values)
            edge = np.bincount(at >> 32, minlength=s.counts[k] + 1) - np.bincount(at & 0xFFFFFFFF, minlength=s.counts[k] + 1)
            out = np.cumsum(edge[:-1]) > 0
            cuts = np.append(s.words.starts[s.first[s.begin[k] : s.begin[k + 1]]] - s.words.doc_start[k], len(text))
            cuts[0] = 0
            kept.append(b"".join(text[cuts[i] : cuts[i + 1]] for i in np.flatnonzero(~out)))
            gone.append(int(out.sum()))
        blank = np.array([bool(t) for t in texts]) & (s.counts == 0)  # white space alone is a sentence without words
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array((s.counts + blank).astype(np.int64)), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept], pa.string())], names=["id", "n_sentences", "n_removed", "text"])


def _known(rows: DataFrame, table: DataFrame, on: list[str], spread: Column, limit: int) -> DataFrame:
    """rows joined with table (a row per key, n of which rows has) on the keys: frequent keys by broadcast, the rest by shuffle.

    At most rows / limit keys are frequent. Rows of these get another key, spread, in the shuffle.
    """
    more = [c for c in table.columns if c not in (*on, "n")]
    hot = table.filter(F.col("n") > limit).select(*on, *[F.col(c).alias(f"{c}_") for c in more], F.lit(True).alias("hot"))
    cold = table.filter(F.col("n") <= limit).select(*[F.col(c).alias(f"{c}_c") for c in on], *more, F.lit(True).alias("cold"))
    rows = rows.join(F.broadcast(hot), on, "left").withColumn("k", F.when(F.col("hot"), spread).otherwise(F.col(on[0])))
    match = F.col("k") == F.col(f"{on[0]}_c")
    for c in on[1:]:
        match = match & (F.col(c) == F.col(f"{c}_c"))
    rows = rows.join(cold, match, "left").filter("hot or cold")
    return rows.select(*[c for c in rows.columns if c not in (*more, *[f"{c}_" for c in more], *[f"{c}_c" for c in on], "hot", "cold", "k")], *[F.when(F.col("hot"), F.col(f"{c}_")).otherwise(F.col(c)).alias(c) for c in more])


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span_words: int = 16) -> DataFrame:
    """Documents without sentences that a non-first occurrence of a repeated span covers.

    A sentence ends behind a word that ends in a full stop, exclamation or question mark, and at the end of a line.
    One of 16 words or more (twice MARGIN) is also cut, at least MARGIN words from its ends, behind words that their
    own bytes and those of the word before mark (see CUT), so that it has the same parts wherever it begins.
    A span is a run of consecutive sentences, two at least, with span_words words or more; a text without such a
    run is one span. Spans are compared as lower-case (A-Z) words. Of the occurrences of a span everywhere, the
    first by (id_col, nulls last; then a digest of the text and the place in it) stays; sentences covered by any
    other are removed. Only the shortest spans from every sentence and up to every sentence are hashed: a repeated
    longer one consists of such, repeated too. Returns id_col, n_sentences, n_removed and text (what remains,
    otherwise unchanged).

    Spans meet on 96 bits of hash. Tasks count hashes first; only spans that occur more than once are then
    gathered with their places. A span that holds more than a HOT-th of all places is joined by broadcast (at
    most HOT rows), so no key is one task; its first place is found by aggregation before the shuffle.

    A null text is empty: no sentences; white space alone is one. Rows with equal id and text are one document
    and get equal results. Other columns are not read; empty in, empty out.
    """
    scratch = Scratch(docs.sparkSession, "spans")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).withColumn("key", F.xxhash64("text"))
    counts = rows.select("text").mapInArrow(_hashes(span_words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    repeated = scratch.cut(counts.filter("n > 1"), clean=True)
    place_kind = T.StructType([*T.StructType.fromDDL("h long, g int"), rows.schema["id"], *T.StructType.fromDDL("key long, pos long")])
    places = rows.mapInArrow(_places(span_words), place_kind)
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    limit, spread = total // HOT, F.xxhash64("key", "pos", "id")
    again = scratch.cut(_known(places, repeated, ["h"], spread, limit), clean=True)
    scratch.drop(repeated)
    place = F.struct(F.col("id").isNull().alias("none"), "id", "key", "pos")
    first = scratch.cut(again.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), clean=True)
    later = _known(again, first, ["h", "g"], spread, limit).filter(place != F.col("first"))
    covered = scratch.cut(later.groupBy("id", "key").agg(F.collect_set("pos").alias("spans")).withColumnsRenamed({"id": "c_id", "key": "c_key"}), clean=True)
    scratch.drop(again, first)
    out = rows.join(covered, F.col("id").eqNullSafe(F.col("c_id")) & F.col("key").eqNullSafe(F.col("c_key")), "left").select("id", "text", "spans")
    kinds = T.StructType([rows.schema["id"], *T.StructType.fromDDL("n_sentences long, n_removed long, text string")])
    return out.mapInArrow(_without, kinds).withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
SQL = {
    "op1_substring_dedup": r"""
WITH t AS (
  SELECT doc_id, i, tok, translate(regexp_extract(tok, '[^\x20\x09-\x0D]+'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
  FROM (SELECT doc_id, unnest(x) AS tok, generate_subscripts(x, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '^[\x20\x09-\x0D]+$|(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS x FROM documents))),
b AS (SELECT *, list_sum(list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: ('0x' || h)::INT)) AS s FROM t),
f AS (
  SELECT *, CASE WHEN regexp_matches(w, '[.!?]$') OR regexp_matches(tok, '[^\x20\x09-\x0D][\x20\x09-\x0D]*\x0A') THEN 1 ELSE 0 END AS stop,
         lag(s, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM b),
g AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM f),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, o ORDER BY i) AS k, count(*) OVER (PARTITION BY doc_id, o) AS size FROM g),
e AS (SELECT doc_id, i, tok, w, CASE WHEN stop = 1 OR (k >= 8 AND size - k >= 8 AND (s + before) % 4 = 0) THEN 1 ELSE 0 END AS stop FROM h),
n AS (SELECT *, CAST(coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS u FROM e),
u AS (SELECT doc_id, u, min(i) AS a, max(i) AS z, string_agg(tok, '' ORDER BY i) AS tok FROM n GROUP BY doc_id, u),
l AS (SELECT doc_id, CAST(max(u) AS BIGINT) AS last FROM n WHERE w <> '' GROUP BY doc_id),
r AS (
  SELECT a.doc_id, a.u, CASE WHEN b.u IS NOT NULL THEN greatest(b.u, a.u + 1) WHEN a.u = 0 THEN 1000000000 END AS v
  FROM u a ASOF LEFT JOIN u b ON a.doc_id = b.doc_id AND a.a + 15 <= b.z),
p AS (
  SELECT r.doc_id, r.u, least(v, l.last) AS v FROM r JOIN l USING (doc_id) WHERE v <= l.last OR r.u = 0
  UNION
  SELECT b.doc_id, least(a.u, b.u - 1), b.u FROM u b ASOF JOIN u a ON a.doc_id = b.doc_id AND b.z - 15 >= a.a WHERE b.u > 0),
o AS (
  SELECT p.doc_id, p.u, p.v, unnest(range(x.a, y.z + 1)) AS i
  FROM p JOIN u x ON x.doc_id = p.doc_id AND x.u = p.u JOIN u y ON y.doc_id = p.doc_id AND y.u = p.v),
m AS (SELECT o.doc_id, o.u, o.v, string_agg(w, ' ' ORDER BY o.i) AS words FROM o JOIN n ON n.doc_id = o.doc_id AND n.i = o.i GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY words ORDER BY doc_id, u, v) AS k FROM m),
c AS (SELECT DISTINCT doc_id, unnest(range(u, v + 1)) AS u FROM q WHERE k > 1),
s AS (
  SELECT u.doc_id, count(*) AS n_sentences, count(c.u) AS n_removed, string_agg(tok, '' ORDER BY u.u) FILTER (c.u IS NULL) AS text
  FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.u = u.u GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(s.text, '') AS text
FROM documents d LEFT JOIN s USING (doc_id)
""",
}
