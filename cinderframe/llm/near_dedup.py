"""MinHash near-duplicate groups by an inverted join on signature coordinates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cinderframe.llm._bytes import Words, blocks, byte_class, mix
from cinderframe.llm._frames import Scratch

SPACE_WORDS = byte_class(r"[^\x20\x09-\x0D]")


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one text after the other, and each text's number of them."""
    w = Words(texts, SPACE_WORDS)
    doc, h = w.grams(words)
    for q in range(1, words):  # a text of fewer words is one shingle
        short = w.counts == q
        if short.any():
            d, x = w.grams(q)
            keep = short[d]
            doc, h = np.concatenate((doc, d[keep])), np.concatenate((h, x[keep]))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if len(h):
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
        doc, h = doc[new], h[new]
    return h, np.bincount(doc, minlength=len(texts))


def _features(words: int, coords: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    rng = np.random.default_rng(97)
    factor = rng.integers(1, 1 << 63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, coords, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            h, counts = shingle_sets(texts, words)
            full = np.flatnonzero(counts)
            sig = np.zeros((len(full), coords), np.uint64)
            digest = np.zeros((len(full), 2), np.uint64)
            if len(full):
                at = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
                for k in range(coords):
                    sig[:, k] = mix(np.minimum.reduceat(mix(h * factor[k] + shift[k]), at) + np.uint64(k))
                digest[:, 0] = np.add.reduceat(mix(h + shift[0]), at)
                digest[:, 1] = np.add.reduceat(mix(h ^ shift[-1]), at)
            n, has = len(texts), counts > 0
            ends = np.concatenate(([0], np.cumsum(has))).astype(np.int32)
            valid = pa.array(has)
            mask = valid.buffers()[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_key"),
                    pa.array(counts.astype(np.int64)),
                    pa.Array.from_buffers(pa.binary(), n, [mask, pa.py_buffer(ends * np.int32(16)), pa.py_buffer(digest.tobytes())]),
                    pa.ListArray.from_arrays(pa.array(ends * np.int32(coords)), pa.array(sig.ravel().view(np.int64))),
                ],
                names=["id", "text_key", "n_shingles", "digest", "sig"],
            )

    return run


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            h, counts = shingle_sets(texts, words)
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["node", "shingles"])

    return run


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) with the smallest node of each connected component, for the nodes of edges (a, b)."""
    both = scratch.cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = scratch.cut(step.join(up, "label").select("node", "was", F.col("top").alias("label")))
        done = new.filter("label <> was").isEmpty()
        scratch.drop(labels)
        labels = new
        if done:
            scratch.drop(both)
            return labels.select("node", "label")


class _Lists:
    """Posting lists of a block's values: which members hold each."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def common(self, own: np.ndarray) -> np.ndarray:
        """How many values each member shares with own."""
        lo, hi = np.searchsorted(self.values, own, "left"), np.searchsorted(self.values, own, "right")
        lo, n = lo[hi > lo], (hi - lo)[hi > lo]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
        return np.bincount(self.owner[at], minlength=len(self.sizes))


def _block_links(percent: int, agree: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A confirmed link from each class on the left to each other component on the right, in a pair of blocks.

    Collisions of coordinates are counted first; a class without `agree` of them with any of another component skips the rest.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            posts, lists = _Lists([np.asarray(x) for x in right["tokens"]]), None
            nodes, labels = right["node"].to_numpy(), right["label"].to_numpy()
            for node, label, tokens, own in zip(left["node"], left["label"], left["tokens"], left["shingles"], strict=True):
                near = (posts.common(np.asarray(tokens)) >= agree) & (labels != label) & (nodes != node)
                if not near.any():
                    continue
                lists = lists or _Lists([np.asarray(x) for x in right["shingles"]])
                common = lists.common(np.asarray(own))
                linked = near & (100 * common >= percent * (len(own) + lists.sizes - common))
                for k in np.unique(labels[linked], return_index=True)[1]:  # one link to a component is enough
                    x = nodes[linked][k]
                    out.append((min(node, x), max(node, x)))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, coords: int = 40, agree: int = 19, rounds: int = 2, small: int = 64, block: int = 192
) -> DataFrame:
    """Near-duplicate groups of documents: one row per input row with id, text_key, n_shingles, label and component_id.

    Texts are lower-cased (A-Z) and split at ASCII white space. A document's set holds its distinct
    shingles of `words` words; of fewer words, the whole sequence. Two documents are linked if
    100 * intersection >= percent * union; every link is confirmed on whole sets.

    Equal sets form one class, and classes are compared. A class posts each coordinate of its MinHash
    signature that another class has too. Two classes that agree in at least `agree` of `coords`
    coordinates must share one among the rarest of each (prefix), so only these are joined and frequent
    coordinates are skipped. In every posting list first a head is compared with the members (`rounds`
    times, each with other heads); what then still lies in different components of one list is compared in
    full: short lists as pairs, long ones in blocks of `block` classes, where collisions are counted by merging
    posting lists, classes with too few skip the rest, and confirmed links only come out.
    At similarity 0.8, 40 coordinates agree in fewer than 19 places in about one pair of a million.

    text_key is the text's MD5 (that of no bytes for null), label names the group whatever its ids. A null or
    wordless text has no shingles, is linked with nothing and has no label. component_id is the smallest id in
    reach, itself included. Other columns are not read; an empty table gives an empty result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near")
    text = F.col(text_col).cast("binary")
    id_type = docs.schema[id_col].dataType
    source = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(text, F.lit(b""))).alias("text_key"), text.alias("text"))
    kinds = T.StructType([T.StructField("id", id_type), T.StructField("text_key", T.StringType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.ArrayType(T.LongType()))])
    feats = scratch.cut(source.mapInArrow(_features(words, coords), kinds))
    classes = scratch.cut(feats.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("low"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")).withColumn("node", F.monotonically_increasing_id()))

    posts = classes.select("node", F.explode("sig").alias("token"))
    common = posts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    listed = posts.join(common, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens")).filter(F.size("tokens") >= agree)
    listed = scratch.cut(listed.select("node", F.col("tokens.token").alias("tokens")))
    lists = scratch.cut(listed.select("node", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - (agree - 1))).alias("token")))
    wanted = classes.join(listed, "node", "left_semi").select("node", "text_key")
    texts = wanted.join(source.select("text_key", "text"), "text_key").groupBy("node").agg(F.first("text").alias("text"))
    sets = scratch.cut(texts.mapInArrow(_sets(words), "node long, shingles array<long>"))

    def sided(df: DataFrame, side: str, column: str) -> DataFrame:
        return df.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(sided(listed, side, "tokens"), side)
        pairs = pairs.filter(F.size(F.array_intersect("tokens_a", "tokens_b")) >= agree).select("a", "b")
        for side in "ab":
            pairs = pairs.join(sided(sets, side, "shingles"), side)
        n = F.size(F.array_intersect("shingles_a", "shingles_b"))
        pairs = pairs.select("a", "b", n.alias("n"), (F.size("shingles_a") + F.size("shingles_b") - n).alias("u"))
        return pairs.filter(100 * F.col("n") >= percent * F.col("u")).select("a", "b")

    labels = scratch.cut(listed.select("node", F.col("node").alias("label")))

    def joined(new: DataFrame) -> None:
        """Join the components that new links (a, b) connect; only components are linked, not nodes again."""
        nonlocal labels
        for side in "ab":
            new = new.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side)
        edges = scratch.cut(new.select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b").distinct())
        merged = components(edges, scratch).select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = scratch.cut(labels.join(merged, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
        scratch.drop(edges)

    def labelled() -> DataFrame:
        return lists.join(labels, "node")

    ordered = (F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    for r in range(rounds):
        now = labelled()
        heads = now.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(r)), "node", "label")).alias("h")).select("token", F.col("h.node").alias("head"), F.col("h.label").alias("head_label"))
        joined(confirmed(now.join(heads, "token").filter("label <> head_label").select(*ordered).distinct()))

    now = labelled()
    mixed = now.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("size"), F.min("node").alias("head")).filter("l <> m").select("token", "size", "head")
    rest = scratch.cut(now.join(mixed, "token"))
    some = rest.filter(F.col("size") <= small)
    pairs = some.select("token", F.col("node").alias("a"), F.col("label").alias("la")).join(some.select("token", F.col("node").alias("b"), F.col("label").alias("lb")), "token").filter("a < b and la <> lb").select("a", "b").distinct()
    many = rest.filter(F.col("size") > small)
    more = confirmed(pairs)
    if not many.isEmpty():
        more = more.union(_between_blocks(many, sets.join(listed, "node"), scratch, percent, agree, block))
    joined(more)

    low = classes.join(labels, "node", "left").select("digest", "low", F.coalesce("label", "node").alias("label"))
    low = scratch.cut(low.join(low.groupBy("label").agg(F.min("low").alias("least")), "label").select("digest", "least", "label"))
    scratch.drop(listed, lists, sets, rest, classes)
    out = feats.select("id", "text_key", "n_shingles", "digest").join(low, "digest", "left")
    return out.select("id", "text_key", "n_shingles", "label", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: int) -> DataFrame:
    """id_col, n_shingles, component_id and kept of near_groups(): kept is whether id_col equals component_id.

    Rows with equal ids and texts get equal results; a row with a null id is kept only if no row of its group
    has an id.
    """
    out = near_groups(docs, id_col, text_col, **settings)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _between_blocks(rest: DataFrame, sets: DataFrame, scratch: Scratch, percent: int, agree: int, block: int) -> DataFrame:
    """Links between classes of long posting lists that lie in different components so far."""
    groups = components(rest.select(F.col("node").alias("a"), F.col("head").alias("b")), scratch)
    nodes = scratch.cut(rest.select("node", "label").distinct().join(groups.select("node", F.col("label").alias("grp")), "node"))
    main = nodes.groupBy("grp", "label").count().groupBy("grp").agg(F.max_by("label", "count").alias("main"), F.max("count").alias("n_main"), F.sum("count").alias("n"))
    blocks_of = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    main = main.select("grp", "main", blocks_of(F.col("n_main")).alias("majors"), blocks_of(F.col("n") - F.col("n_main")).alias("minors"))
    nodes = nodes.join(main, "grp").withColumn("major", F.col("label") == F.col("main"))
    own = F.pmod(F.xxhash64("node", F.lit("block")), F.when(F.col("major"), F.col("majors")).otherwise(F.col("minors")))
    nodes = nodes.withColumn("own", own.cast("int"))
    # pairs of blocks: a minor block i (left) with minor blocks j >= i and with every major block (j from minors on)
    left = nodes.filter("not major").withColumn("j", F.explode(F.sequence(F.col("own"), F.col("minors") + F.col("majors") - 1))).select("grp", F.col("own").alias("i"), "j", "node", "label", F.lit(0).alias("side"))
    right = nodes.withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("major"), F.col("minors") - 1).otherwise(F.col("own"))))).select("grp", "i", F.when(F.col("major"), F.col("own") + F.col("minors")).otherwise(F.col("own")).alias("j"), "node", "label", F.lit(1).alias("side"))
    both = left.union(right).join(sets, "node")
    return both.groupBy("grp", "i", "j").applyInPandas(_block_links(percent, agree), "a long, b long").distinct()


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


QUERIES = {"op10_near_dedup": op10_near_dedup}
SQL = {
    "op10_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT p.a, p.b FROM p JOIN s sa ON sa.doc_id = p.a JOIN s sb ON sb.doc_id = p.b
  WHERE 100 * n >= 80 * (len(sa.s) + len(sb.s) - n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
""",
}
