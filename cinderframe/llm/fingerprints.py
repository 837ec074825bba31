"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cinderframe.llm._frames import Scratch

#: Lanes of 32 bits: of a paragraph's SHA-512, and of its word pairs' signs.
DIGEST_LANES, SIGN_LANES = 16, 64
_MASK = (1 << 32) + 1


def _paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _pairs(paragraph: Column) -> Column:
    """Hashes of the pairs of neighbouring words of a paragraph; a single word stands for itself."""
    words = F.filter(F.split(paragraph, " ", -1), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(words) == 1, F.transform(words, lambda w: F.xxhash64(w))).otherwise(pairs)


def _digest_lanes(text: Column) -> Column:
    """Sum of the paragraphs' SHA-512 digests, as lanes modulo 2 ** 32."""
    zero = F.array_repeat(F.lit(0).cast("long"), DIGEST_LANES)
    place = F.sequence(F.lit(0), F.lit(DIGEST_LANES - 1))
    lanes = lambda p: F.transform(place, lambda i: F.conv(F.substr(F.sha2(p, 512), i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.transform(F.aggregate(_paragraphs(text), zero, lambda acc, p: F.zip_with(acc, lanes(p), lambda x, y: x + y)), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)))


def _hex(x: Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 8, "0"))


def fingerprint(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """Rows (keys) with a column fp_<i> for each text column: (identity, signs, n), see document_fingerprints.

    keys must tell rows apart. A row's pairs are summed in the stage that holds it, then by key.
    """
    lanes = [f"s{i}" for i in range(SIGN_LANES // 2)]
    wide = rows.select(*keys, *[F.unhex(F.array_join(F.transform(_digest_lanes(F.col(t)), _hex), "")).alias(f"id_{k}") for k, t in enumerate(texts)], F.array(*[F.struct(F.lit(k).alias("which"), F.col(t).alias("text")) for k, t in enumerate(texts)]).alias("t"))
    ids = [f"id_{k}" for k in range(len(texts))]
    each = wide.select(*keys, *ids, F.explode("t").alias("t")).select(*keys, *ids, F.col("t.which").alias("which"), F.flatten(F.transform(_paragraphs(F.col("t.text")), _pairs)).alias("pairs"))
    each = each.select(*keys, *ids, "which", F.explode_outer("pairs").alias("h"))
    sums = each.groupBy(*keys, *ids, "which").agg(F.count("h").alias("n"), *[F.coalesce(F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_MASK))), F.lit(0)).alias(x) for i, x in enumerate(lanes)])
    low, high = [F.col(x).bitwiseAND(F.lit((1 << 32) - 1)) for x in lanes], [F.shiftrightunsigned(F.col(x), 32) for x in lanes]
    signs = sums.select(*keys, *ids, "which", F.struct(F.array(*[x.cast("int") for x in (*low, *high)]).alias("ones"), "n").alias("fp"))
    out = signs.groupBy(*keys).agg(*[F.first(F.when(F.col("which") == k, F.struct(F.col(f"id_{k}").alias("identity"), F.col("fp.ones").alias("ones"), F.col("fp.n").alias("n"))), ignorenulls=True).alias(f"fp_{k}") for k in range(len(texts))])
    return out


def fingerprint_text(fp: Column) -> Column:
    """A fingerprint as hexadecimal digits: identity lanes, sign lanes, number of pairs."""
    return F.concat(F.lower(F.hex(fp.identity)), F.array_join(F.transform(fp.ones, _hex), ""), _hex(fp.n.bitwiseAND(F.lit((1 << 32) - 1))))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints from 0 to 1: 1 if equal, else the cosine of their pairs' counts as the signs estimate it."""
    sign = lambda fp: F.transform(fp.ones, lambda x: (2 * x - fp.n).cast("double"))
    add = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    dot, norm = add(sign(a), sign(b)), F.sqrt(add(sign(a), sign(a)) * add(sign(b), sign(b)))
    return F.when(fingerprint_text(a) == fingerprint_text(b), F.lit(1.0)).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / norm))).otherwise(F.lit(0.0))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint after inserting (sign 1) or deleting (-1) the paragraphs whose fingerprint is b."""
    mask = F.lit((1 << 32) - 1)
    lane = lambda x, y: (x.cast("long") + sign * y).bitwiseAND(mask)
    number = lambda fp, i: F.conv(F.substr(F.hex(fp.identity), i * 8 + 1, F.lit(8)), 16, 10).cast("long")
    identity = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(DIGEST_LANES - 1)), lambda i: _hex(lane(number(a, i), number(b, i)))), ""))
    return F.struct(identity.alias("identity"), F.zip_with(a.ones, b.ones, lane).alias("ones"), lane(a.n, b.n).alias("n"))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Order-independent fingerprints of documents: id_col, fp (identity, ones, n) and fingerprint (hex digits).

    A paragraph (between line feeds) is hashed to a wide vector: 16 lanes are its SHA-512, 64 lanes count,
    over its pairs of neighbouring words, a random bit of the pair's hash. A document's fingerprint is the sum
    over its paragraphs, lane by lane modulo 2 ** 32. So equal multisets of paragraphs have equal
    fingerprints in any order, `combine` inserts or deletes paragraphs without reading the rest, unequal
    ones differ but for a collision of SHA-512 sums, and `likeness` compares what two documents share.

    Null and empty texts hold one empty paragraph. Rows with equal id and text give one row; other columns
    are not read; empty in, empty out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.md5("text")).dropDuplicates(["id", "key"])
    out = fingerprint(rows, ["id", "key"], ["text"])
    return out.select(F.col("id").alias(id_col), F.col("fp_0").alias("fp"), fingerprint_text(F.col("fp_0")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of their edits, and how alike they are.

    The edit replaces the last third of the code points (rounded down) by as many (or all) first ones of the
    next document in descending order of id_col, nulls last, ties by the text's MD5; after the last comes the
    first. Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Order is found on (id, MD5, length) alone: ranges are sorted in parallel, and each range's last row takes
    the head of the next range. Texts are then shuffled once by id and MD5; the next document's share comes as
    a prefix. Null texts are empty. Rows with equal id and text are one document, given back as often as it
    stands there. Other columns are not read; empty in, empty out.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "prints")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("key", F.concat(F.unhex(F.md5("text")), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
    down = [F.col("id").desc_nulls_last(), F.col("key")]
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = base.select("id", "key", F.length("text").alias("n")).groupBy("id", "key").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    order = scratch.cut(order.repartitionByRange(n_parts, *down).withColumn("part", F.spark_partition_id()))
    in_part = Window.partitionBy("part").orderBy(*down)
    order = order.withColumn("next", F.lead("key").over(in_part)).withColumn("place", F.row_number().over(in_part))
    by_part = Window.orderBy("part")  # a row per range
    all_parts = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = order.filter("place = 1").select(F.col("part").alias("p"), F.coalesce(F.lead("key").over(by_part), F.first("key").over(all_parts)).alias("after"))
    order = scratch.cut(order.join(following, F.col("part") == F.col("p")).select("id", "key", "n", "copies", F.coalesce("next", "after").alias("next")))

    # both joins read the same two columns of the texts, so these are shuffled once
    texts = base.groupBy("key").agg(F.first("text").alias("text"))
    previous = order.select(F.col("next").alias("key"), F.col("key").alias("previous"))
    asked = order.join(previous, "key").select(F.col("key").alias("of"), "id", "copies", "previous", F.floor(F.col("n") / 3).cast("int").alias("cut"), "next")
    heads = texts.join(asked, texts.key == asked.next).select("of", "id", "copies", "previous", "cut", F.substr("text", F.lit(1), F.col("cut")).alias("prefix"))
    rows = texts.join(heads, texts.key == heads.of)
    rows = rows.select("key", "id", "copies", "previous", "text", F.concat(F.substr("text", F.lit(1), F.length("text") - F.col("cut")), "prefix").alias("edited"), F.length("text").cast("long").alias("n_chars"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("edited", 256)))
    prints = scratch.cut(fingerprint(rows, ["key", "id", "copies", "previous", "n_chars", "sha"], ["text", "edited"]))
    nexts = prints.select(F.col("previous").alias("key"), F.col("fp_0").alias("fp_next"))
    out = prints.join(nexts, "key").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    out = out.withColumn("edited_sha256", F.lower(F.hex("sha")))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint_text(F.col("fp_0")).alias("fingerprint"), fingerprint_text(F.col("fp_1")).alias("edited_fingerprint"), likeness(F.col("fp_0"), F.col("fp_1")).alias("near_edited"), likeness(F.col("fp_0"), F.col("fp_next")).alias("near_next"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_fingerprints": op4_fingerprints}
SQL: dict[str, str] = {}
