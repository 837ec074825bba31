"""Token ids in bit-packed files with block offsets: writer, reader and random access.

A file holds, in this order and all little-endian:
  head     8 bytes b"CFTOKEN1", then bits, block, n_docs, n_ids, n_blocks as unsigned 64-bit integers
  ids      n_docs document ids (signed 64-bit), then n_docs bytes: 1 where the id is null
  ends     n_docs unsigned 64-bit: ids of all documents of the file up to and with this one
  offsets  n_blocks + 1 unsigned 64-bit: where each block begins in the payload, and its end
  payload  each block of `block` ids (the last may be shorter): ids of `bits` bits each, lowest bit first,
           padded to a whole byte
bits is the least number in which the vocabulary's largest id fits.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from cinderframe.llm._bytes import blocks
from cinderframe.llm._frames import shared_folder

MAGIC = b"CFTOKEN1"
#: Ids per block, and ids after which a task starts a new file.
BLOCK_IDS, FILE_IDS = 4096, 2 << 20
#: Bytes of pieces and their ids that a worker remembers twice: those new since the last time it was full, and those before.
REMEMBERED, ENTRY = 48 << 20, 180


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids of one block in bits each, lowest bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    return np.packbits((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1, bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little")
    return flat.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def to_file(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    parts = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype("<u8")
    head = np.array([bits, block, len(doc_ids), len(ids), len(parts)], "<u8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join((MAGIC, head.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), nulls.tobytes(), np.cumsum(counts).astype("<u8").tobytes(), offsets.tobytes(), *parts))


class TokenFile:
    """Random access to the documents of one file, of which only the index is read at first."""

    def __init__(self, file):
        self.file = file
        head = file.read(48)
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, self.n_docs, self.n_ids, n_blocks = (int(x) for x in np.frombuffer(head[8:], "<u8"))
        ids = np.frombuffer(file.read(8 * self.n_docs), "<i8")
        nulls = np.frombuffer(file.read(self.n_docs), np.uint8)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, nulls, strict=True)]
        self.ends = np.frombuffer(file.read(8 * self.n_docs), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(file.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.payload = file.tell()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file; reads the blocks that hold them."""
        if start >= end:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block
        self.file.seek(self.payload + int(self.offsets[a]))
        data = self.file.read(int(self.offsets[b + 1] - self.offsets[a]))
        out = [unpack(data[int(self.offsets[k] - self.offsets[a]) : int(self.offsets[k + 1] - self.offsets[a])], min(self.block, self.n_ids - k * self.block), self.bits) for k in range(a, b + 1)]
        return np.concatenate(out)[start - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


def _byte_signs() -> list[str]:
    """The sign that byte-level vocabularies write for each byte: visible Latin-1 for itself, others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256))
    return [chr(b) if b in seen else chr(256 + next(other)) for b in range(256)]


class _Pieces(dict):
    """Ids, as bytes, of pieces of text between single spaces; misses are encoded by the tokenizer.

    When REMEMBERED bytes are full, pieces not asked for since the time before are forgotten.
    """

    #: Signs that are a piece of their own after a letter, whatever follows.
    TAIL = '.,;:!?*$%&#"()'

    def __init__(self, encode: Callable[[str], bytes], word: Callable[[str], bytes], lead: str):
        self.encode, self.word, self.lead = encode, word, lead
        self.before: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, piece: str) -> bytes:
        if self.held > REMEMBERED:
            self.before, self.held = dict(self), 0
            self.clear()
        out = self.before.get(piece)
        if out is None:
            if piece.isalpha() and (piece.isascii() or max(piece) < "ɐ"):  # one word of the tokenizer's pattern
                out = self.word(self.lead + piece)
            else:
                core = piece.rstrip(self.TAIL)
                if core != piece and core and core[-1].isalpha() and core[-1] < "ɐ":
                    out = self[core] + self.bare[piece[len(core) :]]
                else:
                    out = self.encode(self.lead + piece)
        self.held += len(piece) + len(out) + ENTRY
        self[piece] = out
        return out


class Encoder:
    """ids of whole texts by the tokenizers library.

    A byte-level tokenizer cuts a text before every single space between two other characters and on both
    sides of such a line feed, so the pieces between can be encoded once and looked up. Texts with other
    white space at their ends or side by side, or with signs of a special token, are encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.model, signs = self.tokenizer.model, _byte_signs()
        self.table = str.maketrans({chr(b): x for b, x in enumerate(signs)})
        self.bare, self.spaced = _Pieces(self.encode, self.word, ""), _Pieces(self.encode, self.word, " ")
        self.bare.bare = self.spaced.bare = self.bare

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """ids of one word of the tokenizer's pattern: the merges alone, without the search for words."""
        shown = word.encode().decode("latin-1").translate(self.table)
        return array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text:
            return self.encode(text)
        out: list[bytes] = []
        for line in text.split("\n"):
            words = line.split()
            if not words or " ".join(words) != line:  # other white space, or not single between two words
                return self.encode(text)
            rest = iter(words)
            out += (self.bare["\n"], self.bare[next(rest)])
            out += map(self.spaced.__getitem__, rest)
        return b"".join(out[1:])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder, whose name may be one of Hadoop's for an S3 store."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partitions: int | None = None) -> DataFrame:
    """Encode every document, add end_id, and write ids to files in ascending order of id_col, nulls first.

    Returns the manifest (part, seq, path, n_docs, n_ids, start), start being the ids in all files before.
    Documents are range-partitioned and sorted by id (ties by text), and each task writes its own files of
    at most FILE_IDS ids, or one document, under a temporary name first; a task that runs again writes the
    same files. folder must be one that executors share. Null texts are empty and hold end_id only; repeated
    rows are written repeatedly; other columns are not read; an empty table makes no files. Ids are integers.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        encode, context = encoder(tokenizer), TaskContext.get()
        bits, end = width(max(encode.vocabulary, end_id + 1)), np.array([end_id], "<u4").tobytes()
        part, made = context.partitionId(), []
        names: list[int | None] = []
        counts: list[int] = []
        held: list[bytes] = []

        def flush() -> None:
            ids = np.frombuffer(b"".join(held), "<u4")
            path = f"{root}/part-{part:06d}-{len(made):04d}.tok"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{path}.{context.taskAttemptId()}") as out:
                out.write(to_file(names, counts, ids, bits))
            store.move(f"{path}.{context.taskAttemptId()}", path)
            made.append((path.rpartition("/")[2], len(names), len(ids)))
            names.clear(), counts.clear(), held.clear()

        for batch, texts in blocks(batches):
            for name, text in zip(batch.column("id").to_pylist(), texts, strict=True):
                ids = encode(text.decode()) + end
                if counts and sum(counts) + len(ids) // 4 > FILE_IDS:
                    flush()
                names.append(name), counts.append(len(ids) // 4), held.append(ids)
        if counts:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(made), pa.int64()), pa.array(range(len(made)), pa.int64()), *(pa.array([x[i] for x in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64())))], names=["part", "seq", "path", "n_docs", "n_ids"])

    made = rows.mapInArrow(write, "part long, seq long, path string, n_docs long, n_ids long")
    made.write.parquet(f"{folder}/manifest")
    made = spark.read.parquet(f"{folder}/manifest")
    parts = made.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of written files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids. A file is read in one task."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{path}") as source:
                    file = TokenFile(source)
                    ids = file.ids(0, file.n_ids).astype("<u4")
                begin = np.concatenate(([0], file.ends))
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
                arrays = [pa.array(file.doc_ids, pa.int64()), pa.array(begin[:-1] + start), pa.array(np.diff(begin)), pa.array(crc, pa.int64())]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(arrays, names=[x.name for x in fields])

    return manifest.select("path", "start").repartition("path").mapInArrow(read, T.StructType(fields))


def token_table(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files into the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, tokenizer, id_col, text_col), folder, with_ids=False)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_token_files": op3_token_files}
SQL: dict[str, str] = {}
