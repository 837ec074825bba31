"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cinderframe.llm._bytes import blocks

#: Bytes that the network reads in one piece, and pieces that it reads side by side.
PIECE, SIDE = 64, 2048
UNKNOWN = "und"
LETTER = np.zeros(256, np.float32)
LETTER[ord("a") : ord("z") + 1] = LETTER[128:] = 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteNetwork:
    """Two gated recurrent layers, one forwards and one backwards, and a softmax for every position.

    Arrays are laid out (unit, piece), so a gate of all pieces is one run of memory. Each position is
    labelled; a text's probabilities are the means over its letters (a-z and bytes outside ASCII).
    """

    def __init__(self, labels: list[str], hidden: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.w: dict[str, np.ndarray] = {}
        for side in "fb":
            self.w[f"x{side}"] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.w[f"u{side}"] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(np.float32)
        self.w["o"] = rng.normal(0, 0.1, (len(labels), 2 * hidden + 1)).astype(np.float32)

    def layer(self, side: str, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (step, unit, piece) for bytes (step, piece)."""
        n, wx, u = self.hidden, self.w[f"x{side}"], self.w[f"u{side}"]
        out = np.empty((len(x), n, x.shape[1]), np.float32)
        h, held = np.zeros((n, x.shape[1]), np.float32), []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            a, b = wx.take(x[t], axis=1, mode="clip"), u @ h
            gates = a[: 2 * n]
            gates += b[: 2 * n]
            z, r = np.split(_sigmoid(gates), 2)
            c = a[2 * n :]
            c += r * b[2 * n :]
            np.tanh(c, out=c)
            if keep:
                held.append((t, h, z, r, c, b[2 * n :].copy()))
            h = np.add(c, z * (h - c), out=out[t])
        return out, held

    def logits(self, states: np.ndarray) -> np.ndarray:
        """(label, step * piece) from states (2 * units, step * piece)."""
        return self.w["o"][:, :-1] @ states + self.w["o"][:, -1:]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean loss over the letters of pieces x (step, piece) labelled y, by backpropagation through time."""
        n, steps, size = self.hidden, *x.shape
        runs = {side: self.layer(side, x, True) for side in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=1).transpose(1, 0, 2).reshape(2 * n, -1)
        p = self.logits(states)
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        want, weight = np.tile(y, steps), LETTER[x].ravel()
        weight = weight / max(1, weight.sum())
        at = np.arange(p.shape[1])
        loss = float(-(np.log(p[want, at] + 1e-9) * weight).sum())
        p[want, at] -= 1
        p *= weight
        g = {"o": np.concatenate([p @ states.T, p.sum(axis=1, keepdims=True)], axis=1)}
        back = (self.w["o"][:, :-1].T @ p).reshape(2 * n, steps, size)
        for k, side in enumerate("fb"):
            u = self.w[f"u{side}"]
            gu, gx = np.zeros_like(u), np.zeros((256, 3 * n), np.float32)
            dh = np.zeros((n, size), np.float32)
            for t, h, z, r, c, bc in reversed(runs[side][1]):
                dh = dh + back[k * n : (k + 1) * n, t]
                dc = dh * (1 - z) * (1 - c * c)
                da = np.concatenate([dh * (h - c) * z * (1 - z), dc * bc * r * (1 - r), dc])
                db = da.copy()
                db[2 * n :] *= r
                gu += db @ h.T
                np.add.at(gx, x[t], da.T)
                dh = dh * z + u.T @ db
            g[f"u{side}"], g[f"x{side}"] = gu, gx.T
        return g, loss

    def fit(self, pieces: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 256, rate: float = 0.02) -> ByteNetwork:
        """Adam over random batches of pieces (piece, byte) labelled y."""
        rng = np.random.default_rng(5)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for s in range(1, steps + 1):
            pick = rng.integers(0, len(pieces), batch)
            g, _ = self.gradients(np.ascontiguousarray(pieces[pick].T), y[pick])
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1, 2 - 2 * s / steps) / max(1, size)
            for k in self.w:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                self.w[k] -= now * max(1, size) * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-6)
        return self

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """(text, label) mean probabilities over the letters of each whole text; zero where it has none."""
        data = [x.lower() for x in texts]
        n_pieces = np.array([-(-len(x) // PIECE) for x in data])
        grid = np.frombuffer(b"".join(x.ljust(PIECE * n, b"\0") for x, n in zip(data, n_pieces, strict=True)), np.uint8).reshape(-1, PIECE)
        owner = np.repeat(np.arange(len(texts)), n_pieces)
        total, letters = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for i in range(0, len(grid), SIDE):
            x = np.ascontiguousarray(grid[i : i + SIDE].T)
            weight = LETTER[x]
            f, b = self.layer("f", x)[0], self.layer("b", x)[0]
            o = self.w["o"]
            n = self.hidden
            sums = np.zeros((len(self.labels), x.shape[1]), np.float32)
            for t in range(PIECE):
                p = o[:, :n] @ f[t] + o[:, n : 2 * n] @ b[t] + o[:, -1:]
                np.exp(p, out=p)
                p *= weight[t] / p.sum(axis=0)
                sums += p
            own = owner[i : i + SIDE]
            for k in range(len(self.labels)):
                total[:, k] += np.bincount(own, sums[k], len(texts))
            letters += np.bincount(own, weight.sum(axis=0), len(texts))
        return total / np.maximum(letters, 1)[:, None]


def has_letter(text: bytes) -> bool:
    return any(x.isalpha() for x in text.decode("utf-8", "ignore"))


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text is 1 modulo 3. A null id is not."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = 600, pieces: int = 6, hidden: int = 8, steps: int = 250) -> ByteNetwork | None:
    """Fit on about per_label labelled documents of each label that are not held out, chosen by a hash of
    id and text, and on `pieces` pieces of PIECE characters of each, at hashed places: a bound on what the driver reads
    whatever the table's size. None without labelled text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = rows.groupBy("lang").agg(F.count("text").alias("n")).filter("n > 0")
    mark = F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1_000_000))
    some = rows.join(F.broadcast(counts), "lang").filter((mark * F.col("n") < per_label * 1_000_000) & (F.length("text") > 0))  # counts: a row per language
    start = lambda i: F.pmod(F.xxhash64("id", i), F.greatest(F.lit(1), F.length("text") - PIECE)).cast("int") + 1
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.lit(pieces)), lambda i: F.substr("text", start(i), F.lit(PIECE))))
    found = sorted((x.lang, x.piece) for x in some.select("lang", cut.alias("piece")).collect())
    if not found:
        return None
    labels = sorted({lang for lang, _ in found})
    data = b"".join(p.encode().lower()[:PIECE].ljust(PIECE, b"\0") for _, p in found)
    y = np.array([labels.index(lang) for lang, _ in found])
    # each label weighs the same
    order = np.concatenate([np.resize(np.flatnonzero(y == k), max(np.bincount(y))) for k in range(len(labels))])
    return ByteNetwork(labels, hidden).fit(np.frombuffer(data, np.uint8).reshape(-1, PIECE)[order], y[order], steps)


def _judge(network: ByteNetwork | None, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Label and probability of each text; und and 0 without a letter (or without a network)."""
    if network is None:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    p = network.predict(texts)
    best = p.argmax(axis=1)
    good = [has_letter(x[:256]) or has_letter(x) for x in texts]
    return [network.labels[k] if ok else UNKNOWN for k, ok in zip(best, good, strict=True)], [float(min(1.0, p[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, good, strict=True))]


def _labelled(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            label, score = _judge(shared.value, texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return run


def predict_language(docs: DataFrame, network: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred and score of every document: the network reads each whole text, in pieces.

    Null texts, empty texts and texts without a letter are und with score 0. Repeated rows are judged each
    for itself, other columns are not read, empty in, empty out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    kinds = T.StructType([rows.schema["id"], rows.schema["held_out"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_labelled(shared), kinds).withColumnRenamed("id", id_col)


def keep_languages(docs: DataFrame, network: ByteNetwork | None, least: float = 0.35, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that have a language with a probability of at least `least`; without a network, those with a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text_col):
            if shared.value is None:
                yield batch.filter(pa.array([has_letter(x) for x in texts]))
                continue
            label, score = _judge(shared.value, texts)
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(label, score, strict=True)]))

    return docs.mapInArrow(run, docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict_language(docs, train(docs))


QUERIES = {"op6_language_id": op6_language_id}
SQL: dict[str, str] = {}
