"""Words and word n-grams of many texts at once, as 64-bit hashes in numpy arrays.

A word's hash is a polynomial over random values of its bytes, read off one running sum per
block of texts; no step loops over words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, BLOCK + BLOCK // 4)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.full(m, x, np.uint64)) for x in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_class(pattern: str) -> np.ndarray:
    """Of 256 bytes, which match; bytes from 0x80 on count as characters outside ASCII."""
    import re

    return np.array([bool(re.fullmatch(pattern, chr(b) if b < 128 else "é")) for b in range(256)])


class Words:
    """The words of a few texts: their document, place in the block and hash."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray):
        self.n_docs = len(texts)
        self.raw = b"\n".join(x.lower() for x in texts)  # bytes.lower() maps A-Z only
        buf = np.frombuffer(self.raw, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = is_word[buf]
        step = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.doc = np.searchsorted(self.doc_start, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        up, down = powers(len(buf) + 1)
        run = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_TABLE[buf] * up[:-1], out=run[1:])
        self.hash = mix((run[self.ends] - run[self.starts]) * down[self.starts])

    def grams(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of every run of q words inside one document, by document."""
        n = len(self.hash) - q + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, q, np.uint64)
        for i in range(q):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + self.hash[i : n + i])
        whole = self.doc[:n] == self.doc[q - 1 :]
        return self.doc[:n][whole], h[whole]


def release() -> None:
    """Give what numpy and Arrow have freed back to the system: workers stay alive between stages, and memory that
    each of them keeps for itself is missing elsewhere in the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut into runs of whole rows with about limit bytes of text; a null text is empty."""
    for batch in batches:
        first, size, held = 0, 0, []
        for at in range(0, batch.num_rows, 256):  # a batch's texts are not all held twice
            for t in batch.column(column).slice(at, 256).cast(pa.binary()).to_pylist():
                t = t or b""
                if held and size + len(t) > limit:
                    yield batch.slice(first, len(held)), held
                    first, size, held = first + len(held), 0, []
                held.append(t)
                size += len(t)
        if held:
            yield batch.slice(first), held
    release()
