"""Words, names of words and shingles, as every operator of this subpackage counts them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

U64 = np.uint64
#: rows taken from an Arrow batch at a time, which bounds the Python copies of texts
SLICE = 1024
#: odd multipliers of the mixing steps; any odd numbers do
M1, M2 = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: bytes.split(), strip() and lower() without arguments mean exactly [\x20\x09-\x0D] and A-Z
WHITE = b" \t\n\v\f\r"


class WordNames:
    """64-bit names of the words ``[^\\x20\\x09-\\x0D]+`` of a text, in order.

    A name is a polynomial over the word's bytes, taken from running sums over the text, so no
    word becomes a Python object. Equal words have equal names in every task. Long texts are
    read in pieces that end between words.
    """

    BASE = 0x5851F42D4C957F2D
    PIECE = 1 << 18

    def __init__(self):
        self.inside = bytes(int(x not in WHITE) for x in range(256))
        self._grow(1 << 14)

    def _grow(self, n: int) -> None:
        def powers(x):
            out = np.full(n, x, U64)
            out[0] = 1
            return np.cumprod(out, dtype=U64)

        self.power, self.back = powers(self.BASE), powers(pow(self.BASE, -1, 1 << 64))

    def __call__(self, text: bytes) -> np.ndarray:
        if len(text) <= self.PIECE:
            return self._piece(text)[0]
        out, at = [], 0
        gaps = np.flatnonzero(np.frombuffer(text.translate(self.inside), np.uint8) == 0)
        while at < len(text):
            i = np.searchsorted(gaps, at + self.PIECE)
            to = int(gaps[i]) if i < len(gaps) else len(text)
            out.append(self._piece(text[at:to])[0])
            at = to
        return np.concatenate(out)

    def grouped(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Names of many texts at once: the first text of a group, names, and bounds of each text's names."""
        first = 0
        while first < len(texts):
            last, size = first + 1, len(texts[first])
            while last < len(texts) and size + len(texts[last]) < self.PIECE:
                size += len(texts[last]) + 1
                last += 1
            if last == first + 1:
                names = self(texts[first])
                yield first, names, np.array([0, len(names)])
            else:
                names, start = self._piece(b"\n".join(texts[first:last]))
                ends = np.cumsum([len(t) + 1 for t in texts[first:last]])
                yield first, names, np.concatenate([[0], np.searchsorted(start, ends)])
            first = last

    def _piece(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        n = len(text)
        if not n:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        if n >= len(self.power):
            self._grow(2 * n)
        inside = np.frombuffer(b"\0" + text.translate(self.inside) + b"\0", np.uint8)
        edges = (inside[1:] != inside[:-1]).nonzero()[0]
        start, end = edges[::2], edges[1::2]
        sums = np.zeros(n + 1, U64)
        np.cumsum(np.frombuffer(text, np.uint8) * self.power[:n], out=sums[1:])
        names = mix((sums.take(end) - sums.take(start)) * self.back.take(start) + (end - start).astype(U64) * M1)
        return names, start


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * M2
    x = (x ^ (x >> U64(29))) * M1
    return x ^ (x >> U64(32))


def shingles(names: np.ndarray, n: int) -> np.ndarray:
    """Names of all runs of ``n`` words, in text order; empty if there are fewer."""
    m = len(names) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    acc = names[:m].copy()
    for j in range(1, n):
        acc *= M1
        acc ^= acc >> U64(29)
        acc += names[j : m + j]
    return mix(acc)


def shingle_set(names: np.ndarray, n: int) -> np.ndarray:
    """Distinct shingles in ascending order; a shorter text is one shingle, no words none."""
    if 0 < len(names) < n:
        return shingles(names, len(names)) ^ U64(len(names))
    return np.unique(shingles(names, n))


def raw(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def per_batch(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]) -> DataFrame:
    """``mapInArrow`` with state: ``make()`` runs once a task, its result once for each ``SLICE`` rows."""

    def run(batches):
        step = make()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                yield from step(b.slice(i, SLICE))
            del b  # before the next one is read
        if hasattr(step, "close"):
            yield from step.close()
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    small_batches(df)
    return df.mapInArrow(run, schema)


def small_batches(df: DataFrame) -> None:
    """Let Arrow hand over at most ``SLICE`` rows at once in this session: texts are long, and both sides hold a batch."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > SLICE:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SLICE))


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str | Column) -> DataFrame:
    """``doc_id, text`` and what else is named: further columns never meet an operator's own."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct ``carry``, to pass through an operator that adds its own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("carry")


def and_row(ddl: str, docs: DataFrame) -> StructType:
    return (StructType.fromDDL(ddl) if ddl else StructType()).add("carry", docs.schema)
