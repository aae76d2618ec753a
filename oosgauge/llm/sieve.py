"""A bit table of bounded size that lets all wanted 64-bit values pass and few others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oosgauge.llm.text import U64, per_batch

PIECE = 1 << 16


def bit_table(df: DataFrame, column: str, most: int) -> tuple[bytes, int]:
    """Bits at the low bits of the column's values: 16 a value, at most ``most`` in all (a power of two)."""
    n = df.count()
    bits = 8 * PIECE
    while bits < min(most, 16 * n):
        bits *= 2

    def make():
        table = np.zeros(bits // 8, np.uint8)

        class Fill:
            def __call__(self, b):
                slot = b.column(column).to_numpy(zero_copy_only=False).view(U64) & U64(bits - 1)
                np.bitwise_or.at(table, (slot >> U64(3)).astype(np.int64), np.left_shift(1, (slot & U64(7)).astype(np.uint8)).astype(np.uint8))
                return ()

            def close(self):
                for i in range(0, len(table), PIECE):
                    if table[i : i + PIECE].any():
                        yield pa.RecordBatch.from_arrays([pa.array([i // PIECE]), pa.array([table[i : i + PIECE].tobytes()], pa.binary())], ["i", "bits"])

        return Fill()

    def union(key, t):
        out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()], axis=0)
        return pa.table({"i": [key[0].as_py()], "bits": [out.tobytes()]})

    pieces = per_batch(df.select(column), "i long, bits binary", make).groupBy("i").applyInArrow(union, "i long, bits binary")
    table = bytearray(bits // 8)
    for i, part in pieces.toLocalIterator():
        table[i * PIECE : (i + 1) * PIECE] = part
    return bytes(table), bits


def passing(table: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    slot = values & U64(bits - 1)
    return (table[slot >> U64(3)] >> (slot & U64(7)).astype(np.uint8)) & 1 > 0
