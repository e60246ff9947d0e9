"""Corpus tables of fixed size: integer counts that every task adds up and Spark sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..core.scratch import Scratch
from . import batches as B

_BLOCK = 1 << 14


def blocks(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(number, packed cells) of the blocks of an integer table that aren't zero."""
    whole = np.zeros(-(-len(table) // _BLOCK) * _BLOCK, np.int64)
    whole[: len(table)] = table
    parts = whole.reshape(-1, _BLOCK)
    for at in np.flatnonzero(parts.any(axis=1)):
        yield int(at), _packed(parts[at])


def add_up(parts: DataFrame, size: int, scratch: Scratch | None = None) -> np.ndarray:
    """The sum of tables of ``size`` cells that ``parts`` (block, cells) hold in blocks, added up block by block as a stream.

    With ``scratch`` the sum is written there first, so that the shuffle files of ``parts`` are gone when it is there.
    """

    def total(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in it:
            for at, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at in held:
                    held[at] += _unpacked(cells)
                else:
                    held[at] = _unpacked(cells)
        for at, cells in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["block", "cells"])

    n = -(-size // _BLOCK)
    tasks = max(1, min(n, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = np.zeros((n, _BLOCK), np.int64)
    summed = parts.repartition(tasks, F.col("block")).mapInArrow(total, "block int, cells binary")
    held = scratch.save(summed, "sums") if scratch else None
    for row in (held or summed).collect():
        out[row.block] = np.frombuffer(row.cells, np.int64)
    if scratch:
        scratch.drop(held)
    return out.reshape(-1)[:size]


def corpus_table(df: DataFrame, size: int, add: Callable[[list[str], np.ndarray], None], text: str = "text") -> np.ndarray:
    """The sum over all rows of what ``add(texts, table)`` adds to an integer table of ``size`` cells.

    Each task holds one table and sends its blocks that aren't zero; a second stage sums the
    blocks as a stream, one block's cells at a time. The sums are of integers, so they don't
    depend on the order of rows or tasks. ``size`` is a parameter of the model, not of the data;
    only the finished table comes to the driver.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.zeros(size, np.int64), False
        for batch in B.cut(it, text):
            add(B.texts(batch, text), table)
            seen = True
        if seen:
            for at, cells in blocks(table):
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([cells], pa.binary())], names=["block", "cells"])

    return add_up(df.select(text).mapInArrow(count, "block int, cells binary"), size)


def _packed(cells: np.ndarray) -> bytes:
    """The cells in the narrowest of 1, 2, 4 and 8 bytes that holds them, after a byte that tells the width."""
    most = int(np.abs(cells).max())
    width = next(w for w in (1, 2, 4, 8) if w == 8 or most < 1 << (8 * w - 1))
    return bytes([width]) + cells.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64)
