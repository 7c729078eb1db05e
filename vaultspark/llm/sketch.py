"""Counts of hashed items over a whole corpus, in a table of fixed size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.textvec import Texts, quoted, slices, tidy

_BLOCK = 1 << 15


def marked(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value modulo bits (a power of two) of a column of longs, 8 to a byte, in a table of fixed size.

    A value of the column has its bit set; so may others, the more the fuller
    the table is: it narrows a search and never decides one.
    """
    def mark(batches):
        table = np.zeros(bits, bool)
        for batch in batches:
            table[np.asarray(batch.column(0)).view(np.uint64) & np.uint64(bits - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.packbits(table).tobytes()], pa.binary())], names=["block", "bits"])

    def either(batches):
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for x in batch.column(1):
                table |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([table.tobytes()], pa.binary())], names=["block", "bits"])

    found = rows.filter(F.col(column).isNotNull()).select(column).mapInArrow(tidy(mark), "block int, bits binary").coalesce(8).mapInArrow(tidy(either), "block int, bits binary").collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in found:
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def is_marked(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether the values' bits are set."""
    at = values & np.uint64(8 * len(table) - 1)
    return (table[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def counted(docs: DataFrame, items: Callable[[Texts], np.ndarray], cells: int, text: str = "text") -> np.ndarray:
    """How many items of all texts fall into each cell (hash modulo cells, a power of two).

    Each partition counts into a table of its own; tables are added up block
    by block on the executors. The result has 4 bytes a cell whatever the
    corpus, so it may be sent to all of them. A cell's count is at least that
    of each of its items.
    """
    def count(batches):
        table, waiting, n = np.zeros(cells, np.int64), [], 0
        for batch in batches:
            for a, b in slices(batch.column(0)):
                waiting.append((items(Texts(batch.column(0).slice(a, b - a))) & np.uint64(cells - 1)).astype(np.uint32))
                n += len(waiting[-1])
                if n > cells // 4:
                    table += np.bincount(np.concatenate(waiting), minlength=cells)
                    waiting, n = [], 0
        if n:
            table += np.bincount(np.concatenate(waiting), minlength=cells)
        table = np.minimum(table, 0xFFFFFFFF).astype("<u4").reshape(-1, min(_BLOCK, cells))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(table)), pa.int32()), pa.array([x.tobytes() for x in table], pa.binary())], names=["block", "counts"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_buffer(), "<u4").astype(np.uint64)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in total.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    rows = docs.select(quoted(text).cast("string").alias("t")).mapInArrow(tidy(count), schema).repartition("block").mapInArrow(tidy(add), schema).collect()
    out = np.zeros((max(1, cells // _BLOCK), min(_BLOCK, cells)), np.uint32)
    for r in rows:
        out[r["block"]] = np.frombuffer(r["counts"], "<u4")
    return out.reshape(-1)
