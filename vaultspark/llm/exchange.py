"""Columns of numbers moved between tasks as blocks of bytes.

Millions of small records (word, window or line references) are dealt to
buckets as a few rows that hold whole numpy columns. A bucket's columns are
put together and worked on by numpy in one step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Records that a task holds before it passes them on.
HELD = 1 << 19
SCHEMA = "bucket int, n int, block binary"
Columns = list[np.ndarray]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers by place, so that leading zeros lie together and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _numbers(raw: np.ndarray, n: int, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).reshape(n)


def dealt(parts: Iterable[Columns], bucket: Callable[[Columns], np.ndarray], buckets: int, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA from columns, by the bucket of each record; about most of them at once."""
    held: list[Columns] = []

    def out() -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        own = bucket(columns)
        order = np.argsort(own, kind="stable")
        columns, edges = [x[order] for x in columns], np.searchsorted(own[order], np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(edges))
        blocks = [b"".join(_planes(x[edges[k] : edges[k + 1]]) for x in columns) for k in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(np.diff(edges)[some], pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "n", "block"])

    n = 0
    for part in parts:
        if len(part[0]):
            held.append(part)
            n += len(part[0])
        if n >= most:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def gathered(batches: Iterable[pa.RecordBatch], kinds: list[str]) -> Iterator[tuple[int, Columns]]:
    """Each bucket with its columns, from rows of SCHEMA in the order of their buckets."""
    kinds_, held, at = [np.dtype(k) for k in kinds], [], None

    def out() -> tuple[int, Columns]:
        return at, [np.concatenate(x) for x in zip(*held, strict=True)]

    for batch in batches:
        for k, n, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if k != at and held:
                yield out()
                held = []
            at, raw, columns, place = k, np.frombuffer(block.as_buffer(), np.uint8), [], 0
            for kind in kinds_:
                columns.append(_numbers(raw[place : place + n * kind.itemsize], n, kind))
                place += n * kind.itemsize
            held.append(columns)
    if held:
        yield out()


def by_bucket(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def buckets(df: DataFrame) -> int:
    """Four for each shuffle partition, 64 at least."""
    return max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
