"""Vectorised text primitives shared by the corpus operators.

An Arrow batch of texts is one contiguous UTF-8 buffer, so word boundaries,
word hashes and shingles are found for a whole batch with numpy passes over
bytes, without a Python step per word or per row. Every word class used here
is defined on ASCII delimiters; bytes from 0x80 up always belong to words.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts handed to an operator's kernel at once, in bytes; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
_LONG_WORD = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is True for the bytes in the given closed spans."""
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


#: Words are runs of anything but ASCII white space.
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of letters, digits and non-ASCII bytes.
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes as they are, and with A-Z in lower case.
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32


def mapped(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[buf] for bytes, without the wide index that numpy would make."""
    return np.frombuffer(buf.tobytes().translate(table.tobytes()), table.dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of buf[starts:ends], eight bytes of every span at a time."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf if table is SAME else mapped(buf, table)
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    long = np.flatnonzero(left > _LONG_WORD)
    whole = [int.from_bytes(hashlib.blake2b(padded[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little") for k in long]
    left[long] = 0
    with np.errstate(over="ignore"):
        out = (left.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        some, at, h = slice(None), starts, out
        while len(at):
            h = (h ^ (eight[at] & _MASK[np.minimum(left, 8)])) * _BASE
            h ^= h >> np.uint64(29)
            out[some] = h
            more = np.flatnonzero(left > 8)
            some = more if isinstance(some, slice) else some[more]
            at, left, h = at[more] + 8, left[more] - 8, h[more]
    out[long] = np.array(whole, np.uint64)
    return mix(out)


class Texts:
    """Some texts as one byte buffer; null counts as empty."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.n = len(column)
        self.buf = whole[offsets[0] : offsets[-1]] if self.n else whole[:0]
        self.offsets = offsets - offsets[0] if self.n else np.zeros(1, np.int64)

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes of a class, and each text's first run (n + 1 entries)."""
        if not len(self.buf):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n + 1, np.int64)
        word = mapped(self.buf, inside)
        turns = np.flatnonzero(word[1:] != word[:-1]) + 1
        turns = np.concatenate([[0] if word[0] else [], turns, [len(word)] if word[-1] else []]).astype(np.int64)
        starts, ends = turns[0::2], turns[1::2]
        cuts = np.unique(self.offsets[1:-1])
        cuts = cuts[(cuts > 0) & (cuts < len(word))]
        cuts = cuts[word[cuts - 1] & word[cuts]]  # a run ends with its text
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        return starts, ends, np.searchsorted(starts, self.offsets, "left")

    def words(self, inside: np.ndarray, table: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and each text's first word."""
        starts, ends, first = self.spans(inside)
        return hash_spans(self.buf, starts, ends, table), first


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each item, from the texts' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of n successive words of a text (all its words, if fewer but any), each text's first shingle, and the shingles' first words."""
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], made)
    with np.errstate(over="ignore"):
        total = np.zeros(len(at), np.uint64)
        last = np.repeat(first[1:], made)
        for j in range(n):
            here = at + j
            inside = here < last
            total = total * _BASE + np.where(inside, words[np.minimum(here, max(len(words) - 1, 0))] if len(words) else np.uint64(0), np.uint64(j))
    return mix(total), begin, at


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column of about limit bytes each, one row at least."""
    n = len(column)
    if not n:
        return
    sizes = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, upto
        at = upto


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and release() after each of its tasks."""
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def map_texts(df: DataFrame, kernel: Callable[[Texts], list], fields: list[T.StructField], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add the columns that kernel makes of each slice of texts.

    keep: the columns that are carried along (all). One of the name of a new
    column gives way to it. Rows keep their order; one row in, one row out.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in slices(column):
                made = kernel(Texts(column.slice(a, b - a)))
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)]
                rest = [batch.column(k).slice(a, b - a) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*rest, *arrays], names=[*kept, *(f.name for f in arrow)])

    name = "text"
    while name in map(str.lower, kept):
        name += "_"
    return df.select(*(quoted(c) for c in kept), quoted(text).cast("string").alias(name)).mapInArrow(tidy(run), schema)


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A list column from values and each row's first value."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values))
