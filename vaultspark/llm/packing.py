"""Packing by power-of-two decomposition.

A document of n tokens is cut into n // 1024 pieces of 1024 and one piece for
each binary digit of the rest, longest first. Each piece is a sequence of its
own, and sequences of equal length form a bucket, so a batch drawn from one
bucket needs no padding and no sequence holds tokens of two documents.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vaultspark.llm.textvec import quoted, slices, tidy

#: Longest sequence, the id that ends a document, and the added tokens of the public 50k vocabulary.
CAPACITY = 1024
END = 0
ADDED = {"<|endoftext|>": 50256}


def encoder(path: str, pattern: str, added: dict[str, int] | None = None):
    """An encoder from a file of byte-level BPE ranks, with added tokens and their ids."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added or {})


def pieces(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of n tokens: capacity, then falling powers of two."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, *, tokenizer: tuple[str, str] | tuple[str, str, dict[str, int]] | None = None, capacity: int = CAPACITY, text: str = "text", keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """Cut every document into pieces, each a sequence of its own.

    One row per piece: the kept columns (all but text), start, length,
    doc_tokens, bucket (log2 of the length), sequence_id (unique in the
    result), offset (0), ids_crc32 of the little-endian 32-bit ids and, with
    with_ids, ids itself. tokenizer: a file of byte-level BPE ranks, its
    split pattern and, if any, its added tokens; by default the public 50k vocabulary, whose ids equal those
    of the tokenizers library's file of the same name. A string that
    names an added token has that token's id. A null text is empty: one piece that
    holds the end id. Repeated rows are packed each. Input columns of the new
    columns' names are replaced.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ADDED
    fields = T.StructType.fromDDL("start long, length long, doc_tokens long, bucket int, sequence_id long, offset long, ids_crc32 long").fields
    if with_ids:
        fields = [*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]
    new = {f.name for f in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new and (c != text or keep)]
    schema = T.StructType([*(docs.schema[c] for c in kept), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        code = encoder(*tokenizer)
        made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b in slices(column):
                row, start, length, total, crc, ids = [], [], [], [], [], []
                for k, t in enumerate(column.slice(a, b - a).to_pylist(), a):
                    own = np.array([*code.encode(t or "", allowed_special="all"), END], "<u4")
                    raw, at = own.tobytes(), 0
                    for n in pieces(len(own), capacity):
                        row.append(k)
                        start.append(at)
                        length.append(n)
                        total.append(len(own))
                        crc.append(zlib.crc32(memoryview(raw)[4 * at : 4 * (at + n)]))
                        at += n
                    if with_ids:
                        ids.append(own)
                n = np.array(length, np.int64)
                columns = [batch.column(k).take(pa.array(row, pa.int64())) for k in range(len(kept))]
                columns += [pa.array(start, pa.int64()), pa.array(n), pa.array(total, pa.int64()), pa.array(np.log2(n).astype(np.int32)), pa.array(made + np.arange(len(n))), pa.array(np.zeros(len(n), np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))))
                made += len(n)
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(*(quoted(c) for c in kept), quoted(text).cast("string").alias("__text")).mapInArrow(tidy(run), schema)


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequences, tokens and padding of each bucket."""
    return packed.groupBy("bucket").agg(F.count(F.lit(1)).alias("sequences"), F.sum("length").alias("tokens"), F.lit(0).cast("long").alias("padding")).orderBy("bucket")
