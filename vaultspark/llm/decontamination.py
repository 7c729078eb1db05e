"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item's words is indexed by its rarest word alone: a text
that holds the window holds that word, so for exact containment a prefix of
one word is enough. Rarity is counted over all documents. A word of a text
that is in the index gives the only place where the window could start (the
positional filter), the text must have room for it (the length filter), and
the window's words are then compared one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultspark.llm.textvec import ALNUM, LOWER, Texts, lists, map_texts, owner, quoted, tidy

#: Words of a window, and bytes of item texts that are broadcast at a time.
WINDOW = 10
BLOCK_BYTES = 16 << 20


@dataclass
class Index:
    """Windows of some items, ordered by the hash of their rarest word."""

    words: np.ndarray  # windows x WINDOW hashes, 0 beyond a window's length
    length: np.ndarray
    at: np.ndarray  # of the rarest word in its window
    item: np.ndarray
    keys: np.ndarray  # distinct rarest words, ascending
    first: np.ndarray  # the first window of each key
    names: list[str]


def _windows(rows: list[tuple[str, str]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, first = Texts(pa.array([t for _, t in rows], pa.string())).words(ALNUM, LOWER)
    out, length, item = [], [], []
    for k in range(len(rows)):
        own = words[first[k] : first[k + 1]]
        n = min(size, len(own))
        for a in range(len(own) - n + 1 if n else 0):
            w = np.zeros(size, np.uint64)
            w[:n] = own[a : a + n]
            out.append(w)
            length.append(n)
            item.append(k)
    return np.array(out, np.uint64).reshape(-1, size), np.array(length, np.int64), np.array(item, np.int64)


def _spread(table: np.ndarray) -> np.ndarray:
    """A small filter in front of a binary search: which low 16 bits occur."""
    bits = np.zeros(1 << 16, bool)
    bits[(table & np.uint64(0xFFFF)).astype(np.int64)] = True
    return bits


def _find(words: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that are among the ascending keys, and which they are."""
    at = np.flatnonzero(bits[(words & np.uint64(0xFFFF)).astype(np.int64)])
    if not len(keys) or not len(at):
        return at[:0], at[:0]
    k = np.minimum(np.searchsorted(keys, words[at]), len(keys) - 1)
    same = keys[k] == words[at]
    return at[same], k[same]


def _rarity(docs: DataFrame, keys: np.ndarray, text: str) -> np.ndarray:
    """How often each word occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches):
        keys, total = shared.value, None
        bits = _spread(keys)
        total = np.zeros(len(keys), np.int64)
        from vaultspark.llm.textvec import slices

        for batch in batches:
            for a, b in slices(batch.column(0)):
                words, _ = Texts(batch.column(0).slice(a, b - a)).words(ALNUM, LOWER)
                total += np.bincount(_find(words, keys, bits)[1], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["k", "n"])

    found = docs.select(quoted(text).cast("string").alias("t")).mapInArrow(tidy(count), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(keys), np.int64)
    for r in found:
        out[r["k"]] = r["n"]
    return out


def build_index(docs: DataFrame, rows: list[tuple[str, str]], size: int = WINDOW, text: str = "text") -> Index:
    """Index the windows of item rows (item id as text, text)."""
    words, length, item = _windows(rows, size)
    keys = np.unique(words[np.arange(size) < length[:, None]]) if len(words) else np.zeros(0, np.uint64)
    often = _rarity(docs, keys, text) if len(keys) else np.zeros(0, np.int64)
    if len(words):
        count = np.where(np.arange(size) < length[:, None], often[np.minimum(np.searchsorted(keys, words), len(keys) - 1)], np.iinfo(np.int64).max)
        at = count.argmin(1)
        rarest = words[np.arange(len(words)), at]
        order = np.argsort(rarest, kind="stable")
        words, length, item, at, rarest = words[order], length[order], item[order], at[order], rarest[order]
        keys, first = np.unique(rarest, return_index=True)
    else:
        at, first = length, length
    return Index(words, length, at, item, keys, np.append(first, len(words)), [i for i, _ in rows])


def _match(texts: Texts, ix: Index, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's first word; the first word, length and item of every occurrence of a window."""
    words, first = texts.words(ALNUM, LOWER)
    at, key = _find(words, ix.keys, bits)
    n = ix.first[key + 1] - ix.first[key] if len(key) else key
    window = np.repeat(ix.first[key] if len(key) else key, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = np.repeat(at, n) - ix.at[window]
    doc = np.searchsorted(first, np.repeat(at, n), "right") - 1
    fits = (start >= first[doc]) & (start + ix.length[window] <= first[doc + 1])
    start, window = start[fits], window[fits]
    for j in range(ix.words.shape[1]):
        same = (j >= ix.length[window]) | (words[np.minimum(start + j, max(len(words) - 1, 0))] == ix.words[window, j])
        start, window = start[same], window[same]
    return first, start, ix.length[window], ix.item[window]


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> tuple[int, Callable[[int], list[tuple[str, str]]]]:
    """How many blocks the items make that are small enough to be broadcast, and the items of one: the driver holds one at a time."""
    items = benchmark.select(quoted(item).cast("string").alias("i"), quoted(text).cast("string").alias("t")).filter("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    n = max(1, -(-2 * size // limit)) if size > limit else 1
    block = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return n, lambda k: [(r["i"], r["t"]) for r in items.filter(block == k).distinct().collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mark documents that hold windows of benchmark items.

    Adds n_words, n_hit (words inside any occurrence of a window), n_items and
    item_ids (items with an occurring window, as sorted strings), hit_spans
    (first word and length of each occurrence) and contaminated. Item rows of
    null id or text are ignored and repeated ones count once; a null or empty
    text has no words and is not contaminated; repeated rows are each judged.
    Benchmarks beyond block_bytes are matched by blocks, each broadcast in
    turn, and the blocks' hits are united. Input columns of these names are
    replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "n_items", "item_ids", "hit_spans", "contaminated")]
    fields = T.StructType.fromDDL("n_words long, n_hit long, n_items long, item_ids array<string>, hit_spans array<long>, contaminated boolean").fields
    out = docs
    blocks, rows_of = _blocks(benchmark, item, item_text, block_bytes)
    for k in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(build_index(docs, rows_of(k), window, text))

        def kernel(texts: Texts, shared=shared) -> list:
            ix = shared.value
            first, start, length, found = _match(texts, ix, _spread(ix.keys))
            mark = np.zeros(first[-1] + 1, np.int64)
            np.add.at(mark, start, 1)
            np.add.at(mark, start + length, -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
            n_hit = hit[first[1:]] - hit[first[:-1]]
            doc = np.searchsorted(first, start, "right") - 1
            own: list[list[str]] = [[] for _ in range(texts.n)]
            for d, i in set(zip(doc.tolist(), found.tolist(), strict=True)):
                own[d].append(ix.names[i])
            own = [sorted(set(x)) for x in own]
            order = np.lexsort((length, start, doc))
            pairs = np.stack([start[order] - first[doc[order]], length[order]], 1).reshape(-1)
            spans = lists(pairs, 2 * np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=texts.n))]))
            return [np.diff(first), n_hit, [len(x) for x in own], own, spans, n_hit > 0]

        if k == 0:
            out = map_texts(out, kernel, fields, text, kept if text in kept or blocks == 1 else [*kept, text])
            continue
        more = [T.StructField(f"__{f.name}", f.dataType) for f in fields]
        out = map_texts(out, kernel, more, text)
        pairs = F.array_distinct(F.concat(*(F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 2).cast("int")), lambda i, c=c: F.struct(F.get(F.col(c), 2 * i).alias("s"), F.get(F.col(c), 2 * i + 1).alias("n"))) for c in ("hit_spans", "__hit_spans"))))
        pairs = F.array_sort(F.filter(pairs, lambda p: p["s"].isNotNull()))
        covered = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")), lambda a, p: F.struct(F.greatest(a["to"], p["s"] + p["n"]).alias("to"), (a["n"] + F.greatest(F.lit(0).cast("long"), p["s"] + p["n"] - F.greatest(a["to"], p["s"]))).alias("n")))
        out = out.withColumns({"item_ids": F.array_sort(F.array_union("item_ids", "__item_ids")), "n_hit": covered["n"], "hit_spans": F.flatten(F.transform(pairs, lambda p: F.array(p["s"], p["n"])))}).drop(*(f.name for f in more))
        out = out.withColumns({"n_items": F.size("item_ids").cast("long"), "contaminated": F.col("n_hit") > 0})
    return out.select(*(quoted(c) for c in kept), *(f.name for f in fields))
