"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent n-grams (1 to 3 characters of a word that
is padded with a space at both ends, lower case, letters only) by falling
frequency. A text goes to the language with the least out-of-place distance:
the sum, over the text's n-grams, of the difference between the ranks in both
profiles, or the profile's length where the language lacks the n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultspark.llm.textvec import Texts, map_texts, quoted, slices, tidy

#: N-grams of a profile, longest n-gram, and texts a language that a profile is learned from (about).
PROFILE = 300
LONGEST = 3
SAMPLE = 3000
UNDECIDED = "und"


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter or mark, or 0; and whether it is a letter."""
    import unicodedata

    out, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x32400):  # no letters beyond
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            low = chr(c).lower()
            out[c], letter[c] = ord(low) if len(low) == 1 else c, kind == "L"
    return out, letter


_TABLE: list[tuple[np.ndarray, np.ndarray]] = []


def _table() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLE:
        _TABLE.append(_letters())
    return _TABLE[0]


def grams(text: str, longest: int = LONGEST) -> np.ndarray:
    """All n-grams of a text, 21 bits a character; 1 stands for the space between words. None if it has marks but no letter."""
    points, (table, letter) = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), _table()
    if not letter[points].any():
        return np.zeros(0, np.int64)
    letters = table[points].astype(np.int64)
    letters = np.concatenate([[0], letters, [0]])
    keep = letters > 0
    keep[1:] |= letters[:-1] > 0  # one space for a run of others
    keep[0] = True
    x = letters[keep]
    if len(x) < 2:
        return x[:0]
    y = np.maximum(x, 1)  # a space in a code is 1, so that " ab" is not "ab"
    out, code = [x[x > 0]], y
    for n in range(2, longest + 1):
        code = (code[:-1] << 21) | y[n - 1 :]
        inner = np.ones(len(code), bool)
        for j in range(1, n - 1):
            inner &= x[j : j + len(code)] > 0
        out.append(code[inner])
    return np.concatenate(out)


def ranked(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    x = np.sort(codes)
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    n = np.diff(np.append(edge, len(x)))
    values = x[edge]
    if len(n) > size:
        least = np.partition(n, len(n) - size)[len(n) - size]
        some = n >= least
        values, n = values[some], n[some]
    return values[np.argsort(-n, kind="stable")][:size]


@dataclass
class Profiles:
    """Ranks of the known n-grams by language."""

    languages: list[str]
    known: np.ndarray  # ascending codes
    rank: np.ndarray  # languages x (known + 1); the last column stands for all others
    size: int


def learn(labelled: DataFrame, *, text: str = "text", lang: str = "lang", sample: int = SAMPLE, size: int = PROFILE, longest: int = LONGEST) -> Profiles:
    """Learn a profile for each non-null language that has a text with a letter.

    About sample distinct texts of each language are used (all, if it has no
    more), chosen by a hash of the text, so that the sample depends neither on
    the order of rows nor on copies. Texts without a letter say nothing and
    are not counted. N-grams of
    the sampled texts are counted per partition and added up by Spark.
    """
    rows = labelled.select(quoted(lang).cast("string").alias("l"), quoted(text).cast("string").alias("t")).filter("l is not null and t is not null")
    rows = rows.filter(F.col("t").rlike(r"\p{L}")).withColumn("h", F.xxhash64("t"))
    counts = {r["l"]: r["n"] for r in rows.select("l", "h").distinct().groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Profiles([], np.zeros(0, np.int64), np.zeros((0, 1), np.int64), size)
    share = F.create_map(*(F.lit(x) for l, n in counts.items() for x in (l, min(1.0, sample / n))))
    chosen = rows.filter(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("l")) * (1 << 20)).dropDuplicates(["l", "h"]).select("l", "t")

    def count(batches):
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part: dict[str, list] = {}
                for l, t in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    part.setdefault(l, []).append(grams(t, longest))
                for l, many in part.items():
                    codes, n = np.unique(np.concatenate(many), return_counts=True)
                    if l in total:
                        codes, back = np.unique(np.concatenate([total[l][0], codes]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([total[l][1], n])).astype(np.int64)
                    total[l] = codes, n
        for l, (codes, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([l] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["l", "g", "n"])

    summed = chosen.mapInArrow(tidy(count), "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))  # cut to size in each partition first
    tops = summed.withColumn("place", place).filter(F.col("place") <= size).select("l", "place", "g").collect()
    profiles = {l: np.array([g for _, g in sorted((r["place"], r["g"]) for r in tops if r["l"] == l)], np.int64) for l in sorted({r["l"] for r in tops})}
    known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
    rank = np.full((len(profiles), len(known) + 1), -1, np.int64)
    for k, codes in enumerate(profiles.values()):
        rank[k, np.searchsorted(known, codes)] = np.arange(len(codes))
    return Profiles(list(profiles), known, rank, size)


def judge(text: str | None, p: Profiles, longest: int = LONGEST) -> tuple[str, float]:
    """The nearest language and how near it is: 1 less its distance over the greatest possible."""
    codes = grams(text or "", longest)
    if not len(codes) or not p.languages:
        return UNDECIDED, 0.0
    top = ranked(codes, p.size)
    at = np.minimum(np.searchsorted(p.known, top), len(p.known) - 1)
    rank = p.rank[:, np.where(p.known[at] == top, at, len(p.known))]
    distance = np.where(rank >= 0, np.abs(rank - np.arange(len(top))), p.size).sum(1)
    best = int(distance.argmin())
    return p.languages[best], float(1 - distance[best] / (p.size * len(top)))


def identify(docs: DataFrame, profiles: Profiles, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score (0 to 1) of each whole text.

    A text that is null, or has no letter, is `und` with score 0, as is every
    text if no language was learned; equal distances go to the language that
    sorts first. Input columns of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def kernel(texts: Texts) -> list:
        raw, o = texts.buf.tobytes(), texts.offsets.tolist()
        found = [judge(raw[a:b].decode("utf-8", "replace"), shared.value) for a, b in zip(o, o[1:], strict=False)]
        return [[x for x, _ in found], [x for _, x in found]]

    return map_texts(docs, kernel, T.StructType.fromDDL("lang_pred string, score double").fields, text, keep)


def held_out(doc_id: Column, of: int = 3) -> Column:
    """Whether crc32 of the id as text leaves 1; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of)) == 1, F.lit(False))
