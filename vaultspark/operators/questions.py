"""Understanding of questions: repair, expansion, correction, routing."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultspark import lexicons as L
from vaultspark.functions.strings import any_of, rx

#: Least similarity of a correction, and the shortest word that is corrected.
CLOSE, SHORTEST = 0.85, 5


def repair(q: Column) -> Column:
    """Digits inside words as letters, `rn` before a vowel as `m`, white space runs as one space."""
    for a, b in L.CHARACTER_FIXES:
        q = F.regexp_replace(q, f"(?<=[a-zA-Z]){a}(?=[a-zA-Z])", b)
    return F.regexp_replace(F.regexp_replace(q, rx(r"\brn(?=[aeiou])"), "m"), rx(r"\s{2,}"), " ")


def expand(q: Column) -> Column:
    """Whole-word abbreviations as terms, in the list's order."""
    return reduce(lambda c, p: F.regexp_replace(c, rx(rf"\b{p[0]}\b", "i"), p[1]), L.ABBREVIATIONS, q)


@F.pandas_udf(T.StringType())
def correct(q: pd.Series) -> pd.Series:
    """Words near one of the vocabulary become it; the sequence matcher's ratio has no counterpart in SQL."""
    import difflib
    import re
    from functools import lru_cache

    @lru_cache(maxsize=100_000)
    def one(word: str) -> str:
        bare = re.sub(r"[^a-zA-Z]", "", word).lower()
        near = difflib.get_close_matches(bare, L.VOCABULARY, n=1, cutoff=CLOSE) if len(bare) >= SHORTEST else []
        return near[0] if near and near[0] != bare else word

    return q.map(lambda s: None if s is None else " ".join(one(w) for w in s.split()))


def normalise(questions: DataFrame, question: str = "question", to: str = "normalised", passes: int = 1) -> DataFrame:
    """Repair, expand and correct, once or again (it is not idempotent)."""
    out = questions.withColumn(to, F.col(question))
    for _ in range(passes):
        out = out.withColumn(to, correct(expand(repair(F.col(to)))))
    return out


def question_class(q: Column) -> Column:
    t, out = F.lower(q), F
    for name, _, terms in L.ROUTES:
        out = out.when(any_of(t, terms), name)
    return out.otherwise(L.DEFAULT_CLASS)


def route(questions: DataFrame, question: str = "question") -> DataFrame:
    """Add query_class and route."""
    where = F
    for name, agent, _ in L.ROUTES:
        where = where.when(F.col("query_class") == name, agent)
    return questions.withColumn("query_class", question_class(F.col(question))).withColumn("route", where.otherwise(L.DEFAULT_ROUTE))
