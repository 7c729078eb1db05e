"""Quality classification by a sparse ensemble of rules.

Statistics are taken of each whole text. Shallow boosted trees are grown on a
sample of labelled texts; every path from a root to a node is a rule, a
conjunction of bounds on statistics. Logistic regression with an L1 penalty
picks and weighs a few rules, and these are compiled into one Spark column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultspark.llm.textvec import SPACED, Texts, byte_class, hash_spans, map_texts, mapped, owner, quoted, shingles

#: Labelled texts to learn from (about), trees, their depth, cut points of a statistic, and rules kept at most.
SAMPLE = 12_000
TREES = 60
DEPTH = 3
CUTS = 24
PENALTIES = (0.03, 0.01, 0.003, 0.001)

_CLASSES = {
    "capitals": byte_class((0x41, 0x5A)),
    "digits": byte_class((0x30, 0x39)),
    "symbols": byte_class((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x3E), (0x5C, 0x5C), (0x5E, 0x60), (0x7B, 0x7E)),
    "marks": byte_class((0x21, 0x21), (0x3F, 0x3F)),
    "points": byte_class((0x2C, 0x2E), (0x3A, 0x3B)),
    "others": byte_class((0x80, 0xFF)),
}
STATISTICS = ["words", "word_length", "word_spread", *_CLASSES, "distinct_words", "twins", "repeats", "line_words", "repeated_lines", "long_words"]
_TURN = ~byte_class((0x0A, 0x0A))


def _share(some: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return some / np.maximum(whole, 1)


def _repeated(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By text: how many items equal an earlier one."""
    doc = owner(first)
    order = np.lexsort((values, doc))
    same = np.zeros(len(values), bool)
    same[1:] = (values[order][1:] == values[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][same], minlength=len(first) - 1)


def measure(texts: Texts) -> list[np.ndarray]:
    """The statistics of each text, in the order of STATISTICS. An empty text has zeros."""
    n = texts.n
    starts, ends, first = texts.spans(SPACED)
    words, doc, size = np.diff(first), owner(first), (ends - starts).astype(float)
    hashes = hash_spans(texts.buf, starts, ends)
    chars = np.bincount(doc, size, n)
    mean = _share(chars, words)
    spread = np.sqrt(np.maximum(_share(np.bincount(doc, size * size, n), words) - mean**2, 0))
    rates = []
    for inside in _CLASSES.values():
        run = np.concatenate([[0], np.cumsum(mapped(texts.buf, inside), dtype=np.int64)])
        rates.append(_share(run[texts.offsets[1:]] - run[texts.offsets[:-1]], chars))
    twin = np.zeros(len(hashes), bool)
    twin[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    five, begin, _ = shingles(hashes, first, 5)
    a, b, line = texts.spans(_TURN)
    lines = np.diff(line)
    return [
        np.log1p(words), mean, spread, *rates, _share(words - _repeated(hashes, first), words), _share(np.bincount(doc[twin], minlength=n), words),
        _share(_repeated(five, begin), np.diff(begin)), np.log1p(_share(words, lines)), _share(_repeated(hash_spans(texts.buf, a, b), line), lines), _share(np.bincount(doc[size > 30], minlength=n), words),
    ]


def measured(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and the statistics of each whole text, each named q_ and the statistic."""
    return map_texts(docs, measure, [T.StructField(f"q_{s}", T.DoubleType()) for s in STATISTICS], text, keep)


Rule = tuple[tuple[int, float, bool], ...]  # statistic, bound, whether above it


def _hits(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, cut, above in rule:
        out &= (x[:, k] > cut) == above
    return out


def _grow(x: np.ndarray, residual: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, depth: int, least: int, rules: list[Rule]) -> list[tuple[Rule, float]]:
    """Split where the squared error falls most; note the paths; return the leaves."""
    r = residual[rows]
    leaf = [(path, float(r.mean()))]
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best, total, n = (1e-9, None), r.sum(), len(rows)
    for k, points in enumerate(cuts):
        if not len(points):
            continue
        place = np.searchsorted(points, x[rows, k], "left")  # points below the value
        below, s = np.cumsum(np.bincount(place, minlength=len(points) + 1))[:-1], np.cumsum(np.bincount(place, r, len(points) + 1))[:-1]
        fits = (below >= least) & (n - below >= least)
        if not fits.any():
            continue
        gain = np.where(fits, s**2 / np.maximum(below, 1) + (total - s) ** 2 / np.maximum(n - below, 1) - total**2 / n, -1)
        j = int(gain.argmax())
        if gain[j] > best[0]:
            best = float(gain[j]), (k, float(points[j]))
    if best[1] is None:
        return leaf
    k, cut = best[1]
    out = []
    for above in (False, True):
        under = (*path, (k, cut, above))
        rules.append(under)
        out += _grow(x, residual, cuts, rows[(x[rows, k] > cut) == above], under, depth - 1, least, rules)
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """The distinct rules of boosted trees, each tree grown on half of the rows."""
    draw, score, rules = np.random.default_rng(seed), np.zeros(len(y)), []
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, CUTS + 2)[1:-1])) for k in range(x.shape[1])]
    cuts = [(np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, 9)[1:-1])])) if len(v := x[x[:, k] > 0, k]) else c) for k, c in enumerate(cuts)]
    least = max(5, len(y) // 500)
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(draw.random(len(y)) < 0.5)
        if len(rows) < 2 * least:
            break
        for path, value in _grow(x, residual, cuts, rows, (), depth, least, rules):
            score += 0.4 * 4 * value * _hits(x, path)
    return list(dict.fromkeys(tuple(sorted(r)) for r in rules))


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty, by accelerated proximal gradient steps; the intercept is free."""
    n = max(len(y), 1)
    rate = 4.0 / max(np.linalg.norm(np.concatenate([a, np.ones((len(a), 1))], 1), 2) ** 2 / n, 1e-9)
    w, b, v, c, t = np.zeros(a.shape[1]), 0.0, np.zeros(a.shape[1]), 0.0, 1.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(a @ v + c))) - y) / n
        nw, nb = v - rate * (a.T @ g), c - rate * g.sum()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


@dataclass
class Ensemble:
    rules: list[tuple[Rule, float]]
    intercept: float

    def column(self) -> Column:
        """The probability of a good text, over the columns of measured()."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for k, cut, above in rule:
                q = F.col(f"q_{STATISTICS[k]}")
                holds &= q > cut if above else q <= cut
            total += F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Grow rules and weigh them; the penalty is the one with the least loss on every fifth row.

    With labels of one kind alone, or none, the score is that share of good ones (one half).
    """
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble([], float(np.log(share / (1 - share))))
    test = np.arange(len(y)) % 5 == 0
    if len(y) < 50 or len(set(y[~test])) < 2:
        test[:] = False
    rules = grow_rules(x[~test], y[~test])
    a = np.stack([_hits(x, r) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    best = None
    for penalty in PENALTIES:
        w, b = lasso(a[~test], y[~test], penalty)
        z = a[test] @ w + b if test.any() else a @ w + b
        loss = float(np.mean(np.logaddexp(0, z) - y[test if test.any() else slice(None)] * z))
        if best is None or loss < best[0]:
            best = loss, w, b
    _, w, b = best
    return Ensemble([(r, float(v)) for r, v in zip(rules, w, strict=True) if v], b)


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", text: str = "text", sample: int = SAMPLE) -> Ensemble:
    """Learn from about sample labelled documents, chosen by a hash of their key. Null labels and keys are left out."""
    known = labels.select(quoted(key).alias("__k"), quoted(label).cast("int").alias("__y")).filter("__k is not null and __y is not null")
    n = known.count()
    chosen = known.filter(F.pmod(F.xxhash64("__k"), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)))
    rows = docs.select(quoted(key).alias("__k"), quoted(text).alias("__t")).join(F.broadcast(chosen), "__k")  # about sample short rows
    found = measured(rows, text="__t", keep=["__k", "__y"]).orderBy("__k").toPandas()
    return fit(found[[f"q_{s}" for s in STATISTICS]].to_numpy(float), found["__y"].to_numpy(float))


def score(docs: DataFrame, ensemble: Ensemble, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 up) of each whole text.

    A null text is scored as an empty one. Input columns of these names, and
    of the statistics' names (q_...), are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted") and not (c.startswith("q_") and c[2:] in STATISTICS)]
    found = measured(docs, text=text, keep=kept)
    return found.select(*(quoted(c) for c in kept), ensemble.column().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
