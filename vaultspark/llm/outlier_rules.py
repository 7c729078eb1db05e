"""Quality rules: robust multivariate outliers.

Statistics of each text are transformed into a vector, and for each language
and source the minimum covariance determinant is estimated: from each of
several starts the mean and covariance of the closest three quarters of the
vectors are taken again and again (concentration steps) until the determinant
falls no more, and the estimate of least determinant wins. A fixed least
variance is added to each diagonal before the determinant is taken, so that
groups of few rows or without spread have one, too. A vector far from its group's
centre by Mahalanobis distance is rejected. All of it is DataFrame
operations; groups are aggregated partially before any shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.shared import written
from vaultspark.llm.textvec import quoted

#: Part of a group that the estimate is made of, the fall of a log determinant that asks for another concentration step, the most steps of a start, and the chi-squared level beyond which a vector is rejected.
CORE = 0.75
FALL = 1e-3
STEPS = 12
LEVEL = 0.99
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACE = r"[\x20\x09-\x0D]"
#: Words that count beside a text's own, so that short texts have no extreme rates; and the least deviation of each statistic.
_PRIOR = 50.0
SCALE = {"z_length": 0.10, "z_symbols": 0.07, "z_lines": 0.12, "z_repeats": 0.12, "z_capitals": 0.10}


def statistics(docs: DataFrame, *, text: str = "text", keep: Sequence[str] = ("doc_id", "lang", "source")) -> DataFrame:
    """The kept columns, the base counts, n_lines and n_capitals (A-Z and exclamation marks) of each whole text. Null: none of each."""
    t, none = F.coalesce(quoted(text).cast("string"), F.lit("")), F.array().cast("array<long>")
    one = docs.select(*(quoted(c) for c in keep), t.alias("__t"), F.trim(F.regexp_replace(t, f"{_SPACE}+", " ")).alias("__n"))
    two = one.select(
        *(quoted(c) for c in keep),
        F.length(F.replace("__n", F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length("__t") - F.length(F.regexp_replace("__t", "[A-Z!]+", ""))).cast("long").alias("n_capitals"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(f"[^{_SPACE[1:-1]}]")).alias("__l"),
        F.when(F.col("__n") == "", F.array().cast("array<string>")).otherwise(F.split("__n", " ")).alias("__w"),
    )
    n = F.size("__w")
    three = two.select(
        *(quoted(c) for c in keep), "word_chars", "n_symbols", "n_capitals",
        n.cast("long").alias("n_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("__w", i, 5)))).otherwise(none).alias("__h"),
    )
    repeated = F.size(F.array_distinct("__h")) < F.size("__h")
    pairs = F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    four = three.withColumn("__s", F.when(repeated, pairs)).drop("__h")
    twin = F.filter("__s", lambda x, j: F.coalesce(x["h"] == F.get("__s", j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("__s", j + 1)["h"], F.lit(False)))
    five = four.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.transform(twin, lambda x: x["p"])))).drop("__s")
    covered = F.aggregate(F.transform("__p", lambda p, j: F.coalesce(F.least(F.lit(5), F.get("__p", j + 1) - p), F.lit(5)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return five.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__p")


def vectors(stats: DataFrame) -> DataFrame:
    """Add the transformed statistics: a log mean and angles of rates."""
    def angle(k: str, n: Column, rate: float) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), (F.col(k) + _PRIOR * rate) / (n + _PRIOR))))

    words, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return stats.withColumns({
        "z_length": F.log((chars + 5 * _PRIOR) / (words + _PRIOR)),
        "z_symbols": angle("n_symbols", chars, 0.01),
        "z_lines": angle("n_dup_lines", lines, 0.01),
        "z_repeats": angle("n_repeat_words", words, 0.01),
        "z_capitals": angle("n_capitals", chars, 0.05),
    })


def chi2(x: float, p: int) -> float:
    """The chi-squared distribution function, by the series of the incomplete gamma function."""
    a, h = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= h / k
        total += term
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a)) if h > 0 else 0.0


def chi2_quantile(level: float, p: int) -> float:
    a, b = 0.0, 1e4
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if chi2(m, p) < level else (a, m)
    return b


def _moments(rows: DataFrame, by: list[str], z: list[str], weight: Column) -> DataFrame:
    """Per group: means and the lower Cholesky factor of the covariance of the rows that weight is true for, with the least deviations on its diagonal, and the log of its determinant."""
    def over(x: Column) -> Column:
        return F.avg(F.when(weight, x))

    sums = [over(F.col(a)).alias(f"m_{i}") for i, a in enumerate(z)] + [over(F.col(a) * F.col(b)).alias(f"c_{i}_{j}") for i, a in enumerate(z) for j, b in enumerate(z[: i + 1])]
    found = rows.groupBy(*by).agg(*sums)
    p = len(z)
    wide = CORE / chi2(chi2_quantile(CORE, p), p + 2)  # the core's covariance is too small by this
    for i in range(p):
        for j in range(i + 1):
            c = (F.col(f"c_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * wide + (SCALE[z[i]] ** 2 if i == j else 0.0)
            rest = c
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            found = found.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    determinant = 2 * sum((F.log(f"l_{i}_{i}") for i in range(p)), F.lit(0.0))
    return found.select(*by, *(f"m_{i}" for i in range(p)), *(f"l_{i}_{j}" for i in range(p) for j in range(i + 1)), determinant.alias("log_det"))


def _joined(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the columns of their group; null is a group, too."""
    g = groups.withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(g, same, "left").drop(*(f"__{c}" for c in by))


def _distance(rows: DataFrame, groups: DataFrame, by: list[str], z: list[str]) -> DataFrame:
    """Rows with their squared Mahalanobis distance d2."""
    out, own = _joined(rows, groups.drop("log_det"), by), [c for c in groups.columns if c not in (*by, "log_det")]
    for i, a in enumerate(z):
        y = F.col(a) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"y_{i}") ** 2 for i in range(len(z))), F.lit(0.0))).drop(*own, *(f"y_{i}" for i in range(len(z))))


def estimates(sound: DataFrame, by: list[str], z: list[str]) -> DataFrame:
    """The centre and spread (as _moments has them) of least determinant of each group.

    Starts: the vectors closest to the medians, in median deviations, by the
    sum of squares and by the greatest one, and all vectors. A step never
    raises a group's determinant by more than its approximate quantile does; each
    start goes on while it falls for any group, and every step's estimate is a
    candidate (a row a group).
    """
    middle = written(sound.groupBy(*by).agg(*(F.percentile_approx(a, 0.5, 1000).alias(f"q_{a}") for a in z)))
    spread = _joined(sound, middle, by)
    away = written(spread.groupBy(*by).agg(*(F.max(f"q_{a}").alias(f"q_{a}") for a in z), *(F.percentile_approx(F.abs(F.col(a) - F.col(f"q_{a}")), 0.5, 1000).alias(f"s_{a}") for a in z)))
    off = [F.abs(F.col(a) - F.col(f"q_{a}")) / F.greatest(1.4826 * F.col(f"s_{a}"), F.lit(SCALE[a])) for a in z]
    scaled = _joined(sound, away, by)
    found = None
    for start in (sum((u**2 for u in off), F.lit(0.0)), F.greatest(*off), F.lit(0.0)):
        near, last = scaled.withColumn("d2", start).select(*by, *z, "d2"), None
        for _ in range(STEPS):
            cut = written(near.groupBy(*by).agg(F.percentile_approx("d2", CORE, 1000).alias("cut")))
            groups = written(_moments(_joined(near, cut, by), by, z, F.col("d2") <= F.col("cut")))
            found = groups if found is None else found.unionByName(groups)
            if last is not None and _joined(groups, last.select(*by, F.col("log_det").alias("was")), by).filter(F.col("log_det") < F.col("was") - FALL).isEmpty():
                break
            near, last = _distance(sound, groups, by, z), groups
    rest = [c for c in found.columns if c not in by]
    best = found.groupBy(*by).agg(F.min(F.struct("log_det", *(c for c in rest if c != "log_det"))).alias("b"))
    return written(best.select(*by, *(F.col(f"b.{c}") for c in rest if c != "log_det")))


def judge(docs: DataFrame, *, text: str = "text", by: Sequence[str] = ("lang", "source"), keep: Sequence[str] = ("doc_id",), level: float = LEVEL) -> DataFrame:
    """Base counts, base_failed, d2 (squared distance from the group's centre) and kept, for each document.

    base_failed: under 10 words, or over 20 % of words in repeated 5-word
    windows; such rows do not shape the estimates, have no d2 and are not
    kept. Null language or source is a group of its own. Groups of any size
    are judged: least deviations stand in where a group has too few rows or
    no spread. Repeated rows are each judged; extra columns play no part.
    """
    by, z = list(by), list(SCALE)
    stats = statistics(docs, text=text, keep=list(dict.fromkeys([*keep, *by])))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = written(vectors(stats).withColumn("base_failed", failed))
    sound = rows.filter(~F.col("base_failed")).select(*by, *z)
    far = _distance(rows, estimates(sound, by, z), by, z)
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= chi2_quantile(level, len(z)))
    return far.select(*(quoted(c) for c in keep), *BASE, "base_failed", kept.alias("kept"), d2.alias("d2"))
