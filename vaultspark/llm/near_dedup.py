"""Near-duplicate texts by improved consistent weighted sampling.

A text is a weighted set of five-word shingles: a shingle's weight is its
count in the text times an inverse document frequency. Consistent weighted
sampling (r, c from Gamma(2, 1), b uniform, all hashed from the shingle) picks
a shingle and a level so that two texts agree with a probability equal to
their weighted Jaccard similarity. Samples are banded; texts that share a band
are compared with the band's leader, by their exact weighted similarity, and
then, unless links join them already, with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaultspark.llm import graph, sketch, stars
from vaultspark.llm.shared import written
from vaultspark.llm.textvec import SPACED, Texts, lists, map_texts, mix, owner, quoted, shingles, slices, tidy

#: Words of a shingle, similarity of near duplicates, bands, samples of a band, cells of the frequency table, and the most texts and distinct shingles in a part of a bucket.
SHINGLE = 5
SIMILAR = 0.8
BANDS = 12
ROWS = 3
CELLS = 1 << 21
PART = 256
PART_SHINGLES = 500_000

_GAMMA: list[np.ndarray] = []


def _gamma() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 65,536 equal steps, by Newton's method."""
    if not _GAMMA:
        p = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = np.where(p < 0.3, np.sqrt(2 * p), -np.log1p(-p) + 1)
        for _ in range(40):
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
        _GAMMA.append(x.astype(np.float32))
    return _GAMMA[0]


def weighted(texts: Texts, idf: np.ndarray | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, their weights, and each text's first. Without idf: counts."""
    words, first = texts.words(SPACED)
    found, begin, _ = shingles(words, first, size)
    for a, b in zip(begin.tolist(), begin[1:].tolist(), strict=False):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[begin[:-1][np.diff(begin) > 0]] = True
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(found))).astype(np.float32)
    kept = found[at]
    if idf is not None and len(kept):
        weight *= idf[(kept & np.uint64(len(idf) - 1)).astype(np.int64)]
    return kept, weight, np.searchsorted(at, begin)


def frequencies(docs: DataFrame, *, cells: int = CELLS, size: int = SHINGLE, text: str = "text") -> np.ndarray:
    """Inverse document frequencies by cell: 1 + ln(N / df) / ln N, so from 1 to 2, over all texts.

    The spread is bounded so that one common passage can't outweigh, nor one
    rare word decide, the similarity of two texts. A cell counts other shingles
    besides: their expected number, which grows with the corpus, is taken off.
    """
    df = sketch.counted(docs, lambda t: weighted(t, None, size)[0], cells, text).astype(np.float64)
    df -= (df.sum() - df) / max(cells - 1, 1)
    n = max(docs.count(), 3)
    return (1 + np.log(n / np.clip(df, 1, n)) / np.log(n)).astype(np.float32)


def signatures(shingle: np.ndarray, weight: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band hashes of each text that has shingles, as (texts, bands)."""
    some = np.flatnonzero(np.diff(first) > 0)
    cuts = first[some]
    own = np.repeat(np.arange(len(some)), np.diff(np.append(cuts, len(shingle))))
    gamma, log_gamma, log_w = _gamma(), np.log(_gamma()), np.log(weight)
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64))
    out = np.empty((len(some), bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(some), band + 1, np.uint64)
            for row in range(rows):
                h = mix(shingle ^ seeds[band * rows + row])
                r = gamma[(h & np.uint64(0xFFFF)).astype(np.int64)]
                b = (h >> np.uint64(48)).astype(np.float32) * np.float32(1 / 65536)
                level = np.floor(log_w / r + b)
                value = log_gamma[(h >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)] - r * (level - b + 1)
                least = np.minimum.reduceat(value, cuts)
                at = np.flatnonzero(value == least[own])
                at = at[np.searchsorted(own[at], np.arange(len(some)))]
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + (shingle[at] ^ mix(level[at].astype(np.int64).view(np.uint64))))
            out[:, band] = key
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two weighted sets of ascending shingles."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - both
    return both / total if total else 0.0


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(quoted(doc_id).alias("doc_id"), F.unhex(F.md5(quoted(text).cast("string").cast("binary"))).alias("key"))


def _star(rows: DataFrame, by: list[str]) -> DataFrame:
    """Members of each bucket but its leader, with the leader: the least key."""
    lead = rows.groupBy(*by).agg(F.min("key").alias("lead"), F.max("key").alias("last")).filter("lead != last").drop("last")
    return rows.join(lead, by).filter("key != lead").withColumnRenamed("key", "member")


def verified(pairs: DataFrame, texts: DataFrame, idf, similar: float, size: int = SHINGLE) -> DataFrame:
    """lead, member and near: whether their exact similarity reaches the bound."""
    def judge(batches):
        lead, own = None, None
        for batch in batches:
            leads, members = batch.column(0), batch.column(1)
            for a, b in slices(batch.column(2)):
                found, weight, first = weighted(Texts(batch.column(2).slice(a, b - a)), idf.value, size)
                out: tuple[list, list, list] = ([], [], [])
                for k, (x, m) in enumerate(zip(leads.slice(a, b - a).to_pylist(), members.slice(a, b - a).to_pylist(), strict=True)):
                    mine = found[first[k] : first[k + 1]], weight[first[k] : first[k + 1]]
                    if m is None:
                        lead, own = x, (mine[0].copy(), mine[1].copy())
                        continue
                    assert lead == x
                    for to, v in zip(out, (x, m, similarity(own, mine) >= similar), strict=True):
                        to.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.bool_())], names=["lead", "member", "near"])

    return stars.together(pairs, texts).select("lead", "member", "text").mapInArrow(tidy(judge), "lead binary, member binary, near boolean")


def _across(left: list, right: list, similar: float):
    """Links (member, member) of near texts of left and right, rows (member, root, weighted set): those that join two roots. With right the same as left, of its pairs."""
    if not left or not right:
        return
    same = right is left
    items, weight = (np.concatenate([r[2][k] for r in right]) for k in (0, 1))
    own = np.repeat(np.arange(len(right)), [len(r[2][0]) for r in right])
    order = np.argsort(items, kind="stable")
    items, weight, own = items[order], weight[order], own[order]
    totals = np.array([r[2][1].sum(dtype=np.float64) for r in right])
    number: dict[bytes, int] = {}
    theirs = np.array([number.setdefault(r[1], len(number)) for r in right])
    mine = theirs if same else np.array([number.setdefault(r[1], len(number)) for r in left])
    bound = similar - 1e-9  # sums in another order; similarity() decides
    for i, (member, _, (s, w)) in enumerate(left):
        total = w.sum(dtype=np.float64)
        apart = (theirs != mine[i]) & (np.minimum(totals, total) >= bound * np.maximum(totals, total))
        if same:
            apart[: i + 1] = False
        if not apart.any():
            continue
        low = np.searchsorted(items, s, "left")
        n = np.searchsorted(items, s, "right") - low
        at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
        both = np.bincount(own[at], np.minimum(np.repeat(w, n), weight[at]).astype(np.float64), minlength=len(right))
        for j in np.flatnonzero(apart & (both >= bound * (total + totals - both))).tolist():
            if theirs[j] != mine[i] and similarity((s, w), right[j][2]) >= similar:
                yield member, right[j][0]
                old, new = theirs[j], mine[i]
                theirs[theirs == old] = new
                mine[mine == old] = new


def _rest(first: DataFrame, near: DataFrame, banded: DataFrame, texts: DataFrame, idf, similar: float, size: int) -> DataFrame:
    """lead and member of the near pairs of a bucket that no leader has decided, as far as they join classes.

    All members have met their leader. A bucket whose other members are of one
    class has nothing more to say. In any other one each two members of
    different classes are compared: members outside its largest class with
    each other and with that class, in parts that fit a task, a task for each
    two parts. No row is made for a pair.
    """
    roots = graph.components(near, "lead", "member").withColumnsRenamed({"node": "member"})
    sized = banded.select(F.col("key").alias("member"), "shingles")
    rows = first.select("band", "member").join(roots, "member", "left").withColumn("root", F.coalesce("root", "member"))
    counts = rows.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("member")).alias("x"), F.bit_xor(F.xxhash64("member", F.lit(1))).alias("y"))
    mixed = counts.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("kinds > 1")
    mixed = mixed.groupBy("x", "y", "n").agg(F.min_by(F.struct("band", "most"), "band").alias("b")).select("b.band", "b.most")  # buckets of the same members once
    rows = written(rows.join(mixed, "band").join(sized, "member").withColumn("inner", F.col("root") == F.col("most")).drop("most"))

    def parts(which):
        return F.greatest(F.ceil(F.count_if(which) / PART), F.ceil(F.sum(F.when(which, F.col("shingles")).otherwise(0)) / PART_SHINGLES)).cast("int")

    plan = rows.groupBy("band").agg(parts(F.lit(True)).alias("all"), parts(~F.col("inner")).alias("p"), parts(F.col("inner")).alias("q"))
    small, inner, deal = F.col("all") == 1, F.col("inner"), F.xxhash64("member", F.lit(2))
    own = F.when(small, 0).when(inner, F.col("p") + F.pmod(deal, F.col("q"))).otherwise(F.pmod(deal, F.col("p"))).cast("int")
    last = F.when(small, 0).when(inner, F.col("p") - 1).otherwise(F.col("p") + F.col("q") - 1).cast("int")
    met = rows.join(plan, "band").withColumn("own", own).select("band", "member", "root", "own", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    met = met.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("other") < F.col("own")).alias("right"), "member", "root")

    def judge(batches):
        at, sides = None, ([], [])

        def links():
            same = at is not None and at[1] == at[2]
            found = list(_across(sides[0], sides[0] if same else sides[1], similar))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["lead", "member"])

        for batch in batches:
            for a, b in slices(batch.column(6)):
                found, weight, begin = weighted(Texts(batch.column(6).slice(a, b - a)), idf.value, size)
                for k, (band, i, j, right, member, root) in enumerate(zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in range(6)), strict=True)):
                    if at != (band, i, j):
                        yield links()
                        at, sides = (band, i, j), ([], [])
                    sides[right].append((member, root, (found[begin[k] : begin[k + 1]].copy(), weight[begin[k] : begin[k + 1]].copy())))
        yield links()

    dealt = met.join(texts.withColumnRenamed("key", "member"), "member").select("band", "i", "j", "right", "member", "root", "text").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return dealt.mapInArrow(tidy(judge), "lead binary, member binary")


def links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """Links between different texts (lead, member; md5 of each) of a weighted similarity of at least similar.

    First every member of a band's bucket meets its leader. Members that are
    not near it are dealt again by that band and each other one of theirs,
    which parts unlike families that share a bucket, and meet new leaders. Then
    the members of a bucket that links do not join yet are all compared, so
    that any two near texts that share a band are linked or of one class.
    """
    spark = docs.sparkSession
    body = docs.select(quoted(text).cast("string").alias("text")).filter("text is not null")
    idf = spark.sparkContext.broadcast(frequencies(body, size=size))

    def kernel(texts: Texts) -> list:
        shingle, weight, first = weighted(texts, idf.value, size)
        n, parts, at = np.diff(first) > 0, [], 0
        while at < texts.n:  # blocks that a processor's cache holds
            upto = max(at + 1, int(np.searchsorted(first, first[at] + 40_000, "right")) - 1)
            parts.append(signatures(shingle[first[at] : first[upto]], weight[first[at] : first[upto]], first[at : upto + 1] - first[at], bands, rows))
            at = upto
        every = np.concatenate(parts) if parts else np.zeros((0, bands), np.uint64)
        return [lists(every.reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum(n * bands)])), np.diff(first).astype(np.int32)]

    keyed = body.select("text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"))
    signed = map_texts(keyed, kernel, [T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("shingles", T.IntegerType())], keep=["key"])
    banded = written(signed.filter(F.size("bands") > 0).groupBy("key").agg(F.first("bands").alias("bands"), F.first("shingles").alias("shingles")))
    flat = banded.select("key", F.explode("bands").alias("band"))
    first = written(_star(flat, ["band"]))
    pairs = first.select("lead", "member").distinct()
    wanted = pairs.select(F.col("lead").alias("key")).unionByName(pairs.select(F.col("member").alias("key"))).distinct()
    texts = written(_one_each(docs, doc_id, text, wanted))
    done = written(verified(pairs, texts, idf, similar, size))
    failed = first.join(done.filter("not near"), ["lead", "member"], "left_semi").select("band", F.col("member").alias("key"))
    finer = failed.join(banded, "key").select("key", "band", F.explode("bands").alias("other")).filter("band != other")
    fresh = written(_star(finer, ["band", "other"]).select("lead", "member").distinct().join(done, ["lead", "member"], "left_anti"))
    more = verified(fresh, texts, idf, similar, size)
    near = done.unionByName(written(more)).filter("near").select("lead", "member")
    return near.unionByName(written(_rest(first, near, banded, texts, idf, similar, size)))


def _one_each(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """key and text of the wanted keys, one row each; texts are moved of one document a key only."""
    ids = _keyed(docs, doc_id, text).join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("__id"))
    body = docs.select(quoted(doc_id).alias("__id"), quoted(text).cast("string").alias("text"))
    body = body.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    same = body["key"].eqNullSafe(ids["key"]) & body["__id"].eqNullSafe(ids["__id"])
    found = body.join(ids, same, "left_semi").select("key", "text")
    return found.dropDuplicates(["key"])


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """doc_id, key (md5 of the text), root, class_id and class_size of every document.

    Documents are of one class if links of near texts connect them; equal
    texts are. class_id is the least doc_id of the class. A text without a
    word is like equal texts only. A null text is a class of its own, with its
    doc_id as class_id. Ids may be null: such rows have classes, and are
    passed over for class_id unless a class has no other. Repeated rows are
    rows of one class. Extra columns play no part.
    """
    roots = graph.components(links(docs, doc_id=doc_id, text=text, similar=similar), "lead", "member")
    rows = _keyed(docs, doc_id, text)
    rows = rows.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rows = written(rows)
    known = rows.filter("root is not null")
    total = known.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    alone = rows.filter("root is null").select("doc_id", "key", "root", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return known.join(total, "root").select("doc_id", "key", "root", "class_id", "class_size").unionByName(alone)


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The documents less all but one of each class: that of the least doc_id (null last), then of the least text hash. All null texts stay."""
    every = classes(docs, doc_id=doc_id, text=text, similar=similar)
    lost = every.filter("root is not null").select("root", F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("key").alias("k")).alias("s"))
    kept = lost.groupBy("root").agg(F.min("s").alias("s")).select(F.col("s.i").alias("kept_id"), F.col("s.k").alias("kept_key"))
    row, key = F.struct(*(quoted(c) for c in docs.columns)), F.unhex(F.md5(quoted(text).cast("string").cast("binary")))  # no name of the input's can clash
    own = docs.select(row.alias("row"), quoted(doc_id).alias("id"), key.alias("key"))
    same = own["key"].eqNullSafe(kept["kept_key"]) & own["id"].eqNullSafe(kept["kept_id"])
    stays = own.filter("key is not null").join(kept, same, "left_semi").dropDuplicates(["key"])
    return stays.unionByName(own.filter("key is null")).select("row.*")
