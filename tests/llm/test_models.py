"""Outliers, shards, the language model and the pipeline."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import edge, none
from tests.llm.test_duplicates import jaccard, plain_lines, roots
from tests.llm.test_text_operators import plain_hits
from vaultspark.llm import language_id, outlier_rules, packing, recurrent_lm, sharding

SPACE = r"[^\x20\x09-\x0D]+"


def base(text):
    t = text or ""
    w = re.findall(SPACE, t)
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def test_base_rules_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    extra = edge(spark).select("doc_id", "text", "lang", "source").filter("doc_id <> 6").withColumn("doc_id", F.col("doc_id") + 10**6).dropDuplicates(["doc_id"])
    text = {r["doc_id"]: r["text"] for r in docs.unionByName(extra).collect()}
    got = outlier_rules.judge(docs.unionByName(extra)).collect()
    assert len(got) == len(text)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(text[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_outliers_go_and_others_stay(spark):
    draw = np.random.default_rng(0)
    plain = [(k, " ".join("".join(draw.choice(list("abcdefgh"), draw.integers(2, 9))) for _ in range(200)), "en", "s") for k in range(60)]
    odd = [(100, " ".join(w + "###" for w in plain[0][1].split()), "en", "s"), (101, plain[1][1].upper(), "en", "s")]
    got = {r["doc_id"]: r["kept"] for r in outlier_rules.judge(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[100] and not got[101] and all(got[k] for k in range(60))


def test_distances_against_numpy(spark):
    """Starts, concentration steps and the least determinant by hand, for two groups of which one has outliers that lie together."""
    draw = np.random.default_rng(4)
    rows = [(k, "en" if k % 2 else None, "s", *draw.normal([1.6, 0.1, 0.1, 0.1, 0.2], [0.3, 0.1, 0.2, 0.15, 0.1]).tolist()) for k in range(400)]
    rows += [(400 + k, "en", "s", *draw.normal([3.0, 1.0, 0.1, 0.1, 0.9], 0.05).tolist()) for k in range(40)]
    z = list(outlier_rules.SCALE)
    df = spark.createDataFrame(rows, "k long, lang string, source string, " + ", ".join(f"{c} double" for c in z))
    found = outlier_rules.estimates(df, ["lang", "source"], z)
    got = {r["k"]: r["d2"] for r in outlier_rules._distance(df, found, ["lang", "source"], z).collect()}
    least = np.array([outlier_rules.SCALE[c] for c in z])
    wide = outlier_rules.CORE / outlier_rules.chi2(outlier_rules.chi2_quantile(outlier_rules.CORE, 5), 7)
    nth = lambda v, q: np.sort(v)[max(int(np.ceil(q * len(v))) - 1, 0)]
    for lang in ("en", None):
        ks = [r[0] for r in rows if r[1] == lang]
        x = np.array([r[3:] for r in rows if r[1] == lang])
        q = np.array([nth(c, 0.5) for c in x.T])
        u = np.abs(x - q) / np.maximum(1.4826 * np.array([nth(c, 0.5) for c in np.abs(x - q).T]), least)
        best = None
        for d in ((u**2).sum(1), u.max(1), np.zeros(len(x))):
            last = None
            for _ in range(outlier_rules.STEPS):
                own = x[d <= nth(d, outlier_rules.CORE)]
                mean, cov = own.mean(0), np.cov(own.T, bias=True) * wide + np.diag(least**2)
                det = np.linalg.slogdet(cov)[1]
                d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
                best = min([b for b in (best, (det, d.tolist())) if b is not None])
                if last is not None and det >= last - outlier_rules.FALL:
                    break
                last = det
        assert [got[k] for k in ks] == pytest.approx(best[1], rel=1e-6)
    assert min(got[k] for k in range(400, 440)) > 3 * max(got[k] for k in range(400))


def test_a_long_text_among_others(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    docs = spark.createDataFrame([(k, "en", "s", long if k == 7 else " ".join(f"t{k}x{j}" for j in range(60))) for k in range(20)], "doc_id long, lang string, source string, text string")
    got = {r["doc_id"]: r for r in outlier_rules.judge(docs).collect()}
    assert (got[7]["n_words"], got[7]["word_chars"], got[7]["n_repeat_words"], got[7]["base_failed"]) == base(long)[:2] + base(long)[4:]


def test_chi_squared():
    assert outlier_rules.chi2(outlier_rules.chi2_quantile(0.95, 5), 5) == pytest.approx(0.95)
    assert outlier_rules.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def test_outliers_of_odd_rows(spark):
    got = outlier_rules.judge(edge(spark).filter("doc_id is null or doc_id <> 6"))
    assert got.count() == 12 and got.filter("kept is null or base_failed is null").count() == 0
    assert outlier_rules.judge(none(spark)).count() == 0


def check_shards(rows, shards):
    for k in range(shards):
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own)))


def test_shards(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs, 24).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert len(rows) == docs.count() and max(sizes.values()) < 1.05 * min(sizes.values())
    check_shards(rows, 24)
    where = {}
    for r in rows:
        assert where.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]


def test_a_hot_group_is_split(spark):
    docs = spark.createDataFrame([(k, "the same text " * 50) for k in range(600)] + [(k, f"text {k} " * 60) for k in range(600, 1800)], "doc_id long, text string")
    rows = sharding.shard(docs, 8, slots=256).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) < 1.1 * min(sizes.values()) and len({r["part"] for r in rows}) > 1
    check_shards(rows, 8)


def test_texts_of_a_hot_slot_stay_together(spark):
    """One slot for all: texts are dealt by text, and only one that alone exceeds a shard's share by id."""
    docs = spark.createDataFrame([(k, "the hot text " * 40) for k in range(300)] + [(k, f"text {k // 3} " * 30) for k in range(300, 1500)], "doc_id long, text string")
    rows = sharding.shard(docs, 6, slots=1).collect()
    where, sizes = {}, Counter()
    for r in rows:
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        sizes[r["shard"]] += r["size"]
    split = [k for k, v in where.items() if len(v) > 1]
    assert len(split) == 1 and split[0][1] == 13 * 40 + 8 and max(sizes.values()) < 1.4 * min(sizes.values())
    check_shards(rows, 6)


def test_sizes_and_checksums_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(edge(spark).select("doc_id", "text").filter("doc_id < 9").withColumn("doc_id", F.col("doc_id") + 10**6).dropDuplicates())
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.shard(docs, 4).collect()}
    assert got == {i: (len(t) + 8, zlib.crc32(t)) for i, t in text.items()}


def test_slot_map_versions(spark, tmp_path):
    draw = np.random.default_rng(3)
    sizes = {(s, 0): int(x) for s, x in enumerate(draw.integers(1, 1000, 512))}
    one = sharding.fitted(sizes, 8, 512)
    two = one.grow(sizes)
    moved = [e for e in sizes if one.shard_of[e] != two.shard_of[e]]
    assert moved and {two.shard_of[e] for e in moved} == {8} and max(two.loads(sizes)) < 1.1 * min(two.loads(sizes))
    more = {e: b * (5 if one.shard_of[e] == 0 else 1) for e, b in sizes.items()}
    three = one.rebalance(more)
    assert max(three.loads(more)) < 1.05 * min(three.loads(more)) and three.version == 2
    for m in (one, three):
        m.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == three and sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == one
    with pytest.raises(ValueError):
        three.save(spark, str(tmp_path / "map"))


def test_a_stored_map_places_records_that_it_was_not_fitted_to(spark, tmp_path):
    few = spark.createDataFrame([(k, f"early {k}") for k in range(200)] + [(k, "hot " * 500) for k in range(200, 260)], "doc_id long, text string")
    many = spark.createDataFrame([(k, f"later {k} " * 20) for k in range(1000)] + [(k, "hot " * 500) for k in range(1000, 1050)], "doc_id long, text string")
    sharding.shard(few, 5, map_path=str(tmp_path / "map")).count()
    old = sharding.SlotMap.load(spark, str(tmp_path / "map"))
    rows = sharding.assign(many, old).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(1050))
    check_shards(rows, 5)
    sizes = {e: x[0] for e, x in sharding.summed(sharding.records(many), old).items()}
    new = old.grow(sizes)
    grown = {r["doc_id"]: r["shard"] for r in sharding.assign(many, new).collect()}
    assert len(grown) == 1050 and all(grown[r["doc_id"]] in (r["shard"], 5) for r in rows) and 5 in grown.values()


def test_shards_of_odd_rows(spark):
    rows = sharding.shard(edge(spark), 3).collect()
    assert len(rows) == 13
    check_shards(rows, 3)
    assert sharding.shard(none(spark), 3).count() == 0 and sharding.assign(none(spark), sharding.fitted({}, 3)).count() == 0


def plain_base(docs, out):
    """The unigram base by hand: {row: (n_tokens, n_known, N, score)}."""
    words = [[bytes(w).lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t in docs]
    c, ends = Counter(), 0
    for w, o in zip(words, out, strict=True):
        if not o:
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    p = lambda k: np.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    return [(len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, sum(p(c[x]) for x in w) + p(ends)) for w in words]


def test_language_model(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = recurrent_lm.score(docs, language_id.held_out(F.col("doc_id"), 5)).join(docs.select("doc_id", language_id.held_out(F.col("doc_id"), 5).alias("o")), "doc_id").toPandas().sort_values("doc_id")
    rows = sorted(map(tuple, docs.collect()))
    for r, (n, known, total, score) in zip(got.itertuples(), plain_base(rows, got.o.tolist()), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(score)
    held = got[got.o]
    assert held.score.sum() > held.base_score.sum() and (got.score < 0).all()


def test_language_model_of_odd_rows(spark):
    got = recurrent_lm.score(edge(spark), F.lit(False)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 13 and by[3]["n_tokens"] == by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[3]["score"] == pytest.approx(by[4]["score"])
    assert recurrent_lm.score(none(spark), F.lit(False)).count() == 0
    alone = recurrent_lm.score(edge(spark), F.lit(True)).collect()
    assert len(alone) == 13 and all(r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in alone)


def test_a_score_does_not_depend_on_the_texts_beside_it():
    draw = np.random.default_rng(5)
    texts = [draw.integers(1, 40, draw.integers(0, 90)).astype(np.uint64) << np.uint64(4) for _ in range(20)]
    m = recurrent_lm.train(texts, vocabulary=20, epochs=1, lanes=4)
    ids, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    share = np.full(len(ids), -2.0)
    every = recurrent_lm.log_probability(m, ids, first, share)
    for k, t in enumerate(texts):
        assert recurrent_lm.log_probability(m, t, np.array([0, len(t)]), share[: len(t)])[0] == pytest.approx(every[k], rel=1e-4)


def test_scores_against_a_plain_forward_pass():
    """Word by word in float64, with the definitions of the gates."""
    draw = np.random.default_rng(9)
    texts = [draw.integers(1, 60, n).astype(np.uint64) << np.uint64(4) | draw.integers(0, 16, n).astype(np.uint64) for n in (0, 1, 7, 40, 300)]
    m = recurrent_lm.train(texts, vocabulary=25, epochs=2, lanes=3)
    ids, first = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    share = draw.normal(-3, 1, len(ids))
    got = recurrent_lm.log_probability(m, ids, first, share)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    softmax = lambda v: v - np.log(np.exp(v - v.max()).sum()) - v.max()
    inputs, turn, out, bias = (v.astype(float) for v in (m.inputs, m.turn, m.out, m.bias))
    width, n = turn.shape[0], len(m.ids)
    for t, text in enumerate(texts):
        h, row, total = np.zeros(width), n + recurrent_lm.ENDINGS, 0.0
        for k in range(len(text) + 1):
            g, u = inputs[row], h @ turn
            z, r = sigmoid(g[:width] + u[:width]), sigmoid(g[width : 2 * width] + u[width : 2 * width])
            h = (1 - z) * np.tanh(g[2 * width :] + r * u[2 * width :]) + z * h
            classes = softmax(h @ out + bias)
            if k == len(text):
                total += classes[0]
                break
            known, ending = np.flatnonzero(m.ids == text[k]), int(text[k]) & 15
            if len(known):
                row = int(known[0])
                own = m.words[m.cls[row]].astype(float)
                total += classes[m.cls[row]] + softmax(h @ own[:-1] + own[-1])[m.place[row]]
            else:
                row = n + ending
                total += classes[len(bias) - recurrent_lm.ENDINGS + ending] + share[first[t] + k]
        assert got[t] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_training_takes_long_texts_in_pieces_and_all_cells(spark, monkeypatch):
    """No text is left out for its length, words stay whole, and models of many cells are averaged."""
    monkeypatch.setattr(recurrent_lm, "PIECE", 200)
    monkeypatch.setattr(recurrent_lm, "CELL", 2000)
    docs = [(k, " ".join(f"w{(7 * k + j) % 50}" for j in range(30 + 400 * (k % 5 == 0)))) for k in range(40)]
    rows = spark.createDataFrame([(i, t, True) for i, t in docs], "id long, text string, train boolean")
    got = recurrent_lm._pieces(rows, 1.0).collect()
    assert Counter(w for r in got for w in r["text"].split()) == Counter(w for _, t in docs for w in t.split()) and max(len(r["text"]) for r in got) <= 200
    total = lambda: [r["score"] for r in recurrent_lm.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") >= 30).collect()]
    fitted = total()
    monkeypatch.setattr(recurrent_lm, "EPOCHS", 0)
    assert len(fitted) == 40 and sum(fitted) > sum(total())
    part = recurrent_lm._pieces(rows, 0.5).count()
    assert 0.3 * len(got) < part < 0.7 * len(got)


def test_training_takes_all_texts(spark, monkeypatch):
    """Every word of every training text is in a round, however many there are."""
    docs = [(k, f"a{k} b{k % 7} c{k}") for k in range(3000)]
    seen = []
    monkeypatch.setattr(recurrent_lm, "_fitted", lambda model, pieces: seen.append(pieces) or model)
    recurrent_lm.score(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 5 == 1)
    want = Counter(w for i, t in docs if i % 5 != 1 for w in t.split())
    assert Counter(w for r in seen[0].collect() for w in r["text"].split()) == want
    for size, often in ((6000, 1), (1 << 20, recurrent_lm.EPOCHS)):
        monkeypatch.setattr(recurrent_lm, "CELL", size)
        _, rounds = recurrent_lm._rounds(seen[0], 60_000)
        assert Counter(w for x in rounds for r in x.collect() for w in r["text"].split()) == Counter({w: often * n for w, n in want.items()})


def test_class_probabilities_sum_to_one():
    m = recurrent_lm.train([np.arange(1, 60, dtype=np.uint64) << np.uint64(4)] * 3, vocabulary=30, epochs=1, lanes=2)
    known = m.ids
    others = np.arange(16, dtype=np.uint64)  # one word of each ending, with all of its class's share
    ids = np.concatenate([known, others])
    first = np.arange(len(ids) + 1)
    both = recurrent_lm.log_probability(m, ids, first, np.zeros(len(ids)))
    end = recurrent_lm.log_probability(m, ids[:0], np.array([0, 0]), np.zeros(0))[0]
    row, _, _ = m.coded(ids)
    z = np.zeros((len(ids), 16), np.float32)
    g = m.inputs[np.full(len(ids), len(m.ids) + 16)]
    h = (1 - recurrent_lm._sigmoid(g[:, :16])) * np.tanh(g[:, 32:]) + z
    after = np.array([_end_after(m, h[:1], r) for r in row])
    assert np.exp(both - after).sum() + np.exp(end) == pytest.approx(1, abs=1e-3)


def _end_after(m, h, row):
    g, u = m.inputs[[row]], h @ m.turn
    z, r = recurrent_lm._sigmoid(g[:, :16] + u[:, :16]), recurrent_lm._sigmoid(g[:, 16:32] + u[:, 16:32])
    n = (1 - z) * np.tanh(g[:, 32:] + r * u[:, 32:]) + z * h
    return recurrent_lm._log_softmax(n @ m.out + m.bias)[0, 0]


def test_pipeline_against_a_plain_version(spark, sf):
    import corpus_pipeline

    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    lost = plain_lines([(d[0], d[1]) for d in docs])
    kept = []
    for k, d in enumerate(docs):
        lines = d[1].split("\n")
        if re.search("[^\\W\\d_]", d[1]) and len(lost[k]) < sum(bool(x.split()) for x in lines):
            kept.append((d[0], "\n".join(x for n, x in enumerate(lines) if n not in lost[k])))
    texts = [t for _, t in kept]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] or texts[i].split() and texts[j].split() and jaccard(texts[i], texts[j]) >= 0.8]
    kept = [kept[k] for k, r in enumerate(roots(len(texts), links)) if k == r]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not plain_hits(t, items)[1]]
    code = packing.encoder(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN)
    want = sorted((i, n) for i, t in kept for n in packing.pieces(len(code.encode_ordinary(t)) + 1))
    got = sorted((r["doc_id"], r["length"]) for r in corpus_pipeline.run(spark, sf).select("doc_id", "length").collect())
    assert got == want


def test_pipeline_stages_keep_the_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_pipeline_stages_of_odd_rows(spark, sf):
    """Nulls, empty and long texts, repeated rows, clashing names and an empty table in every stage."""
    import corpus_pipeline

    want = {
        "language ID": {0, 1, 2, 6, 7, 8, 9, 10, None},
        "line dedup": {0, 3, 4, 5, 6, 7, 8, 9, 10, None},
        "MinHash near-dedup": {0, 3, 4, 5, 6, 7, 8, 9, 10, None},
        "benchmark decontamination": {0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None},
    }
    docs = edge(spark).withColumnRenamed("key", "__key").withColumn("lost", F.lit(1)).withColumn("row", F.lit("r"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0, name
        ids = {r["doc_id"] for r in got.select("doc_id").collect()}
        assert ids <= want[name] if name == "language ID" else ids == want[name], name
    packed = corpus_pipeline.pack(spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == want["benchmark decontamination"] and corpus_pipeline.pack(spark, docs.limit(0), sf).count() == 0
