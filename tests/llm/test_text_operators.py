"""Packing, decontamination, language and quality against plain versions, and on odd rows."""

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import LONG, edge, none
from vaultspark.llm import catalog, decontamination, language_id, packing, quality_classifier


def test_packing_gives_the_ids_of_the_tokenizers_library(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack(docs, keep=["doc_id"]).toPandas().sort_values(["doc_id", "start"])
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == r["doc_id"]]
        assert np.concatenate(own.ids.to_list()).tolist() == ids.tolist()
        assert own.start.tolist() == [0, *np.cumsum(own.length).tolist()[:-1]] and set(own.doc_tokens) == {len(ids)}
        assert all(n & (n - 1) == 0 and n <= 1024 for n in own.length)
        assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(own.ids, own.ids_crc32, strict=True))
    assert got.sequence_id.is_unique and (got.offset == 0).all()


def test_packing_of_texts_that_name_the_added_token(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one<|endoftext|>two", "<|endoftext|>", " a <|endoftext|> \n<|endoftext|><|endoftext|>", "<|endoftext", "<|fim_prefix|> x"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas().sort_values(["doc_id", "start"])
    for k, text in enumerate(texts):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        own = got[got.doc_id == k]
        assert np.concatenate(own.ids.to_list()).tolist() == ids and set(own.doc_tokens) == {len(ids)}


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 4097, 12345])
def test_pieces(n):
    assert sum(packing.pieces(n)) == n and len(packing.pieces(n)) <= n // 1024 + 10


def test_packing_of_odd_rows(spark):
    got = packing.pack(edge(spark)).toPandas()
    assert "text" not in got.columns and got[got.doc_id == 3].length.tolist() == [1] and got[got.doc_id == 4].ids.iloc[0] == [0]
    assert got[got.doc_id == 0].doc_tokens.nunique() == 1 and (got.groupby("doc_id").length.sum()[0] == 2 * got[got.doc_id == 0].doc_tokens.iloc[0])
    assert packing.pack(none(spark)).count() == 0
    assert set(packing.padding(packing.pack(edge(spark))).toPandas().padding) == {0}


def plain_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        own = words(t)
        n = min(10, len(own))
        wins = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in wins:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 24, 600])
def test_decontamination_against_brute_force(spark, block):
    items = [(1, " ".join(f"word{k}" for k in range(5, 40))), (2, "Alpha, BETA gamma"), (10, "Alpha, BETA gamma"), (3, ""), (4, None), (5, "façade ünïcode"), (None, "word1 word2"), (6, " ".join(f"word{k}" for k in range(60, 69)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = edge(spark)
    got = decontamination.decontaminate(docs, bench, block_bytes=block)
    assert set(docs.columns) <= set(got.columns)
    for r in got.collect():
        n, hit, found = plain_hits(r["text"], [x for x in items if x[0] is not None and x[1]])
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["n_items"], r["contaminated"]) == (n, hit, found, len(found), hit > 0)
    assert got.count() == docs.count()
    assert decontamination.decontaminate(none(spark), bench).count() == 0
    assert not decontamination.decontaminate(docs, bench.limit(0)).filter("contaminated").count()


def test_language(spark, sf):
    got = catalog.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("xyz", None)], "text string, lang string")
    p = language_id.learn(docs)
    assert p.languages == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(edge(spark), p).collect()}
    assert got[3] == got[4] == got[5] == "und" and got[9] in ("de", "en") and len(got) == 12
    nothing = language_id.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(edge(spark), nothing).collect()} == {"und"}
    assert language_id.identify(none(spark), p).count() == 0


def test_languages_of_copies_have_profiles(spark):
    """Each language has more rows than the sample, but few different texts, or few with a letter."""
    docs = [(k, f"text {n} of {l}", l) for l in "abcdefgh" for n in range(2) for k in range(20)]
    docs += [(k, f"{k} {k * k}", "z") for k in range(100)] + [(100, "one with letters", "z")]
    p = language_id.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"), sample=5)
    assert p.languages == [*"abcdefgh", "z"]


def test_grams_and_ranks():
    assert sorted(language_id.grams("aB, a1").tolist()) == sorted(language_id.grams("ab a").tolist())
    assert len(language_id.grams("123 !")) == 0
    assert language_id.ranked(np.array([5, 3, 5, 9, 3, 5]), 2).tolist() == [5, 3]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.op3_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    r, y = got.score.rank().to_numpy(), got.quality.to_numpy()
    auc = (r[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.97 and got.score.between(0, 1).all()


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (7, 0), (None, 1), (1, None), (99, 1)], "doc_id long, quality int")
    e = quality_classifier.learn(edge(spark), labels)
    got = quality_classifier.score(edge(spark), e)
    assert got.count() == 13 and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality_classifier.score(none(spark), quality_classifier.learn(edge(spark), labels.limit(0))).count() == 0


def test_compiled_rules_equal_the_arrays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    x = quality_classifier.measured(docs, keep=["doc_id"]).orderBy("doc_id").toPandas()
    a = x[[f"q_{s}" for s in quality_classifier.STATISTICS]].to_numpy(float)
    y = (a[:, 3] > np.median(a[:, 3])).astype(float)
    e = quality_classifier.fit(a, y)
    z = e.intercept + sum(w * quality_classifier._hits(a, r) for r, w in e.rules)
    got = quality_classifier.score(docs, e, keep=["doc_id"]).orderBy("doc_id").toPandas()
    assert np.allclose(got.score, 1 / (1 + np.exp(-z))) and len(e.rules) > 0


def test_long_text_is_whole(spark):
    n = {r["doc_id"]: r["q_words"] for r in quality_classifier.measured(edge(spark)).collect()}
    assert round(np.expm1(n[6])) == len(LONG.split())


def test_languages_against_a_plain_distance(spark, sf):
    """Profiles and distances by hand, on whole texts."""
    def grams(text):
        out, word = Counter(), ""
        for c in [*text, " "]:
            if unicodedata.category(c)[0] in "LM":
                word += c.lower() if len(c.lower()) == 1 else c
            elif word:
                w = f" {word} "
                out.update(x for n in (1, 2, 3) for x in (w[k : k + n] for k in range(len(w) - n + 1)) if x != " ")
                word = ""
        return out

    def top(counts):
        key = lambda x: [1 if c == " " else ord(c) for c in x]
        return [g for g, _ in sorted(counts.items(), key=lambda e: (-e[1], _code(key(e[0]))))[: language_id.PROFILE]]

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").filter("length(text) < 4000")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    known = {lang: Counter() for _, _, lang in rows}
    for t, lang in {(t, lang) for _, t, lang in rows if any(c.isalpha() for c in t)}:
        known[lang].update(grams(t))
    profiles = {lang: {g: k for k, g in enumerate(top(c))} for lang, c in sorted(known.items())}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    for i, t, _ in rows:
        mine = top(grams(t)) if any(unicodedata.category(c)[0] == "L" for c in t) else []
        far = {lang: sum(abs(p[g] - k) if g in p else language_id.PROFILE for k, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(far, key=lambda lang: (far[lang], lang)) if mine else "und"
        assert got[i] == (best, pytest.approx(1 - far[best] / (language_id.PROFILE * len(mine)) if mine else 0.0))


def _code(points):
    out = 0
    for p in points:
        out = out << 21 | p
    return out


def test_marks_alone_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "\u0301\u0308 \u0301", None), (3, None, None), (4, "12 !", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, language_id.learn(docs)).collect()}
    assert got[1][0] == "en" and got[2] == got[3] == got[4] == ("und", 0.0)


def test_quality_statistics_against_plain_python(spark, sf):
    def plain(text):
        t = (text or "").encode()
        w, lines = re.findall(rb"[^\x20\x09-\x0D]+", t), re.findall(rb"[^\n]+", t)
        share = lambda a, b: a / max(b, 1)
        earlier = lambda items: len(items) - len(set(items))
        chars, n = sum(map(len, w)), len(w)
        mean = share(chars, n)
        classes = [rb"[A-Z]", rb"[0-9]", rb"[#$%&*+<=>\\^_`{|}~]", rb"[!?]", rb"[,\-.:;]", rb"[\x80-\xFF]"]
        five = [tuple(w[k : k + 5]) for k in range(max(1, n - 4))] if w else []
        return [
            np.log1p(n), mean, max(share(sum(len(x) ** 2 for x in w), n) - mean**2, 0) ** 0.5, *(share(len(re.findall(c, t)), chars) for c in classes),
            share(len(set(w)), n), share(sum(a == b for a, b in zip(w, w[1:])), n), share(earlier(five), len(five)), np.log1p(share(n, len(lines))),
            share(earlier(lines), len(lines)), share(sum(len(x) > 30 for x in w), n),
        ]

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(edge(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text").filter("doc_id is not null").dropDuplicates())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_classifier.measured(docs, keep=["doc_id"]).collect():
        assert [r[f"q_{s}"] for s in quality_classifier.STATISTICS] == pytest.approx(plain(text[r["doc_id"]]), abs=1e-9), r["doc_id"]
