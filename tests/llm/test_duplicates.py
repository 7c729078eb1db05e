"""Line, near-duplicate and passage operators against brute force."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from tests.llm.cases import edge, none
from vaultspark.llm import graph, line_dedup, near_dedup, substring_dedup, textvec


def plain_lines(docs):
    """Lines that go: {row: [line]} by comparing every line with all before."""
    seen, out = [], defaultdict(list)
    for row, (_, text) in enumerate(docs):
        for n, line in enumerate((text or "").split("\n")):
            s = frozenset(line.encode().split())
            if s:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    out[row].append(n)
                seen.append(s)
    return out


def corpus(spark, sf, n):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(n).collect()]


def test_lines_against_brute_force(spark, sf):
    docs = corpus(spark, sf, 120)
    docs += [(1000 + k, f"one two three four five six seven eight nine {'ten' if k % 2 else 'eleven'} v{k}\nsame line here") for k in range(30)]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.summary(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = plain_lines(docs)
    assert {i: got[i] for i in got} == {i: want.get(k, []) for k, (i, _) in enumerate(docs)}


def test_lines_that_the_first_candidate_does_not_settle(spark):
    """Each is like the one before but not like the first: later candidates have to be tried."""
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(words[k : k + 20])) for k in range(40)]
    got = {r["doc_id"]: r["removed"] for r in line_dedup.summary(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = plain_lines(docs)
    assert got == {i: want.get(k, []) for k, (i, _) in enumerate(docs)}


def test_lines_of_odd_rows(spark):
    got = line_dedup.deduplicate(edge(spark))
    by = defaultdict(list)
    for r in got.collect():
        by[r["doc_id"]].append(r["text"])
    assert got.columns == edge(spark).columns
    assert len(by[0]) == 2 and 1 not in by and 2 not in by  # the copy and the near copy lost all their lines
    assert by[3] == [None] and by[4] == [""] and by[5] == ["   \n\t "] and by[8] == ["x\ny"] and by[None] == ["a text without an id at all"]
    assert by[10] == ["tail of another kind " * 5]
    assert line_dedup.deduplicate(none(spark)).count() == 0 and line_dedup.summary(none(spark)).count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def roots(n, links):
    up = list(range(n))
    for a, b in links:
        a, b = (next(iter(_climb(up, x))) for x in (a, b))
        up[max(a, b)] = min(a, b)
    return [next(iter(_climb(up, x))) for x in range(n)]


def _climb(up, x):
    while up[x] != x:
        x = up[x]
    yield x


def weights_of(texts):
    """Each text's shingles with count times 1 + ln(N / df) / ln N, by hand."""
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    sets = [grams(t.split()) for t in texts]
    df, n = Counter(g for s in sets for g in s), len(texts)
    return [{g: c * (1 + math.log(n / df[g]) / math.log(n)) for g, c in s.items()} for s in sets]


def weighted_jaccard(a, b):
    both = sum(min(w, b[g]) for g, w in a.items() if g in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def test_near_duplicates_against_brute_force(spark, sf):
    """Classes by the weighted similarity of all pairs."""
    docs = corpus(spark, sf, 200)
    text = " ".join(f"t{k}" for k in range(300))
    docs += [(5000 + k, " ".join(f"new{k}" if j == 17 * k else w for j, w in enumerate(text.split()))) for k in range(12)]
    sets = weights_of([t for _, t in docs])
    links = [(i, j) for i, j in combinations(range(len(docs)), 2) if docs[i][1] == docs[j][1] or weighted_jaccard(sets[i], sets[j]) >= 0.8]
    want = {docs[k][0]: docs[r][0] for k, r in enumerate(roots(len(docs), links))}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_recall_of_near_duplicates(spark):
    """Pairs on both sides of the bound: of those whose weighted similarity reaches it, by hand, nine in ten share a class, and no others."""
    draw = random.Random(2)
    docs = []
    for k in range(150):
        base = [f"w{draw.randrange(9000)}" for _ in range(120)]
        near = [f"n{draw.randrange(9000)}" if j in (10, 60)[: 1 + k % 2] + ((100,) if k % 3 == 0 else ()) else w for j, w in enumerate(base)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    sets = weights_of([t for _, t in docs])
    want = {2 * k for k in range(150) if weighted_jaccard(sets[2 * k], sets[2 * k + 1]) >= 0.8}
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {2 * k for k in range(150) if got[2 * k + 1] == 2 * k}
    assert 20 < len(want) < 150 and found <= want and len(found) >= 0.9 * len(want)


def test_near_copies_of_one_text_that_are_not_near_each_other(spark):
    """Each copy is linked with the source only, so a leader other than the source is near none of the others."""
    base = [f"s{k}" for k in range(142)]
    places = [(a, b) for a in range(5, 137) for b in range(a + 11, 137, 13)]
    docs = [(0, " ".join(base))] + [(k + 1, " ".join(f"c{k}x{j}" if j in at else w for j, w in enumerate(base))) for k, at in enumerate(places[::4][:130])]
    other = [f"o{k}" for k in range(200)]
    docs += [(1000, " ".join(other)), (1001, " ".join(other[:150] + [f"q{k}" for k in range(50)]))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(docs) > 120 and got == {i: i if i >= 1000 else 0 for i, _ in docs}


def test_members_that_links_do_not_join_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 7)
    test_near_copies_of_one_text_that_are_not_near_each_other(spark)


def test_near_duplicates_of_odd_rows(spark):
    rows = near_dedup.classes(edge(spark)).collect()
    by = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in rows}
    assert len(rows) == 13 and by[0] == by[1] == by[2] == (0, 4) and by[3] == (3, 1) and by[4] == (4, 1) and by[None] == (None, 1)
    kept = near_dedup.deduplicate(edge(spark))
    assert kept.columns == edge(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [0, 3, 4, 5, 6, 7, 8, 9, 10]
    assert near_dedup.classes(none(spark)).count() == 0 and near_dedup.deduplicate(none(spark)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (3, 1)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20, 21: 20}


def test_passages_against_brute_force(spark, sf):
    docs = corpus(spark, sf, 150)
    shared = " ".join(f"p{k}" for k in range(60))
    docs += [(7000 + k, " ".join(f"d{k}x{j}" for j in range(40 + k)) + " " + shared + " " + " ".join(f"e{k}x{j}" for j in range(30))) for k in range(6)]
    words = {i: t.split() for i, t in docs}
    where = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 50):
            where[tuple(w[k : k + 51])].add(i)
    want = {i for v in where.values() if len(v) > 1 for i in v}
    rows = substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert want <= {r["doc_id"] for r in rows} | {r["other_id"] for r in rows}
    ids = sorted(words)
    root = dict(zip(ids, roots(len(ids), [(ids.index(r["doc_id"]), ids.index(r["other_id"])) for r in rows]), strict=True))
    assert all(len({root[i] for i in v}) == 1 for v in where.values() if len(v) > 1)
    for r in rows:
        a, b = words[r["doc_id"]][r["start"] :][: r["words"]], words[r["other_id"]][r["other_start"] :][: r["other_words"]]
        assert jaccard(" ".join(a), " ".join(b)) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8 and max(len(a), len(b)) >= 50


def test_near_passages(spark):
    body = [f"p{k}" for k in range(120)]
    other = [*body[:50], "inserted", *body[50:90], "swapped", *body[91:]]
    docs = [(1, " ".join([*(f"a{k}" for k in range(30)), *body])), (2, " ".join([*other, *(f"b{k}" for k in range(30))])), (3, " ".join(f"c{k}" for k in range(200)))]
    rows = substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) >= 1 and {(r["doc_id"], r["other_id"]) for r in rows} == {(2, 1)} and max(r["words"] for r in rows) >= 110


def test_passages_of_copies_that_are_not_near_the_first_text(spark):
    """Two texts hold one edited form of a passage that is not near its source: they are linked whichever text comes first."""
    docs = []
    for f in range(600):
        source = [f"f{f}p{k}" for k in range(56)]
        edited = [f"f{f}edit{k}" if k % 24 == 14 else w for k, w in enumerate(source)]
        docs += [(10 * f + n, " ".join([*body, *(f"f{f}d{n}x{k}" for k in range(60))])) for n, body in enumerate([source, edited, edited])]
    rows = substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(10 * f + 2, 10 * f + 1) for f in range(600)} == {(r["doc_id"], r["other_id"]) for r in rows}


def planted(edits):
    """Groups of texts that share a passage, each but the first with so many words of it changed, under ids in no order, and texts of their own."""
    draw = random.Random(edits + 5)
    some = lambda n: [f"w{draw.randrange(4000)}" for _ in range(n)]
    ids, docs, groups = draw.sample(range(5000), 900), [], []
    for size in (2, 3, 5, 10):
        for _ in range(15):
            source, own = some(70 + 30 * (edits > 0)), []
            for copy in range(size):
                body = list(source)
                for at in draw.sample(range(len(body)), edits if copy else 0):
                    body[at] = f"edit{draw.randrange(4000)}"
                own.append(ids.pop())
                docs.append((own[-1], " ".join(some(draw.randrange(20, 150)) + body + some(draw.randrange(20, 150)))))
            groups.append(sorted(own))
    docs += [(ids.pop(), " ".join(some(200))) for _ in range(100)]
    return docs, groups


def test_every_later_text_of_an_exact_passage_has_a_row(spark):
    docs, groups = planted(0)
    rows = substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in rows} == {i for g in groups for i in g[1:]} and all(r["other_id"] < r["doc_id"] for r in rows)


def test_recall_of_near_passages(spark):
    """Of texts that an earlier one has a near passage of, by verifying all pairs of a group, nine in ten have a row."""
    import pyarrow as pa

    docs, groups = planted(2)
    found = {r["doc_id"] for r in substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}

    def set_of(text):
        words, first = textvec.Texts(pa.array([text])).words(textvec.SPACED)
        return textvec.shingles(words, first, 5)[0]

    sets = {i: set_of(t) for i, t in docs}
    near = lambda a, b: substring_dedup.passages(sets[a], sets[b], [0, len(sets[a]) - 1, 0, len(sets[b]) - 1], 46, 0.8)
    want = {b for g in groups for k, b in enumerate(g) if any(near(a, b) for a in g[:k])}
    assert found <= want and len(found) >= 0.9 * len(want)


def test_no_link_of_a_group_is_lost(spark):
    """Texts of large groups that hold edited forms of one passage, near few of each other, and a line that many others hold: rows join all that have a near passage."""
    import pyarrow as pa

    draw = random.Random(3)
    some = lambda n: [f"w{draw.randrange(4000)}" for _ in range(n)]
    docs, groups, line = [], [], some(24)
    for g in range(12):
        source, own = some(100), []
        for copy in range(40):
            body = list(source)
            for at in draw.sample(range(len(body)), 2 if copy != 20 else 0):
                body[at] = f"edit{draw.randrange(4000)}"
            own.append(100 * g + copy)
            docs.append((own[-1], " ".join(some(30) + body + some(30))))
        groups.append(own)
    docs += [(5000 + k, " ".join(some(60) + line + some(60))) for k in range(200)]
    rows = substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    ids = sorted(i for i, _ in docs)
    root = dict(zip(ids, roots(len(ids), [(ids.index(r["doc_id"]), ids.index(r["other_id"])) for r in rows]), strict=True))
    words, first = textvec.Texts(pa.array([t for _, t in docs])).words(textvec.SPACED)
    found, begin, _ = textvec.shingles(words, first, 5)
    sets = {i: found[begin[k] : begin[k + 1]] for k, (i, _) in enumerate(docs)}
    near = lambda a, b: substring_dedup.passages(sets[a], sets[b], [0, len(sets[a]) - 1, 0, len(sets[b]) - 1], 46, 0.8)
    links = [(a, b) for g in groups for k, b in enumerate(g) for a in g[:k] if near(a, b)]
    apart = [(a, b) for a, b in links if root[a] != root[b]]
    assert len(links) > 5000 and not apart and max(r["doc_id"] for r in rows) < 5000
    assert len({(r["doc_id"], r["start"], r["other_id"], r["other_start"]) for r in rows}) == len(rows)


def test_classes_of_a_text_that_repeats_one_centre_take_memory_by_its_records():
    """Two texts of 1500 places of one centre, each place told of a passage over all of the other's: joined, without a row for each two places."""
    import tracemalloc

    import numpy as np

    n = 1500
    places, full = np.arange(n, dtype=np.uint32), lambda v, kind: np.full(n, v, kind)
    record = lambda text: [full(9, np.uint64), full(text, np.uint64), full(text, np.int64), places, places, places + 60, *np.zeros((2, n), np.uint32), full(0, np.uint8), full(0, np.uint8)]
    told = [full(9, np.uint64), full(2, np.uint64), full(1, np.int64), full(0, np.uint32), places, full(n, np.uint32), *np.zeros((2, n), np.uint32), full(255, np.uint8), full(0, np.uint8)]
    alone = [x[:1].copy() for x in record(3)]
    columns = [np.concatenate(x) for x in zip(record(1), record(2), told, alone, strict=True)]
    tracemalloc.start()
    key, doc, *_, cls, _, joined = substring_dedup._unjoined(columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(key) == 2 * n + 1 and len(set(cls[doc < 3])) == 1 and len(set(cls)) == 2 and (joined == (doc == 2)).all()
    assert peak < 8 << 20


def test_windows_are_those_of_the_definition():
    import numpy as np

    draw = np.random.default_rng(1)
    for _ in range(50):
        sizes = draw.integers(0, 60, 3)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        key = draw.integers(0, 1 << 62, begin[-1]).astype(np.uint64)
        a, c, b = substring_dedup.windows(key, begin, 10)
        want = []
        for x, y in zip(begin, begin[1:], strict=False):
            for p in range(x, y):
                i, j = p, p
                while i > x and key[i - 1] > key[p]:
                    i -= 1
                while j + 1 < y and key[j + 1] > key[p]:
                    j += 1
                if j - i + 1 >= 10:
                    want.append((i, p, j))
        assert list(zip(a.tolist(), c.tolist(), b.tolist(), strict=True)) == want


def test_passages_of_odd_rows(spark):
    rows = substring_dedup.repeats(edge(spark)).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in rows}
    assert (1, 0) in pairs and ((2, 0) in pairs or (2, 10) in pairs or (10, 2) in pairs)
    assert substring_dedup.repeats(none(spark)).count() == 0


def test_lines_of_documents_with_one_id(spark):
    """Order within an id is by a hash of the text, within a text by line; nulls come last."""
    words = [f"w{k}" for k in range(30)]
    texts = ["\n".join(" ".join(f"x{k}{j}" if j == k % 9 else w for j, w in enumerate(words[k % 4 : k % 4 + 20])) for k in range(a, a + 6)) for a in range(0, 60, 6)]
    df = spark.createDataFrame([(None if k % 2 else 5, t) for k, t in enumerate(texts)], "doc_id long, text string")
    order = sorted([(r["doc_id"] is None, r["h"], r["text"]) for r in df.selectExpr("doc_id", "text", "xxhash64(doc_id, text) as h").collect()])
    want = plain_lines([(None, t) for _, _, t in order])
    got = {r["text"]: r["removed"] for r in _with_text(df, line_dedup)}
    assert got == {t: want.get(k, []) for k, (_, _, t) in enumerate(order)}


def _with_text(df, module):
    _, gone = module.removals(df)
    lost = defaultdict(list)
    for r in gone.collect():
        lost[r["key"]].append(r["line"])
    return [{"text": r["text"], "removed": sorted(lost[r["h"]])} for r in df.selectExpr("text", "xxhash64(doc_id, text) as h").collect()]
