import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vaultspark.llm.textvec import ALNUM, LOWER, SPACED, Texts, hash_spans, owner, shingles, slices

PATTERN = {"spaced": (SPACED, rb"[^\x20\x09-\x0D]+"), "alnum": (ALNUM, rb"[0-9A-Za-z\x80-\xff]+")}


@pytest.mark.parametrize("kind", PATTERN)
@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\té.Z9", max_size=40)), max_size=8))
def test_words_are_those_of_the_pattern(kind, texts):
    inside, pattern = PATTERN[kind]
    t = Texts(pa.array(texts, pa.string()))
    a, b, first = t.spans(inside)
    found = [[bytes(t.buf[a[k] : b[k]]) for k in range(first[i], first[i + 1])] for i in range(len(texts))]
    assert found == [re.findall(pattern, (x or "").encode()) for x in texts]


def test_equal_words_have_equal_hashes_and_others_have_not():
    words = ["a", "ab", "ba", "abcdefgh", "abcdefghi", "abcdefghij", "x" * 70_000, "x" * 69_999, "A", "é", "\0", "\0\0"]
    t = Texts(pa.array([" ".join(words), "  ".join(reversed(words))]))
    h, first = t.words(SPACED)
    assert len(set(h[: first[1]].tolist())) == len(words)
    assert h[: first[1]].tolist() == h[first[1] :][::-1].tolist()
    low = Texts(pa.array(["Ab aB"])).words(SPACED, LOWER)[0]
    assert low[0] == low[1]


def test_shingles_stay_in_their_text():
    words, first = Texts(pa.array(["a b c d e f", "a b", None, "a b c d e"])).words(SPACED)
    s, begin, at = shingles(words, first, 5)
    assert np.diff(begin).tolist() == [2, 1, 0, 1]
    assert s[0] == s[3] and s[2] not in (s[0], s[1]) and at.tolist() == [0, 1, 6, 8]
    assert owner(begin).tolist() == [0, 0, 1, 3]


def test_slices_cover_all_rows_once():
    c = pa.array(["x" * n for n in (5, 100, 1, 1, 300, 0)] + [None])
    parts = list(slices(c, 100))
    assert [k for a, b in parts for k in range(a, b)] == list(range(7))


def test_hash_does_not_depend_on_place():
    buf = np.frombuffer(b"zz needle needle", np.uint8)
    assert len(set(hash_spans(buf, np.array([3, 10]), np.array([9, 16])).tolist())) == 1
